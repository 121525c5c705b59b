"""Conversations as training text: columnar byte assembly with a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

#: A turn is "### role:\n", its text and "</turn>\n". Inside roles and texts a backslash stands before every byte that
#: could begin a control string (and before backslashes), so that control strings never occur there.
OPEN, CLOSE, END = b"### ", b":\n", b"</turn>\n"
#: Bytes of a conversation after which a further part begins.
PART_BYTES = 32 << 20

_IN_TEXT = np.zeros(256, bool)
_IN_TEXT[list(b"\\#<")] = True
_IN_ROLE = _IN_TEXT.copy()
_IN_ROLE[list(b":\n")] = True


def _escaped(data: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a backslash before each special one, and the new row offsets."""
    marked = special[data]
    shift = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(len(data) + int(shift[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies row i of (data, offsets) to place at[i] of ``out``."""
    if len(data):
        out[np.repeat(at - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, the turns' offsets, and start and end of each turn's text.

    Lengths of opening, role, text and end give every segment's place by running sums; each kind of segment is
    then copied by one scatter into the buffer that was allocated for all.
    """
    roles, role_at = _escaped(*common.text_bytes(role), _IN_ROLE)
    texts, text_at = _escaped(*common.text_bytes(text), _IN_TEXT)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = len(OPEN) + n_role + len(CLOSE) + n_text + len(END)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(start[-1]), np.uint8)
    role_start = start[:-1] + len(OPEN)
    text_start = role_start + n_role + len(CLOSE)
    for literal, at in ((OPEN, start[:-1]), (CLOSE, text_start - len(CLOSE)), (END, text_start + n_text)):
        out[at[:, None] + np.arange(len(literal))] = np.frombuffer(literal, np.uint8)
    _scatter(out, role_start, roles, role_at)
    _scatter(out, text_start, texts, text_at)
    return out, start, text_start, text_start + n_text


def _parts(conv: np.ndarray, start: np.ndarray, part_bytes: int) -> np.ndarray:
    """Indices of the turns that open a new conversation or part."""
    first = np.ones(len(conv), bool)
    first[1:] = conv[1:] != conv[:-1]
    opens = np.flatnonzero(first)
    since = start[:-1] - np.repeat(start[opens], np.diff(np.append(opens, len(conv))))
    cut = since // part_bytes
    first[1:] |= cut[1:] != cut[:-1]
    return np.flatnonzero(first)


def format_conversations(turns: DataFrame, trained_role: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_starts and loss_ends (byte ranges of trained texts in ``formatted``).

    Turns are shuffled by conv_id and sorted by turn, role and text; tasks then work on Arrow batches, never on single
    turns. A conversation is one row; one above ``part_bytes`` continues in further parts, cut between turns, so that
    memory stays bounded however long it is.

    Null roles and texts are empty; a null turn comes first; turns with one number follow each other by role and text,
    repeated rows each; rows with a null conv_id form one conversation; an empty table gives no rows; other columns are
    ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition(common.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, part long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"

    def convert(table: pa.Table, first_part: int) -> tuple[pa.RecordBatch, int]:
        """Formatted rows of whole turns, and the part number of the last row."""
        column = lambda c: table.column(c).combine_chunks()
        out, start, low, high = assemble(column("role"), column("text"))
        ids = column("conv_id")
        # nulls get a number of their own that no id has at this place
        key = ids.fill_null(0).to_numpy() * 2 + 1
        key[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        opens = _parts(key, start, part_bytes)
        ends = np.append(opens[1:], len(key))
        new = np.ones(len(opens), bool)
        new[1:] = key[opens[1:]] != key[opens[:-1]]
        group = np.cumsum(new) - 1
        part = np.arange(len(opens)) - np.flatnonzero(new)[group] + np.where(group == 0, first_part, 0)
        trained = np.array([r == trained_role for r in table.column("role").to_pylist()], bool)
        lows, highs = low - np.repeat(start[opens], ends - opens), high - np.repeat(start[opens], ends - opens)
        chosen = np.concatenate([[0], np.cumsum(trained)])
        bounds = pa.array(np.append(chosen[opens], chosen[-1]), pa.int32())
        buffer = pa.BinaryArray.from_buffers(
            pa.large_binary(), len(opens), [None, pa.py_buffer(np.append(start[opens], start[-1]).astype(np.int64)), pa.py_buffer(out)]
        )
        batch = pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(opens)), pa.array(part, pa.int64()), pa.array(ends - opens, pa.int64()), buffer.cast(pa.binary()),
                pa.ListArray.from_arrays(bounds, pa.array(lows[trained], pa.int64())),
                pa.ListArray.from_arrays(bounds, pa.array(highs[trained], pa.int64())),
            ],
            names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
        )
        return batch, int(part[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, given = [], 0, 0, None
        for batch in batches:
            for piece in common.slices(batch, "text", part_bytes):
                if not piece.num_rows:
                    continue
                if not held and part and piece.column("conv_id")[0] != given:
                    part = 0  # what was given ended its conversation
                last = piece.column("conv_id")[-1]
                same = [i for i in range(piece.num_rows - 1, -1, -1) if piece.column("conv_id")[i] != last][:1]
                cut = same[0] + 1 if same else 0
                if cut:
                    held.append(piece.slice(0, cut))
                    yield convert(pa.Table.from_batches(held), part)[0]
                    held, size, part = [], 0, 0
                elif held and held[-1].column("conv_id")[-1] != last:
                    yield convert(pa.Table.from_batches(held), part)[0]
                    held, size, part = [], 0, 0
                held.append(piece.slice(cut))
                size += held[-1].nbytes
                if size >= part_bytes:
                    # one conversation alone is longer than a part: give what is here and go on in the next part
                    done, number = convert(pa.Table.from_batches(held), part)
                    yield done
                    held, size, part, given = [], 0, number + 1, last
        if held:
            yield convert(pa.Table.from_batches(held), part)[0]

    return dealt.mapInArrow(run, schema)


def _plain(data: bytes) -> bytes:
    """Without the escaping backslashes."""
    out, pieces = [], data.split(b"\\")
    out.append(pieces[0])
    i = 1
    while i < len(pieces):
        if pieces[i]:
            out.append(pieces[i])
            i += 1
        else:  # an escaped backslash: what follows the next one is literal
            out.append(b"\\" + (pieces[i + 1] if i + 1 < len(pieces) else b""))
            i += 2
    return b"".join(out)


def _find(data: bytes, needle: bytes, at: int) -> int:
    """Place of the next ``needle`` with an even number of backslashes before it."""
    while True:
        at = data.index(needle, at)
        slashes = at
        while slashes and data[slashes - 1] == 0x5C:
            slashes -= 1
        if (at - slashes) % 2 == 0:
            return at
        at += 1


def parse_turns(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation or part."""
    turns, at = [], 0
    while at < len(data):
        if data[at : at + len(OPEN)] != OPEN:
            raise ValueError("no turn begins here")
        colon = _find(data, CLOSE, at + len(OPEN))
        end = _find(data, END, colon + len(CLOSE))
        turns.append((_plain(data[at + len(OPEN) : colon]), _plain(data[colon + len(CLOSE) : end])))
        at = end + len(END)
    return turns


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Parts of a conversation follow each other in one partition, as format_conversations leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> dict:
            return {
                "conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3],
                "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5],
            }

        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
             ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        for batch in batches:
            for i in range(batch.num_rows):
                conv, part, data, lows, highs = (batch.column(c)[i].as_py() for c in ("conv_id", "part", "formatted", "loss_starts", "loss_ends"))
                if part == 0 or now is None or now[0] != conv:
                    if now:
                        rows.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_turns(data)
                now[1] += len(turns)
                for role, text in turns:
                    now[2].update(role + b"\n" + text + b"\n")
                for low, high in zip(lows, highs, strict=True):
                    text = _plain(data[low:high])
                    now[3] += len(text.decode())
                    now[4].update(text)
                now[5] += len(data.decode())
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
        if now:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
