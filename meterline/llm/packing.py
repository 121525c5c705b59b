"""Token ids packed into rows of one length: best-fit decreasing with a segment tree of free space."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before the merges (fixed value of the rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
#: Bytes of text that are packed together.
GROUP_BYTES = 16 << 20
#: Tokens that a task holds at once; a group of that many bytes has no more.
HELD_TOKENS = GROUP_BYTES

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_loaded: dict[int, object] = {}


def _encoding(ranks: bytes):
    key = hash(ranks)
    if key not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def token_ids(text: pa.Array, ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the bounds of each text.

    The pattern always splits before a blank that a non-space follows, so texts are cut there and every distinct
    cut is encoded once.
    """
    encoding = _encoding(ranks)
    data, offsets = common.text_bytes(text)
    if not len(data):
        return np.zeros(0, np.uint16), np.zeros(len(text) + 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    # bytes that may begin a space beyond ASCII count as spaces: no cut there, which only makes a piece longer
    cut[:-2] = (data[:-1] == 0x20) & ~_SPACES[data[1:]]
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    starts, ends = bounds[:-1], bounds[1:]
    row = np.searchsorted(offsets, starts, side="right") - 1
    _, at, code = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    encoded = [encoding.encode_ordinary(raw[starts[i] : ends[i]].decode("utf-8", "replace")) for i in at]
    lengths = np.array([len(e) for e in encoded], np.int64)
    flat = np.array([t for e in encoded for t in e], np.uint16 if encoding.n_vocab <= 1 << 16 else np.uint32)
    first = np.cumsum(lengths) - lengths
    times = lengths[code]
    begin = np.repeat(first[code] - (np.cumsum(times) - times), times)
    ids = flat[begin + np.arange(len(begin))]
    per_row = np.bincount(row, weights=times, minlength=len(text)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per_row)])


class FreeSpace:
    """Open rows by free space: a segment tree of counts finds the smallest sufficient space in log(length) steps."""

    def __init__(self, length: int) -> None:
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._count(space, 1)

    def _count(self, space: int, by: int) -> None:
        at = space + self.width
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Space and number of the row with the least free space of at least ``need``, or None."""
        at = need + self.width
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        space = at - self.width
        self._count(space, -1)
        return space, self.rows[space].pop()


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers: pieces from long to short, each into the fullest row that has room for it."""
    free, rows = FreeSpace(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        place = free.take(size)
        if place is None:
            place = (length, len(rows))
            rows.append([])
        rows[place[1]].append(piece)
        if place[0] > size:
            free.add(place[0] - size, place[1])
    return rows


def pieces(docs: DataFrame, ranks_file: str = RANKS, length: int = LENGTH) -> DataFrame:
    """doc_id, part, first token, n_tokens and ids (little endian) of every document, cut every ``length`` tokens."""
    ranks = Path(ranks_file).read_bytes()
    width = 2 if len(ranks.splitlines()) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                ids, bounds = token_ids(part.column("text"), ranks)
                raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
                counts = -(-np.diff(bounds) // length)
                row = np.repeat(np.arange(part.num_rows), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = bounds[row] + number * length
                size = np.minimum(begin + length, bounds[row + 1]) - begin
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(number, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([raw[b * width : (b + s) * width] for b, s in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "part", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part long, n_tokens long, ids binary")


def _matrix(group: int, table: pa.Table, length: int, pad: int, width: int) -> pa.RecordBatch:
    """One group's pieces as packed rows."""
    kind = "<u2" if width == 2 else "<u4"
    sizes = table.column("n_tokens").to_numpy()
    doc, part = table.column("doc_id").to_pylist(), table.column("part").to_pylist()
    ids = table.column("ids").to_pylist()
    packed = best_fit(sizes, length)
    matrix = np.full((len(packed), length), pad, kind)
    resets = np.zeros((len(packed), length), "<u2" if length <= 1 << 16 else "<u4")
    bounds = []
    for r, row in enumerate(packed):
        at = [0]
        for p in row:
            begin, end = at[-1], at[-1] + int(sizes[p])
            matrix[r, begin:end] = np.frombuffer(ids[p], kind)
            resets[r, begin:end] = np.arange(end - begin)
            at.append(end)
        bounds.append(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(packed), group), pa.int64()),
            pa.array(range(len(packed)), pa.int64()),
            pa.array([at[-1] for at in bounds], pa.int64()),
            pa.array([m.tobytes() for m in matrix], pa.binary()),
            pa.array([m.tobytes() for m in resets], pa.binary()),
            pa.array(bounds, pa.list_(pa.int64())),
            pa.array([[doc[p] for p in row] for row in packed], pa.list_(pa.int64())),
            pa.array([[part[p] for p in row] for row in packed], pa.list_(pa.int64())),
        ],
        names=["pack_group", "pack_row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "parts"],
    )


def _bounded(group: int, held: list[pa.RecordBatch], first: int, *form) -> pa.RecordBatch:
    packed = _matrix(group, pa.Table.from_batches(held), *form)
    rows = pa.array(range(first, first + packed.num_rows), pa.int64())
    return packed.set_column(1, "pack_row", rows)


def pack(docs: DataFrame, ranks_file: str = RANKS, length: int = LENGTH, group_bytes: int = GROUP_BYTES, pad: int = 0) -> DataFrame:
    """Packed rows: pack_group, pack_row, n_tokens, input_ids, position_ids, cu_seqlens, doc_ids, parts.

    ``input_ids`` and ``position_ids`` are rows of a matrix of ``length`` little-endian unsigned numbers (16 bits where
    they suffice); positions begin anew at each bound in ``cu_seqlens``, whose last entry is the number of tokens before
    the padding. A document longer than a row is cut every ``length`` tokens; doc_ids and parts name each
    segment, so all ids can be put together again. Groups of about ``group_bytes`` of text are drawn by hash of
    (doc_id, part, tokens) and packed one by one, best fit decreasing: a hot source, a huge document or an id with many
    texts spreads over groups, and equal inputs give equal rows. Of a group that repeats of one row make larger, at most
    about HELD_TOKENS tokens are held and packed at a time.

    Null and empty texts have no tokens and no segment; repeated rows are packed each; a null doc_id is carried
    as null; an empty table gives no rows; other columns are ignored.
    """
    width = 2 if len(Path(ranks_file).read_bytes().splitlines()) <= 1 << 16 else 4
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = max(-(-size // group_bytes), common.partitions(docs.sparkSession))
    cut = pieces(docs, ranks_file, length)
    cut = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "part", "ids"), F.lit(groups)))
    dealt = cut.repartition(groups, "pack_group").sortWithinPartitions(
        "pack_group", F.desc("n_tokens"), "doc_id", "part", F.xxhash64("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, tokens, first = [], None, 0, 0
        for batch in batches:
            group = batch.column("pack_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and (group[a] != now or tokens >= HELD_TOKENS):
                    packed = _bounded(now, held, first, length, pad, width)
                    yield packed
                    first = first + packed.num_rows if group[a] == now else 0
                    held, tokens = [], 0
                now = int(group[a])
                held.append(batch.slice(a, b - a))
                tokens += pc.sum(held[-1].column("n_tokens")).as_py()
        if held:
            yield _bounded(now, held, first, length, pad, width)

    schema = (
        "pack_group long, pack_row long, n_tokens long, input_ids binary, position_ids binary, "
        "cu_seqlens array<long>, doc_ids array<long>, parts array<long>"
    )
    return dealt.mapInArrow(run, schema)
