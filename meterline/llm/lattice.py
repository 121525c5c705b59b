"""Language-model scores: marginal probability of a text over all its cuts into vocabulary pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of re-estimation; mass taken from each seen word for unseen ones; bytes of text in a block.
ROUNDS, DISCOUNT, BLOCK_BYTES = 3, 0.5, 12 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BITS = 21


class Pieces:
    """Byte strings of the public vocabulary with their log probabilities; a leading blank marks a word's start.

    Pieces with a blank elsewhere and control pieces are left out. The vocabulary's own scores rank the pieces; the
    first estimate gives a piece of rank r a probability in proportion to 1 / (r + 10). Every byte is a piece too.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        known: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and b" " not in piece[1:]:
                known[piece] = max(sp.get_score(i), known.get(piece, -1e9))
        for byte in range(256):
            known.setdefault(bytes([byte]), -1e6)
        self.text = sorted(known, key=lambda p: (-known[p], p))
        rank = np.arange(len(self.text))
        self.start = np.array([p[:1] == b" " for p in self.text])
        self.logp = -np.log(rank + 10.0) - np.log((1 / (rank + 10.0)).sum())
        self.lengths = sorted({len(p) for p in self.text})
        keys = np.array([_spell(p) for p in self.text], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int64)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[keys >> np.uint64(64 - _BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashed byte strings, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        may = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
        same = self.keys[at] == hashes[may]
        out[may[same]] = self.ids[at[same]]
        return out


def _finish(raw: np.ndarray, length: int) -> np.ndarray:
    return common.mix(raw + np.uint64(length * 0x51ED270B7F4A7C1))


def _spell(piece: bytes) -> int:
    raw = np.zeros(1, np.uint64)
    for b in piece:
        raw = raw * _STEP + np.uint64(b + 1)
    return int(_finish(raw, len(piece))[0])


class Lattice:
    """All pieces in a list of words. Node i is the place before byte i of the words laid end to end, each with its
    leading blank and one closing node."""

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        size = np.array([len(w) + 1 for w in words], np.int64)
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        data = np.frombuffer(b"".join(b" " + w + b"\n" for w in words), np.uint8)
        depth = np.arange(len(data)) - np.repeat(self.first, size + 1)
        left = np.repeat(size, size + 1) - depth
        code = data.astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero(left > 0)
        begin, piece, length = [], [], []
        raw = np.zeros(len(at), np.uint64)
        for n in range(1, pieces.lengths[-1] + 1):
            keep = left[at] >= n
            at, raw = at[keep], raw[keep]
            if not len(at):
                break
            raw = raw * _STEP + code[at + n - 1]
            found = pieces.find(_finish(raw, n))
            hit = np.flatnonzero(found >= 0)
            # only a piece with a blank can begin a word, and no other can hold one
            begin.append(at[hit])
            piece.append(found[hit])
            length.append(np.full(len(hit), n))
        begin, piece, length = map(np.concatenate, (begin, piece, length))
        end = begin + length
        order = np.lexsort((end, depth[end]))
        self.begin, self.end, self.piece = begin[order], end[order], piece[order]
        self.depth, self.nodes = depth, len(data)

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log sum over all piece sequences from a word's start to each node."""
        return self._sweep(logp, self.first, self.begin, self.end, self.depth[self.end])

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """Log sum over all piece sequences from each node to its word's end."""
        rest = np.repeat(self.last - self.first, self.last - self.first + 1) - self.depth
        order = np.lexsort((self.begin, rest[self.begin]))
        return self._sweep(logp, self.last, self.end, self.begin, rest[self.begin], order)

    def _sweep(self, logp, source, tail, head, level, order=None) -> np.ndarray:
        """Log-space recursion over levels: every arc adds to its head once its tail is complete."""
        out = np.full(self.nodes, -np.inf)
        out[source] = 0.0
        weight, tail, head, level = (x if order is None else x[order] for x in (logp[self.piece], tail, head, level))
        cuts = np.flatnonzero(np.diff(level)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(level)], strict=True):
            value, to = out[tail[a:b]] + weight[a:b], head[a:b]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            top = np.maximum.reduceat(value, starts)
            safe = np.where(np.isfinite(top), top, 0.0)
            width = np.diff(np.append(starts, b - a))
            with np.errstate(divide="ignore"):
                out[to[starts]] = safe + np.log(np.add.reduceat(np.exp(value - np.repeat(safe, width)), starts))
        return out

    def marginals(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.last]

    def expected(self, logp: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, each word counting once."""
        ahead, behind = self.forward(logp), self.backward(logp)
        total = np.repeat(ahead[self.last], self.last - self.first + 1)
        share = np.exp(ahead[self.begin] + logp[self.piece] + behind[self.end] - total[self.end])
        return np.bincount(self.piece, share, minlength=len(logp))


_loaded: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _batches(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words of about ``limit`` bytes, with the index of the first."""
    held, size, first = [], 0, 0
    for i, word in enumerate(column.to_pylist()):
        held.append(word.encode())
        size += len(word)
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number and, by number, the place where it first occurs. Numbers follow first occurrence."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del ranked
    at = order[new]
    place = np.argsort(at)
    number = np.empty(len(at), np.uint32)
    number[place] = np.arange(len(at), dtype=np.uint32)
    code = np.empty(len(order), "<u4")
    code[order] = number[np.cumsum(new) - 1]
    return code, at[place]


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data``, which rise and do not overlap, as strings; no Python object per word."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    text = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(text))


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block of documents: their ids, word bounds, words as numbers, the distinct words, and how often each
    occurs in training documents. Everything about a block is bounded by its size in text (one document at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.slices(batch, "text", block_bytes):
                data, offsets = common.text_bytes(part.column("text"))
                data = common.lower_ascii(data)
                starts, ends, row = common.words(data, offsets)
                held = part.column("held_out").to_numpy(zero_copy_only=False)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                code, at = _numbered(common.span_hashes(data, starts, ends))
                train = np.bincount(code[~held[row]], minlength=len(at))
                del row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), _one_list(part.column("doc_id")), _one_list(part.column("held_out")),
                        _one_list(pa.array(bounds, pa.int64())), pa.array([zlib.compress(code.tobytes(), 1)], pa.binary()),
                        _one_list(_cut(data, starts[at], ends[at])), _one_list(pa.array(train, pa.int64())),
                    ],
                    names=["block", "doc_ids", "held", "bounds", "codes", "words", "train"],
                )
                number += 1

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(
        run,
        "block long, doc_ids array<long>, held array<boolean>, bounds array<long>, codes binary, words array<string>, train array<long>",
    )


def fit_pieces(words: DataFrame, model: bytes, rounds: int) -> np.ndarray:
    """Log probabilities of the pieces after ``rounds`` of expectation maximisation over all seen words.

    Each distinct word counts once. What comes to the driver is one number per piece of the vocabulary.
    """
    pieces = _pieces(model)
    logp = pieces.logp
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            own = _pieces(model)
            total = np.zeros(len(logp))
            for batch in batches:
                for _, held in _batches(batch.column("word")):
                    total += Lattice(held, own).expected(logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        sums = words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(logp))
        for piece, value in sums.collect():
            uses[piece] = value
        if not uses.any():
            break
        # no piece ever drops out: a thousandth of a use each
        logp = np.log(uses + 1e-3) - np.log((uses + 1e-3).sum())
    return logp


def score_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    A text is its lower-cased words and one end. Training documents (crc32 of the doc_id's text, modulo 5, is not 1)
    give every word its count. A word's probability is (count - discount) / N if it was seen, plus the mass so freed
    times the marginal probability of the word's spelling: the sum over all ways to cut it into pieces of the public
    vocabulary, by a log-space forward recursion over the lattice of pieces. Piece probabilities start from the
    vocabulary's own scores and are re-estimated on all distinct training words. Spellings are normalised by the mass
    of word-starting and of following pieces, so that the probabilities of all words and the end sum to one.

    Words are counted per block of documents, then over all blocks; a word's scores are computed once, go back to the
    blocks that hold it by joins, and documents are summed inside their block. The most frequent word has one row per
    block.

    A null or empty text has only its end; a null doc_id counts as an empty id text; repeated rows count each; without
    training documents only spelling counts; an empty table gives no rows; other columns are ignored.
    """
    model = Path(vocabulary).read_bytes()
    blocks = common.stored(_blocks(docs, block_bytes), "blocks")
    parts = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("code", "w"))
    parts = parts.select("block", "code", F.col("w.words").alias("word"), F.col("w.train").alias("train"))
    counts = common.stored(parts.groupBy("word").agg(F.sum("train").alias("c")), "counts")
    seen = counts.where("c > 0")
    types, tokens = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n, v = tokens + ends, types + (ends > 0)
    logp = fit_pieces(seen, model, rounds)
    pieces = _pieces(model)
    follow = float(np.exp(logp[~pieces.start]).sum())
    begin = float(np.exp(logp[pieces.start]).sum())
    shape = float(np.log(max(1 - follow, 1e-300)) - np.log(begin))
    freed = discount * v / n if n else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model)
        for batch in batches:
            spelled = np.zeros(batch.num_rows)
            for first, held in _batches(batch.column("word")):
                spelled[first : first + len(held)] = Lattice(held, own).marginals(logp)
            c = batch.column("c").to_numpy()
            direct = np.maximum(c - discount, 0) / max(n, 1)
            with np.errstate(divide="ignore"):
                score = np.logaddexp(np.log(direct), np.log(freed) + shape + spelled) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(score)], names=["word", "c", "score"])

    scored = common.stored(counts.mapInArrow(run, "word string, c long, score double"), "word-scores")
    placed = parts.select("block", "code", "word").join(scored, "word").select("block", F.struct("code", "c", "score").alias("w"))
    tables = placed.groupBy("block").agg(F.collect_list("w").alias("table"))
    whole = blocks.select("block", "doc_ids", "held", "bounds", "codes").join(tables, "block", "left")
    end_score = float(np.log10((ends - discount) / n)) if ends else float(np.log10(0.5))
    floor = n + 0.5 * (v + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].values
                bounds = batch.column("bounds")[i].values.to_numpy()
                codes = np.frombuffer(zlib.decompress(batch.column("codes")[i].as_buffer()), "<u4")
                table = batch.column("table")[i]
                size = len(table) if table.is_valid else 0
                c, lp = np.zeros(size), np.zeros(size)
                if size:
                    code = table.values.field("code").to_numpy()
                    c[code], lp[code] = table.values.field("c").to_numpy(), table.values.field("score").to_numpy()
                base = np.log10((c + 0.5) / floor)

                def per_doc(values: np.ndarray, end: float, codes=codes, bounds=bounds) -> np.ndarray:
                    # summed document by document: a running total over the block would cost digits
                    out = np.zeros(len(bounds) - 1)
                    full = np.flatnonzero(np.diff(bounds))
                    if len(full):
                        out[full] = np.add.reduceat(values[codes], bounds[:-1][full])
                    return out + end

                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        batch.column("held")[i].values,
                        pa.array(np.diff(bounds) + 1, pa.int64()),
                        pa.array(per_doc((c > 0).astype(float), float(ends > 0)).astype(np.int64)),
                        pa.array(np.full(len(ids), n), pa.int64()),
                        pa.array(per_doc(base, float(np.log10((ends + 0.5) / floor)))),
                        pa.array(per_doc(lp, end_score)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return whole.mapInArrow(
        sums, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
