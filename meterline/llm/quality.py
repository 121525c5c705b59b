"""Text quality by positive-unlabelled learning: trusted good texts against all texts, some of which are good too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

#: Most bins of a measure, ridge per trusted text, bytes of text measured at once, confidence of the prior's bound.
BINS, RIDGE, BLOCK_BYTES, DELTA = 8, 5.0, 4 << 20, 0.1
#: Steps of the scale that scores are counted on for the class prior.
STEPS = 2000

_KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>",
    "stop": b".,;:!?'\"()-", "other": b"@/\\_+=~^`{}[]", "line": b"\n",
}
_OF_BYTE = np.full(256, len(_KINDS), np.int64)
for _i, _chars in enumerate(_KINDS.values()):
    _OF_BYTE[list(_chars)] = _i
_OF_BYTE[0x20] = len(_KINDS) + 1
_END = np.zeros(256, bool)
_END[list(b".,;:!?")] = True

#: What is measured of a text, each on a fixed scale of 0 to 255. Nothing but the text goes in.
MEASURES = [
    "words", "chars_per_word", "spread_of_word", "short_words", "long_words", "ended_words", "bare_words", "symbol_words", "distinct_words",
    "distinct_triples", "repeated_eights", "repeated_lines", "words_per_line", "words_per_end", *[f"share_{k}" for k in _KINDS], "share_rest",
]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on a scale that keeps small ones apart; 0 of 0 is 0."""
    return np.cbrt(np.clip(part / np.maximum(whole, 1), 0, 1))


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct keys; per element whether its key occurs again in its row."""
    if not len(row):
        return np.zeros(rows), np.zeros(0, bool)
    order = np.lexsort((key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    again = np.zeros(len(row), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return np.bincount(row[order][np.concatenate([[True], ~same])], minlength=rows).astype(float), again


def _windows(row: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of runs of ``width`` words inside a row."""
    n = max(len(row) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = common.mix(total + key[i : i + n])
    start = np.flatnonzero(row[:n] == row[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    return start, total[start]


def measure(text: pa.Array) -> np.ndarray:
    """Rows of MEASURES as bytes."""
    rows = len(text)
    data, offsets = common.text_bytes(text)
    size = np.diff(offsets).astype(float)
    starts, ends, row = common.words(data, offsets)
    key = common.span_hashes(common.lower_ascii(data), starts, ends)
    n = np.bincount(row, minlength=rows).astype(float)
    width = (ends - starts).astype(float)
    mean = _per_row(width, row, rows) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(_per_row(width**2, row, rows) / np.maximum(n, 1) - mean**2, 0))
    kind = _OF_BYTE[data]
    at = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(at * (len(_KINDS) + 2) + kind, minlength=rows * (len(_KINDS) + 2)).reshape(rows, -1)
    bare = np.concatenate([[0], np.cumsum((kind <= 2) | (data >= 128))])
    symbol = np.concatenate([[0], np.cumsum(kind == 3)])
    distinct, _ = _distinct(row, key, rows)
    start, triple = _windows(row, key, 3)
    triples, _ = _distinct(row[start], triple, rows)
    n_triples = np.bincount(row[start], minlength=rows)
    start, eight = _windows(row, key, 8)
    _, again = _distinct(row[start], eight, rows)
    covered = np.zeros(len(row) + 1, np.int64)
    np.add.at(covered, start[again], 1)
    np.add.at(covered, start[again] + 8, -1)
    covered = np.cumsum(covered[:-1]) > 0
    first, last, line_row = common.spans(data != 0x0A, offsets)
    line_key = common.span_hashes(data, first, last)
    _, line_again = _distinct(line_row, line_key, rows)
    n_lines = np.bincount(line_row, minlength=rows)
    ended = _END[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    n_ends = _per_row(ended, row, rows)
    scaled = [
        np.log1p(n) / 14, mean / 24, spread / 16, _share(_per_row(width <= 3, row, rows), n), _share(_per_row(width >= 12, row, rows), n),
        _share(n_ends, n), _share(_per_row(bare[ends] == bare[starts], row, rows), n),
        _share(_per_row(symbol[ends] > symbol[starts], row, rows), n),
        np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9) * (n > 0), triples / np.maximum(n_triples, 1),
        _share(_per_row(covered, row, rows), n), _share(_per_row(line_again, line_row, rows), n_lines),
        np.log1p(n / np.maximum(n_lines, 1)) / 10, np.log1p(n / np.maximum(n_ends, 1)) / 10,
        *[_share(kinds[:, i], size) for i in range(len(_KINDS) + 1)],
    ]
    return np.rint(np.clip(np.stack(scaled, 1), 0, 1) * 255).astype(np.uint8)


@dataclass
class Model:
    """A score that adds one weight per measure. ``bins`` maps each measure's 256 steps to columns of the weights."""

    bins: np.ndarray
    weights: np.ndarray
    prior: float

    def raw(self, measured: np.ndarray) -> np.ndarray:
        return _lookup(self.bins, self.weights, measured)

    def score(self, measured: np.ndarray) -> np.ndarray:
        """With squared loss the least risk is at 2 * P(good) - 1."""
        return np.clip((self.raw(measured) + 1) / 2, 0, 1)


def _lookup(bins: np.ndarray, weights: np.ndarray, measured: np.ndarray) -> np.ndarray:
    per_step = weights[bins]
    out = np.full(len(measured), weights[0])
    for i in range(len(bins)):
        out += per_step[i, measured[:, i]]
    return out


def cut_bins(histogram: np.ndarray, most: int) -> np.ndarray:
    """Column of each measure's step: up to ``most`` bins of about equal numbers of texts. Column 0 is the constant."""
    out, column = np.zeros(histogram.shape, np.int64), 1
    for i, counts in enumerate(histogram):
        before = np.cumsum(counts) - counts
        level = np.minimum(before * most // max(counts.sum(), 1), most - 1)
        _, number = np.unique(level, return_inverse=True)
        out[i] = column + number
        column += number.max() + 1
    return out


def least_risk(positive: np.ndarray, every: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """Weights of least non-negative risk, from the counts of columns that occur together in trusted and in all texts.

    With the loss (1 - yz)^2 / 4 both sides of ``prior * R+ + max(0, Ru- - prior * Rp-)`` are quadratic in the weights and
    convex, so the least value is at the minimum of one side or where a mix of both is least and they are equal.
    """
    n_p, n_u = positive[0, 0], every[0, 0]
    mean_p, square_p, mean_u, square_u = positive[0] / n_p, positive / n_p, every[0] / n_u, every / n_u
    weight = np.full(len(mean_p), ridge / min(n_p, n_u))
    weight[0] = 1e-9

    def risks(w: np.ndarray) -> tuple[float, float]:
        plus = (1 - 2 * w @ mean_p + w @ square_p @ w) / 4
        minus = (1 + 2 * w @ mean_p + w @ square_p @ w) / 4
        rest = (1 + 2 * w @ mean_u + w @ square_u @ w) / 4
        return prior * plus, rest - prior * minus

    def solve(share: float) -> np.ndarray:
        """Least of prior * R+ + share * (Ru- - prior * Rp-) + ridge."""
        square = prior * (1 - share) * square_p + share * square_u
        return np.linalg.solve(square + np.diag(4 * weight), prior * (1 + share) * mean_p - share * mean_u)

    w = solve(1.0)
    if risks(w)[1] >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(50):
        share = (low + high) / 2
        w = solve(share)
        low, high = (share, high) if risks(w)[1] >= 0 else (low, share)
    return w


def class_prior(positive: np.ndarray, every: np.ndarray, delta: float = DELTA) -> float:
    """Share of good texts among all: the least ratio of all to trusted texts above a score, with a bound on its error.

    Above a high score nearly all texts are good, and trusted texts are good ones, so the share of all texts there is the
    prior times the share of trusted ones. Counts per score step come in rising order.
    """
    n_p, n_u = positive.sum(), every.sum()
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(every[::-1]) / n_u
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    ok = above_p > 0
    best = int(np.argmin((above_u[ok] + slack) / above_p[ok]))
    return float(np.clip(above_u[ok][best] / above_p[ok][best], 0.01, 0.99))


# -- learning over all texts -------------------------------------------------------------------------


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the bytes of MEASURES of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", BLOCK_BYTES):
                rows = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "measures"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, measures binary")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("measures").to_pylist()), np.uint8).reshape(-1, len(MEASURES))


def _counted(rows: DataFrame, count, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of ``count(measures, fold)``, a table of whole numbers of a fixed shape.

    Tasks hand on the numbers that are not 0, Spark adds them up, and only the table comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(_matrix(batch), batch.column("fold").to_numpy())
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for at, n in rows.select("measures", "fold").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(shape)


def fit(rows: DataFrame, bins: int = BINS, ridge: float = RIDGE) -> Model | None:
    """Model of ``measures`` with ``fold``: -1 for unlabelled texts, 0 or 1 for trusted ones. None without both folds.

    All texts count as unlabelled, trusted ones too. Every pass adds up whole numbers over all rows, so nothing depends on
    their order: the measures' steps, the columns that occur together, and the scores that the prior is read from. For
    the prior, each half of the trusted texts is scored by what the other half teaches.
    """
    steps = _counted(rows, lambda m, _f: np.stack([np.bincount(c, minlength=256) for c in m.T]), (len(MEASURES), 256))
    columns = cut_bins(steps, bins)
    width = int(columns.max()) + 1

    def together(m: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((3, width, width), np.int64)
        for a in range(0, len(m), 4096):
            held = np.zeros((len(m[a : a + 4096]), width), np.float32)
            held[:, 0] = 1
            for i, of_step in enumerate(columns):
                held[np.arange(len(held)), of_step[m[a : a + 4096, i]]] = 1
            for i in range(3):
                some = held if i == 2 else held[fold[a : a + 4096] == i]
                out[i] += np.rint(some.T @ some).astype(np.int64)
        return out

    sums = _counted(rows, together, (3, width, width)).astype(float)
    every, halves = sums[2], sums[:2]
    if not (halves[0, 0, 0] and halves[1, 0, 0]):
        return None
    models = [Model(columns, least_risk(half, every, 0.5, ridge), 0.5) for half in halves]

    def scored(m: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 2, STEPS), np.int64)
        for i, model in enumerate(models):
            step = np.clip((model.raw(m) + 2) / 4 * STEPS, 0, STEPS - 1).astype(np.int64)
            out[i, 0] = np.bincount(step[fold == 1 - i], minlength=STEPS)
            out[i, 1] = np.bincount(step, minlength=STEPS)
        return out

    prior = float(np.mean([class_prior(p, u) for p, u in _counted(rows, scored, (2, 2, STEPS))]))
    return Model(columns, least_risk(halves.sum(0), every, prior, ridge), prior)


def score_documents(docs: DataFrame, trusted: DataFrame, bins: int = BINS, ridge: float = RIDGE) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every document; ``trusted`` holds doc_ids of known good ones.

    Learning takes no bad texts: it minimises the non-negative unbiased risk of trusted texts against all texts, given the
    share of good texts among all, which is estimated too. A text's measures are counts of its characters, words, lines
    and repetitions, cut into bins of equal numbers of texts, and its score adds one weight per bin.

    Null and empty texts are scored like any text, by measures of 0; a null doc_id is scored and never trusted; repeated
    rows count and are scored each; without two trusted texts every score is 0.5; an empty table gives no rows; other
    columns are ignored.
    """
    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    rows = measured(docs).join(known, "doc_id", "left").select("doc_id", "measures", F.coalesce("half", F.lit(-1)).alias("fold"))
    rows = common.stored(rows, "measures")
    model = fit(rows, bins, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.select("doc_id", "measures").mapInArrow(run, "doc_id long, score double, predicted int")
