"""Quality rules on how a public tokeniser cuts a text."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Per language: least and most characters per token, most byte-fallback share, least token entropy in bits.
#: Wide on purpose: prose of 20 words or more in a language of the vocabulary lies well inside, names, numbers and
#: addresses included. ``None`` is for every other language.
BANDS: dict[str | None, tuple[float, float, float, float]] = {
    "en": (1.5, 8.0, 0.05, 4.2),
    "de": (1.4, 8.0, 0.05, 4.2),
    "fr": (1.3, 8.0, 0.05, 4.2),
    "es": (1.3, 8.0, 0.05, 4.2),
    None: (0.3, 10.0, 0.9, 3.0),
}

#: n tokens have at most log2(n) bits, so short texts need only this share of that: 3.0 bits at 20 tokens, 4.2 from 64 on.
SHARE_OF_MOST = 0.7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_loaded: dict[int, tuple] = {}

_COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"),
]


def _pieces(model: bytes) -> tuple:
    """The tokeniser and which of its ids are single bytes; loaded once per worker."""
    key = hash(model)
    if key not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        _loaded[key] = sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return _loaded[key]


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the row ranges of ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True for elements whose (row, key) occurs twice or more."""
    pair = common.mix(key ^ common.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(pair)
    ranked = pair[order]
    twin = np.zeros(len(pair), bool)
    if len(pair) > 1:
        same = ranked[1:] == ranked[:-1]
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
    return twin


def measure(text: pa.Array, model: bytes) -> list[pa.Array]:
    """The columns of _COLUMNS for each text."""
    sp, is_byte = _pieces(model)
    rows = len(text)
    data, offsets = common.text_bytes(text)
    starts, ends, row = common.words(data, offsets)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    n_words = np.diff(bounds)
    hashes = common.span_hashes(data, starts, ends)

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = _per_row(points[ends] - points[starts], bounds)
    symbols = _per_row(_SYMBOL[data], offsets)

    run = np.zeros(max(0, len(hashes) - 7), np.uint64)
    for k in range(8):
        run = run * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(run)]
    whole = np.flatnonzero(row[: len(run)] == row[7 : 7 + len(run)])
    twin = whole[_repeated(row[whole], run[whole])]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twin, 1)
    np.add.at(cover, twin + 8, -1)
    repeats = _per_row(np.cumsum(cover[:-1]) > 0, bounds)

    line_starts, line_ends, line_row = common.spans(data != 0x0A, offsets)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_row = line_row[filled]
    line = common.span_hashes(data, line_starts[filled], line_ends[filled])
    line = common.mix(line ^ common.mix(line_row.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(line, return_index=True)
    later = np.ones(len(line), np.int64)
    later[at] = 0
    dup_lines = _per_row(later, np.searchsorted(line_row, np.arange(rows + 1)))

    _, at, code = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    encoded = sp.encode([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in at], num_threads=1) if len(at) else []
    lengths = np.array([len(e) for e in encoded], np.int64)
    flat = np.array([t for e in encoded for t in e], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    fallback = _per_row(is_byte[flat], first) if len(flat) else np.zeros(len(at), np.int64)
    n_tokens, n_bytes = _per_row(lengths[code], bounds), _per_row(fallback[code], bounds)

    # entropy of the row's tokens: -sum(p log p) = log n - sum(c log c) / n
    per_word = lengths[code]
    begin = np.repeat(first[:-1][code] - np.concatenate([[0], np.cumsum(per_word)[:-1]]), per_word) if len(code) else np.zeros(0, np.int64)
    tokens = flat[begin + np.arange(len(begin))] if len(flat) else flat
    owner = np.repeat(row, per_word)
    pair, times = np.unique(owner * np.int64(1 << 20) + tokens, return_counts=True)
    spread = np.bincount(pair >> 20, weights=times * np.log2(times), minlength=rows) if len(pair) else np.zeros(rows)
    some = np.maximum(n_tokens, 1)
    entropy = np.where(n_tokens > 0, np.log2(some) - spread / some, 0.0)
    counts = [pa.array(c, pa.int64()) for c in (n_words, word_chars, symbols, dup_lines, repeats)]
    return counts + [pa.array(c, pa.float64()) for c in (word_chars / some, n_bytes / some, np.maximum(entropy, 0.0))]


def with_measures(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 4 << 20) -> DataFrame:
    """``docs`` with the measures of its text beside all its columns; a measure replaces a column of the same name."""
    model = Path(vocabulary).read_bytes()
    names = {n for n, _ in _COLUMNS}
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(n, T.LongType() if t == "long" else T.DoubleType()) for n, t in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", limit):
                text = pc.cast(part.column("text"), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *measure(text, model)], names=[*part.schema.names, *[n for n, _ in _COLUMNS]]
                )

    return docs.mapInArrow(run, schema)


def judge(measured: DataFrame, bands: dict[str | None, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Adds base_failed and kept: kept rows pass the base rules and lie in the bands of their ``lang``."""
    bands = bands or BANDS
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)

    tokens = F.greatest(F.round(F.try_divide(F.col("word_chars"), F.col("chars_per_token"))), F.lit(1.0))

    def inside(band: tuple[float, float, float, float]):
        low, high, share, entropy = band
        least = F.least(F.lit(float(entropy)), F.log2(tokens) * SHARE_OF_MOST)
        return F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= share) & (F.col("token_entropy") >= least)

    verdict = inside(bands[None])
    for lang, band in bands.items():
        if lang is not None:
            verdict = F.when(F.col("lang") == lang, inside(band)).otherwise(verdict)
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)


def quality(docs: DataFrame, vocabulary: str = VOCABULARY, bands=None) -> DataFrame:
    """Measures and verdict per document.

    Words are runs without the bytes 0x20 and 0x09 to 0x0D; the tokeniser sees every word once per batch. Base: fewer
    than 20 words, or over 30% of the words in 8-word windows found twice, fails. Method: characters per token,
    byte-fallback share and token entropy within the band of the document's language (null or unknown: the wide band);
    a short text needs SHARE_OF_MOST of the entropy its number of tokens allows, if that is less.
    A null or empty text has no words and fails. A ``docs`` without ``lang`` uses the wide band for all. Rows keep
    their number and columns; equal rows get equal verdicts.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    return judge(with_measures(docs, vocabulary), bands)
