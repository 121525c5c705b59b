"""How far the sources of a language are from each other and from the language in their use of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm import common

#: Documents of a language that a term needs; added to every count; unit of shares; most terms listed per group.
LEAST_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text split at once; counted (group, term) pairs a task holds before it hands them on.
PIECE_BYTES, HELD = 1 << 20, 400_000
#: Term counts of one comparison task; sources of a block; terms of a matrix.
TASK_CELLS, BLOCK, TERMS = 1 << 15, 256, 1024

# letters to lower case, every other ASCII byte to a blank, bytes of longer characters as they are
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text in lists of about ``piece`` bytes; a term is never cut."""
    clean = text.translate(_TABLE)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Per lang, source and term: n (occurrences) and docs (rows that hold it). A null term with n = 0 marks each group.

    A task adds up the counts of its documents per group and hands them on once it holds ``held`` pairs, so its memory
    is bounded by that and by the distinct terms of one text; Spark adds up what several tasks counted.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def rows(total: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in total.items():
            for first in range(0, len(n), 50_000):
                some = list(n)[first : first + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                        pa.array([t.decode() for t in some], pa.string()),
                        pa.array([n[t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64()),
                    ],
                    names=names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[Counter, Counter]] = {}
        groups, size = set(), 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text")
            for i, group in enumerate(zip(langs, sources, strict=True)):
                groups.add(group)
                own: Counter = Counter()
                for found in terms(texts[i].as_buffer().to_pybytes()):
                    own.update(found)
                if group not in total:
                    total[group] = Counter(), Counter()
                n, seen = total[group]
                size -= len(n)
                n.update(own)
                seen.update(own.keys())
                size += len(n)
                if size >= held:
                    yield from rows(total)
                    total, size = {}, 0
        yield from rows(total)
        if groups:
            marks = pa.table({"lang": [g[0] for g in groups], "source": [g[1] for g in groups]})
            marks = marks.append_column("term", pa.nulls(len(groups), pa.string()))
            zero = pa.array([0] * len(groups), pa.int64())
            yield from marks.append_column("n", zero).append_column("docs", zero).to_batches()

    parts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = parts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str, prior: int, unit: int) -> str:
    """Whole-number share of a count, in exact decimals."""
    return f"""(1L + (CAST({unit} AS DECIMAL(10,0)) * CAST({n} + {prior}L AS DECIMAL(20,0)))
        div CAST(CAST({total} AS DECIMAL(20,0)) + {prior} * CAST({kept} AS DECIMAL(17,0)) AS DECIMAL(22,0)))"""


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, prior: int = PRIOR, unit: int = UNIT, top: int = TOP, block: int = BLOCK, task_cells: int = TASK_CELLS) -> DataFrame:
    """lang, source, part, item, value and rank: distances of each (lang, source) group.

    A language keeps the terms found in at least ``least_docs`` of its documents (V terms). A group gives each kept term
    the share 1 + floor(unit * (n + prior) / (N + prior * V)); n are the term's occurrences, N those of all kept terms.
    Part ``pair`` sums, for each other source of the language, the differences of all kept terms' shares. Part ``term``
    lists the ``top`` terms whose share in the group exceeds the language's by most. Equal values rank by item (UTF-8).

    Only terms with a count are stored; the others have the same share in a group and are filled in where two blocks of
    sources are compared. A comparison takes ``block`` by ``block`` sources and one of the language's term buckets, so a
    frequent language is spread over many tasks and no task sees all terms or all sources.

    Null text, lang and source read as ''; a text without terms still counts its group; repeated rows count each; a
    language without kept terms has distances 0 and no terms; an empty table gives no rows; other columns are ignored.
    """
    cells = common.stored(term_counts(docs), "term-counts")
    groups = cells.where("term IS NULL").select("lang", "source")
    found = cells.where("term IS NOT NULL")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = common.stored(kept.select("lang", "term", "lang_n"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = common.stored(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    facts = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "used", "v", "lang_total"])
    zero = f"CASE WHEN v = 0 THEN 0L ELSE {_share('0L', 'total', 'v', prior, unit)} END AS none"
    facts = common.stored(facts.selectExpr("*", zero), "groups")
    shares = own.join(facts, ["lang", "source"]).selectExpr(
        "lang", "source", "term",
        f"{_share('n', 'total', 'v', prior, unit)} AS p", f"{_share('lang_n', 'lang_total', 'v', prior, unit)} AS q",
    )

    most = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    listed = shares.where("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", "p - q AS value")
    listed = listed.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= top)
    pairs = _pairs(shares, facts, block, task_cells).selectExpr("lang", "source", "'pair' AS part", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(most))
    return pairs.unionByName(listed)


def _pairs(shares: DataFrame, facts: DataFrame, block: int, task_cells: int) -> DataFrame:
    """Summed differences of any two sources of a language, in both directions."""
    plan = facts.groupBy("lang").agg(
        F.expr(f"CAST(ceil(count(*) / {block}D) AS INT)").alias("blocks"),
        F.expr(f"CAST(ceil(greatest(sum(used), 1L) / {task_cells}D) AS INT)").alias("buckets"),
        F.first("v").alias("kept"),
    )
    plan = common.stored(plan, "comparison-plan")
    mine = "pmod(xxhash64(source), blocks)"
    # each unordered pair of blocks once: a row joins every pair that its block is part of
    sides = f"""inline(transform(sequence(0, blocks - 1), other -> struct(
        CAST(least({mine}, other) AS INT) AS a, CAST(greatest({mine}, other) AS INT) AS b)))"""
    placed = facts.select("lang", "source", "none").join(plan, "lang").selectExpr(
        "lang", "source", "none", "blocks", "kept", f"CAST({mine} AS INT) AS own", "explode(sequence(0, buckets - 1)) AS bucket"
    ).selectExpr("lang", "source", "own", "none", "bucket", "CAST(NULL AS STRING) AS term", "0L AS p", "CASE WHEN bucket = 0 THEN kept ELSE 0L END AS kept", sides)
    counted = shares.join(plan, "lang").selectExpr(
        "lang", "source", "blocks", f"CAST({mine} AS INT) AS own", "CAST(pmod(xxhash64(term, 7), buckets) AS INT) AS bucket", "term", "p"
    ).selectExpr("lang", "source", "own", "0L AS none", "bucket", "term", "p", "0L AS kept", sides)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        lang, a, b = key[0].as_py(), key[1].as_py(), key[2].as_py()
        is_source = group.column("term").is_null().to_numpy()
        who = group.filter(pa.array(is_source)).sort_by("source")
        names, own, none = who.column("source").to_pylist(), who.column("own").to_numpy(), who.column("none").to_numpy()
        cells = group.filter(pa.array(~is_source))
        source = pc.index_in(cells.column("source").combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        code = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        p = cells.column("p").to_numpy()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        # terms that no source of the two blocks holds differ by what the sources give to a missing term
        gap = np.abs(none[left][:, None] - none[right][None, :])
        n_terms = int(code.max()) + 1 if len(code) else 0
        total = gap * (int(who.column("kept").to_numpy().max(initial=0)) - n_terms)
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(0, n_terms + TERMS, TERMS))
        for i, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            width = min(TERMS, n_terms - i * TERMS)
            matrix = np.repeat(none[:, None], width, 1)
            at = order[start:end]
            matrix[source[at], code[at] - i * TERMS] = p[at]
            for row, x in enumerate(left):
                total[row] += np.abs(matrix[right] - matrix[x]).sum(1)
        one, two = np.repeat(left, len(right)), np.tile(right, len(left))
        value = total.reshape(-1)
        ok = one != two if a == b else np.ones(len(one), bool)
        one, two, value = one[ok], two[ok], value[ok]
        if a != b:
            one, two, value = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([value, value])
        text = pa.array(names, pa.string())
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": text.take(pa.array(one)), "item": text.take(pa.array(two)), "value": pa.array(value, pa.int64())})

    columns = ["lang", "a", "b", "bucket", "source", "own", "none", "term", "p", "kept"]
    both = placed.select(*columns).unionByName(counted.select(*columns))
    sums = both.groupBy("lang", "a", "b", "bucket").applyInArrow(compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
