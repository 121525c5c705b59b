"""Near-duplicate documents by bottom-k sketches of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

#: Values of a sketch that go into the inverted lists; values of the sketch that estimates.
LISTED, SKETCH = 24, 128
#: Chance at most with which two linked sets share fewer listed values than the lists ask for, and standard errors
#: below the threshold that the union-sketch estimate may lie (a chance of the same order).
MISS, ERRORS = 1e-9, 6


def overlap(percent: int) -> int:
    """Listed values that two sets at the threshold share but with a chance of MISS: a binomial tail.

    Of the LISTED smallest values of their union each is in both sets with the threshold's chance, and those are listed
    by both.
    """
    t, below = percent / 100, 0.0
    for shared in range(LISTED):
        below += math.comb(LISTED, shared) * t**shared * (1 - t) ** (LISTED - shared)
        if below > MISS:
            return max(shared, 1)
    return LISTED


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted 64-bit hashes of its distinct shingles of ``size`` words, as int64."""
    data, offsets = common.text_bytes(batch.column("text"))
    data = common.lower_ascii(data)
    starts, ends, row = common.words(data, offsets)
    word = common.span_hashes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
    step = np.uint64(0xD6E8FEB86659FD93)
    n = max(0, len(word) - size + 1)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = run * step + word[k : k + n]
    run = common.mix(run).view(np.int64)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            yield np.unique(run[a : b - size + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in word[a:b]:
                whole = whole * step + h
            yield common.mix(whole + np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, hash of the text, size and 128-bit digest of the shingle set, and its LISTED smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                sets = list(shingle_sets(part, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("of_text"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        _lists([s[:LISTED] for s in sets]),
                    ],
                    names=["doc_id", "of_text", "n", "fp", "listed"],
                )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of_text"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, of_text long, n long, fp binary, listed array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """nid, n, the whole shingle set in hash order and its SKETCH smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                sets = list(shingle_sets(part, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("nid"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _lists([s[:SKETCH] for s in sets]),
                        _lists(sets),
                    ],
                    names=["nid", "n", "sketch", "shingles"],
                )

    return docs.select("nid", "text").mapInArrow(run, "nid long, n long, sketch array<long>, shingles array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of an edge list of longs.

    Alternating large-star and small-star steps; each step is a minimum per node and a join, both on stored tables,
    so no component is ever gathered.
    """

    def least(table: DataFrame) -> DataFrame:
        return common.stored(table.groupBy("u").agg(F.min("v").alias("m")), "mins")

    low, high = F.least(a, b), F.greatest(a, b)
    now = common.stored(edges.select(high.alias("u"), low.alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        up = common.stored(up.where("u > v").distinct(), "edges")
        down = up.join(least(up), "u")
        stars = down.select("u", F.col("m").alias("v")).unionByName(
            down.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = common.stored(stars.distinct(), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = mark


def _near_in_size(x: str, y: str, percent: int) -> Column:
    return (F.least(x, y) * 100) >= (F.greatest(x, y) * percent)


def _may_link(sx: str, sy: str, nx: str, ny: str, percent: int) -> Column:
    """Union-sketch estimate: of the SKETCH smallest values of both sketches, the share found in both.

    The bar lies ERRORS standard errors (without replacement) below the threshold; an estimate over the whole union is
    exact and gets no slack.
    """
    union = F.slice(F.sort_array(F.array_union(sx, sy)), 1, SKETCH)
    k = F.size(union)
    share = F.size(F.array_intersect(F.array_intersect(sx, sy), union)) / k
    t = percent / 100
    part = F.greatest(F.lit(0.0), 1 - SKETCH * (1 + t) / (F.col(nx) + F.col(ny)))
    slack = F.when(k < SKETCH, 0.0).otherwise(ERRORS * F.sqrt(part * (t * (1 - t) / SKETCH)))
    return share >= t - slack - 1e-9


def _apart(rows: DataFrame) -> DataFrame:
    """The lists whose members do not all lie in one component."""
    return rows.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("v")


def _unshared(sets: DataFrame) -> DataFrame:
    """nid and ``u``: how many shingles of a set are in no other of the sets."""
    values = sets.select("nid", F.explode("shingles").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min("nid").alias("nid"))
    return values.where("c = 1").groupBy("nid").agg(F.count(F.lit(1)).alias("u"))


def _room(ux: str, uy: str, shared: Column, percent: int) -> Column:
    """Unshared shingles of both sides fit beside at most ``shared`` common ones at the threshold."""
    return (F.col(ux) + F.col(uy)) * percent <= shared * (100 - percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, estimated: bool) -> DataFrame:
    """Of the pairs (x, y) those whose full sets reach the threshold."""

    def side(name: str, column: str) -> DataFrame:
        return sets.select(F.col("nid").alias(name), F.col("n").alias(f"n{name}"), F.col(column).alias(f"s{name}"))

    if not estimated:
        near = pairs.join(side("x", "sketch"), "x").join(side("y", "sketch"), "y")
        near = near.where(_near_in_size("nx", "ny", percent)).where(_may_link("sx", "sy", "nx", "ny", percent))
        pairs = common.stored(near.select("x", "y"), "near")
    both = pairs.join(side("x", "shingles"), "x").join(side("y", "shingles"), "y")
    shared = F.size(F.array_intersect("sx", "sy")).cast("long")
    exact = both.withColumn("i", shared).where(F.col("i") * 100 >= (F.col("nx") + F.col("ny") - F.col("i")) * percent)
    return common.stored(exact.select(F.col("x").alias("a"), F.col("y").alias("b")), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """Per document doc_id, n_shingles, component_id, kept and of_text, the hash of its text.

    Two documents are linked when 100 * shared >= percent * all distinct shingles; a component's id is its smallest
    doc_id, and the row with that id is kept.

    1. Documents with the same shingle set become one class; only classes are compared.
    2. The LISTED smallest hashes of a class go into inverted lists. Values are ordered from rare to frequent, and a
       class enters only as many lists as two linked classes need to meet in one, so a passage that many documents
       share makes no pairs, while copies do.
    3. Shingles that no other candidate has bound what two classes can share. Every list compares its most central
       member, the one with fewest such shingles, with all members that this bound lets it link with; what that links
       is one component already, and for copies of one original that is nearly all. Only classes of a list that are
       still apart are then compared with each other, each pair in the first list they share, filtered by the same
       bound and by the union-sketch estimate inside the join.
    4. Full sets confirm every link.

    A link is missed only if the two sets share fewer than ``overlap`` listed values, or if the estimate errs by ERRORS
    standard errors: each about once in a thousand million pairs at the threshold. Sets whose partners are all listed
    whole (n * 100 <= LISTED * percent) have no such chance.

    A text without words has an empty set and stays alone. A null doc_id is never linked: its component_id is null
    and it is kept. Rows that repeat a doc_id with one text are all kept or all dropped with it; an id with several texts has a
    row, and links, for each. Other columns are
    ignored.
    """
    found = common.stored(sketch_documents(docs, shingle), "sketches")
    real = found.where("n > 0 and doc_id is not null")
    one = F.min(F.struct("doc_id", "of_text")).alias("one")
    classes = real.groupBy("fp").agg(one, F.first("n").alias("n"), F.first("listed").alias("listed"))
    classes = classes.select("fp", F.col("one.doc_id").alias("rep"), F.col("one.of_text").alias("of_text"), "n", "listed")
    classes = common.stored(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")

    posted = classes.select("nid", "n", F.explode("listed").alias("v"))
    counts = common.stored(posted.groupBy("v").count().where("count > 1"), "shared-values")
    shared = posted.join(counts, "v").groupBy("nid").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "v"))).alias("shared")
    )
    few = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    reach = F.when(F.col("n") * 100 <= LISTED * percent, few).otherwise(LISTED - overlap(percent) + 1)
    own = F.least("n", F.lit(LISTED)) - F.size("shared")
    lists = shared.withColumn("own", own).withColumn("take", (reach - own).cast("int")).where("take > 0")
    lists = common.stored(
        lists.select("nid", "n", "own", F.expr("slice(transform(shared, s -> s.v), 1, take)").alias("lists")), "lists"
    )

    members = lists.join(classes.select("nid", "rep", "of_text"), "nid").select("nid", "rep", "of_text")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64(text).alias("of_text"), text.alias("text"))
    sets = common.stored(full_sets(texts.join(members, ["rep", "of_text"]), shingle).dropDuplicates(["nid", "n"]), "sets")
    alone = common.stored(_unshared(sets), "unshared")
    central = lists.join(alone, "nid", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    in_list = common.stored(central.select("nid", "n", "u", F.explode("lists").alias("v")), "members")
    heads = in_list.groupBy("v").agg(F.min(F.struct("u", "nid")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    heads = common.stored(heads.select("v", F.col("head.nid").alias("x"), F.col("head.u").alias("low")), "heads")
    near = in_list.join(heads, "v").where(_room("u", "low", F.col("n") - F.col("u"), percent))
    near = common.stored(near, "near-members")
    stars = near.where("x <> nid").select("x", F.col("nid").alias("y")).distinct()
    links = _confirmed(stars, sets, percent, estimated=False)
    roots = common.stored(components(links), "roots")

    labelled = lists.join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    labelled = common.stored(labelled.withColumn("root", F.coalesce("root", "nid")), "labelled")
    rows = common.stored(near.join(labelled.select("nid", "root", "lists"), "nid"), "rooted-members")
    rows = rows.join(common.stored(_apart(rows), "apart"), "v").join(sets.select("nid", "sketch"), "nid")
    rows = common.stored(rows, "apart-members")
    left = rows.select("v", *[F.col(c).alias(f"{c}x") for c in ("nid", "n", "u", "root", "lists", "sketch")])
    right = rows.select("v", *[F.col(c).alias(f"{c}y") for c in ("nid", "n", "u", "root", "lists", "sketch")])
    meet = (
        (left["v"] == right["v"])
        & (F.col("nidx") < F.col("nidy"))
        & (F.col("rootx") != F.col("rooty"))
        & _near_in_size("nx", "ny", percent)
        & _room("ux", "uy", F.least(F.col("nx") - F.col("ux"), F.col("ny") - F.col("uy")), percent)
        & (F.element_at(F.array_intersect("listsx", "listsy"), 1) == left["v"])
        & _may_link("sketchx", "sketchy", "nx", "ny", percent)
    )
    rest = left.join(right, meet).select(F.col("nidx").alias("x"), F.col("nidy").alias("y"))
    more = _confirmed(common.stored(rest, "rest"), sets, percent, estimated=True)
    joined = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = common.stored(components(joined), "roots")

    placed = classes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    smallest = common.stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    ids = common.stored(placed.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "ids")
    alone = found.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), "of_text")
    out = real.join(ids, "fp").select("doc_id", "n", "component_id", "of_text").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "of_text")
