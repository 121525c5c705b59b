import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from meterline.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: (len(x), find(i)) for i, x in sets}


def check(docs, rows, percent):
    found = minhash.near_duplicates(docs, percent).collect()
    assert len(found) == len(rows)
    want = brute(rows, percent)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    groups = defaultdict(set)
    for i, (_, c) in want.items():
        groups[c].add(i)
    assert max(map(len, groups.values())) > 20


def test_equals_brute_force(docs, rows):
    check(docs, rows, 85)


def test_other_threshold_and_extra_columns(docs, rows):
    extra = docs.select("*", *[F.lit(1).alias(c) for c in ("nid", "n", "fp", "v", "rep", "component_id", "kept")])
    check(extra, rows, 80)


def test_empty_table(none):
    assert minhash.near_duplicates(none).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_an_id_with_several_texts_links_each(spark):
    words = [f"w{i}" for i in range(61)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(61))
    near_a, near_b = " ".join([*words[:-1], "other"]), b.replace("v60", "other")
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (1, a), (4, near_b), (4, "alone with four words here")]
    for percent in (80, 85):
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == sorted(
            [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True)]
        )


def test_overlap_is_the_largest_within_the_tail():
    for percent in (50, 80, 85, 95):
        t, o = percent / 100, minhash.overlap(percent)
        chance = lambda k: sum(math.comb(24, i) * t**i * (1 - t) ** (24 - i) for i in range(k))
        assert o == 1 or chance(o) <= minhash.MISS < chance(o + 1)
