import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from meterline.llm import spelling

WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts: dict[str, int], least: int, ratio: int) -> dict[str, tuple]:
    words = {w: n for w, n in counts.items() if n >= least}
    form, near = {}, {}
    for w, n in words.items():
        others = [o for o in words if abs(len(o) - len(w)) <= 1 and o != w and one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()}


def vocabulary(seed: int, alphabet: str, n: int = 500) -> dict[str, int]:
    rng = random.Random(seed)
    out: dict[str, int] = {}
    for _ in range(n):
        word = "".join(rng.choices(alphabet, k=rng.choice([7, 8, 9])))
        out[word] = rng.choice([1, 3, 40, 500, 7000])
        for _ in range(rng.randrange(4)):
            at, letter = rng.randrange(len(word)), rng.choice(alphabet)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
            if len(word) >= 7:
                out[word] = rng.choice([2, 3, 20, 30, 300])
    return out


@pytest.mark.parametrize(("alphabet", "cell"), [("abeàß", 16_384), ("abe", 20), ("abcdefghijklmnopqrstuvwxyzÀÿ", 30), ("вгда한국어", 25)])
def test_groups_are_those_of_brute_force(spark, docs, monkeypatch, alphabet, cell):
    monkeypatch.setattr(spelling, "LEAF", 4)
    counts = vocabulary(5, alphabet)
    rows = spark.createDataFrame([*counts.items(), (None, 9), ("", 9)], WORDS)
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows, cell=cell).collect()}
    assert got == brute(counts, 2, 10)


def test_anagrams_are_dealt_over_parts(spark, docs):
    """One vector of letter counts holds all words: the cell cannot be cut, so it is dealt by hash."""
    rng = random.Random(1)
    counts = {}
    for _ in range(400):
        letters = list("aabbccdd")
        rng.shuffle(letters)
        counts["".join(letters)] = rng.choice([2, 40])
    counts["aabbccd"] = 900
    rows = spark.createDataFrame(list(counts.items()), WORDS)
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows, cell=16).collect()}
    assert got == brute(counts, 2, 10)


def test_long_words_and_letters_beyond_four(spark, docs):
    long = "x" * 30_000
    counts = {long: 50, long + "x": 3, long[:-1] + "y": 4, "zzzzzzzz": 90, "zzzzzzzzz": 2, "zzzzzzzy": 5}
    rows = spark.createDataFrame([*counts.items(), ("zzzzzzzy", 1)], WORDS)
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows).collect()}
    assert got == brute({**counts, "zzzzzzzy": 6}, 2, 10)


def letter_words(text: str | None) -> list[str]:
    out, run = [], ""
    for c in (text or "") + " ":
        if c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or 0xC0 <= ord(c) <= 0xFF:
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def test_words_of_texts(spark, docs, rows):
    extra = [(7, "Ünïcödé ÀÉÎõüÿ×÷ naïveté " * 3, None, None, None), (8, "x" * 300 + " " + "y" * 70, None, None, None)]
    want: dict[str, int] = {}
    for doc_id, text, *_ in rows + extra:
        for word in letter_words(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 3 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 4:
                want[word] = want.get(word, 0) + 1
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 AS word", "2 AS n", "3 AS size")
    got = spelling.count_words(frame, least_chars=4, plant=3, block_bytes=5000)
    assert {r["word"]: r["n"] for r in got.collect()} == want


def test_empty_table(none):
    assert spelling.group_variants(spelling.count_words(none)).collect() == []


def test_boxes_never_lose_a_neighbour():
    words = spelling.Words(pa.array(sorted(vocabulary(9, "abcdeé", 300))))
    tree = spelling.Tree(words.bits, 4)
    query, node = tree.near(words.bits, 2)
    reached = set(zip(query.tolist(), node.tolist(), strict=True))
    leaf_of = {int(w): n for n in tree.leaf_nodes for w in tree.order[tree.start[n] : tree.stop[n]]}
    for i in range(len(words.size)):
        for j in range(len(words.size)):
            if int(bin(int.from_bytes((words.bits[i] ^ words.bits[j]).tobytes())).count("1")) <= 2:
                assert (i, leaf_of[j]) in reached
