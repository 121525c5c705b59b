import math
import re
import zlib
from collections import Counter, defaultdict

import sentencepiece
import pytest
from pyspark.sql import functions as F

from meterline.llm import fertility, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_fertility_equals_brute_force(spark, docs, rows):
    block = " ".join(f"w{i}" for i in range(12))
    more = [(9001, f"{block}\n{block}\n\n \nshort\nshort\n{block} a | b <c>", "en", "a", 0), (9002, "日本語のテキスト " * 30, "ja", "a", 0)]
    data = spark.createDataFrame(more, docs.schema).unionByName(docs).withColumn("n_words", F.lit("clash"))
    found = fertility.quality(data).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    assert len(found) == len(rows) + 2
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
        ids = [t for w in WORD.findall(r.text or "") for t in sp.encode(w)]
        n = max(1, len(ids))
        assert math.isclose(r.chars_per_token, r.word_chars / n)
        assert math.isclose(r.byte_share, sum(map(sp.is_byte, ids)) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        assert math.isclose(r.token_entropy, entropy, abs_tol=1e-9)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not next(r for r in found if r.doc_id == 9001).kept
    assert sum(r.kept for r in found) > 100


def test_fertility_empty(none):
    assert fertility.quality(none).collect() == []


def test_shards(docs, rows):
    found = sharding.assign_shards(docs.withColumn("shard", F.lit("clash")), [1.0] * 8, [1.0] * 9).collect()
    assert len(found) == len(rows)
    text = defaultdict(set)
    for i, t, *_ in rows:
        data = (t or "").encode()
        text[i].add((len(data) + 1, zlib.crc32(data)))
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in found:
        assert (r["size"], r.text_crc32) in text[r.doc_id]
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert all(len(s) == 1 for s in by_id.values())


def test_shard_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = Counter(r.shard for r in sharding.assign_shards(ids, [1.0, 2.0, 5.0]).collect())
    assert [round(counts[k] / 20_000, 1) for k in range(3)] == [0.1, 0.2, 0.6]
    assert sharding.assign_shards(ids.limit(0), [1.0]).collect() == []


def level(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark, docs, rows):
    sizes, docs_of = defaultdict(int), defaultdict(list)
    for i, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = level(sizes)
    found = mixing.mix_sources(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        docs_of[r.source].append(r)
    for s, group in docs_of.items():
        assert abs(sum(r.taken for r in group) - want[s]) <= max(r["size"] for r in group)
    again = mixing.mix_sources(docs.repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r._key, r.source or "", r.taken)
    assert sorted(map(key, again), key=str) == sorted(map(key, found), key=str)


def test_mixed_documents(docs, none):
    mixed = mixing.mixed_documents(docs)
    taken = sum(r.taken for r in mixing.mix_sources(docs).collect())
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert words == taken
    assert mixing.mix_sources(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def level_targets(sizes, weights, share, epochs):
    """Targets by filling up round after round."""
    left, open_, out = sum(sizes.values()) * share, dict(zip(sorted(sizes), weights, strict=False)), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if epochs * sizes[s] < level * w]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize(
    "sizes", [{"a": 100}, {"a": 450, "b": 200, "c": 350}, {"a": 500, "b": 167, "c": 333}, {"a": 10, "b": 900, "c": 90}, {"a": 1, "b": 1, "c": 998}]
)
def test_targets_are_level(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(table).collect()}
    assert found == pytest.approx(level_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.EPOCHS))
    assert sum(found.values()) == pytest.approx(min(mixing.SHARE, mixing.EPOCHS) * sum(sizes.values()))


def test_short_plain_sentences_are_kept(spark, docs):
    plain = [
        "The committee said that the report of the board on the state of the roads in the city was late and that the mayor knew.",
        "When the rain came to the valley the people of the town went up to the church on the hill and sat in the dark.",
        "He told the man at the door of the house that the key to the box was in the drawer of the desk in the hall.",
    ]
    junk = ["buy now " * 15, "a b c a b c a b c a b c a b c a b c a b c a b c", "spam " * 30]
    data = spark.createDataFrame([(n, t, "en") for n, t in enumerate(plain + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.quality(data).where("kept").collect()}
    assert kept == {0, 1, 2}


def test_null_ids_share_one_shard(spark):
    rows = [(None, f"text {i}") for i in range(60)] + [(7, "a"), (7, None), (8, "")]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), [1.0] * 8, [1.0] * 9).collect()
    nulls = [r for r in found if r.doc_id is None]
    assert len(nulls) == 60 and len({(r.shard, r.grown_shard) for r in nulls}) == 1
    assert len({r.shard for r in found if r.doc_id == 7}) == 1


def test_winner_by_brute_force(spark):
    weights = [1.0, 3.0, 0.5, 2.0]
    hashed = spark.range(-50, 300).select("id", F.array(*[F.xxhash64("id", F.lit(k)) for k in range(4)]).alias("h")).collect()
    score = lambda h, w: -w / math.log(((h % (1 << 64) >> 11) + 0.5) / (1 << 53))
    want = {r.id: max((score(h, w), k) for k, (h, w) in enumerate(zip(r.h, weights, strict=True)))[1] for r in hashed}
    ids = spark.range(-50, 300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert {r.doc_id: r.shard for r in sharding.assign_shards(ids, weights).collect()} == want


def test_mixed_documents_of_equal_rows(spark):
    rows = [(n, " ".join(f"{'abc'[n]}{i}" for i in range(10)), "s", "x") for n in range(3) for _ in range(20)]
    rows += [(9, "a lone text of another source", "t", "y"), (None, None, None, "z"), (0, rows[0][1], "t", "y")]
    names = ["doc_id", "text", "source", "_key", "_doc", "_times", "_copy", "_mix", "size", "taken", "key", "row", "copies", "nth"]
    data = spark.createDataFrame([(*r, *[r[3]] * 10) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names[3:]))
    mixed = mixing.mixed_documents(data)
    assert mixed.columns == names
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert {r[n] for n in names[3:]} == {"x" if r.source == "s" else "y"}
    for r in mixing.mix_sources(data).collect():
        want[r.doc_id, r.source] += r.taken
    assert got == +want
