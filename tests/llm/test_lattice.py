import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meterline.llm import lattice

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pieces():
    return lattice._pieces(open(lattice.VOCABULARY, "rb").read())


def slow_marginal(word, table, longest):
    text = b" " + word
    total = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            p = table.get(text[begin:end])
            if p is not None:
                total[end] += total[begin] * p
    return math.log(total[-1])


def test_marginals_and_expectations_equal_brute_force():
    own = pieces()
    table = dict(zip(own.text, np.exp(own.logp), strict=True))
    words = [w.encode() for w in "the thonation a ünï 日本 xqz zz ththth , \x00\x01".split(" ")]
    grid = lattice.Lattice(words, own)
    want = [slow_marginal(w, table, own.lengths[-1]) for w in words]
    assert np.allclose(grid.marginals(own.logp), want)
    uses = grid.expected(own.logp)
    # the bytes of all pieces used add up to the bytes of the words
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, own.text, strict=True)), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_scores(docs, rows):
    found = lattice.score_documents(docs.withColumn("block", F.lit("clash")), block_bytes=50_000).collect()
    assert len(found) == len(rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(i, [*WORD.findall((t or "").translate(lower)), None]) for i, t, *_ in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    key = lambda i, k, b: (str(i), k, round(b, 6))
    want = Counter(key(i, len(ws), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens)
    assert want == Counter(key(r.doc_id, r.n_tokens, r.base_score) for r in found)
    known = {(i, len(ws)): sum(counts[w] > 0 for w in ws) for i, ws in tokens}
    for r in found:
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.n_known == known[r.doc_id, r.n_tokens]
        assert math.isfinite(r.score) and r.score < 0


def test_word_probabilities_sum_to_less_than_one(docs):
    """Seen words and the end hold 1 minus the freed mass; spelling gives the rest to all strings."""
    own = pieces()
    follow, begin = np.exp(own.logp[~own.start]).sum(), np.exp(own.logp[own.start]).sum()
    assert math.isclose(follow + begin, 1.0, rel_tol=1e-9)


def test_held_out_prose_beats_shuffled_letters(spark, docs, rows):
    import random

    rng = random.Random(0)
    fake = [(900_000 + i, "".join(rng.sample(t, len(t))), lang, s, n) for i, (_, t, lang, s, n) in enumerate(rows) if t and 100 < len(t) < 5000][:40]
    both = docs.unionByName(spark.createDataFrame(fake, docs.schema))
    mean = lambda real: F.avg(F.when(F.col("held_out") & (F.col("n_tokens") > 20) & ((F.col("doc_id") < 900_000) == real), F.col("score") / F.col("n_tokens")))
    good, bad = lattice.score_documents(both).agg(mean(True), mean(False)).first()
    assert good > bad + 1


def test_no_training_documents_and_empty(docs, none):
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
    found = lattice.score_documents(held).collect()
    assert found and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found)
    assert lattice.score_documents(none).collect() == []
