import random

import numpy as np
import pyarrow as pa

from tests.llm.conftest import DOCS, prose
from meterline.llm import quality


def labelled(seed: int, n: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120))
        if i % 4 == 0:
            words = rng.choice([[w + "###" for w in words], words[:4] * 20, [x for w in words for x in (w, "|")]])
        out.append((i, " ".join(words), "en", "a", None))
    return out


def test_bad_texts_are_told_from_good_ones(spark, docs):
    rows = labelled(4)
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS measures", "2 AS fold", "3 AS score")
    trusted = spark.createDataFrame([(i,) for i in range(600) if i % 4 and i % 3 == 0] + [(None,), (3,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.score_documents(frame, trusted).collect()}
    held = [i for i in range(600) if i % 3]
    right = sum((got[i]["predicted"] == 1) == bool(i % 4) for i in held) / len(held)
    assert len(got) == 600 and right > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    again = {r["doc_id"]: r["score"] for r in quality.score_documents(frame.repartition(3), trusted).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_prior_is_near_the_share_of_good_texts(spark, docs):
    rows = labelled(8, 2000)
    frame = spark.createDataFrame(rows, DOCS)
    measured = quality.measured(frame).collect()
    fold = [(bytes(r["measures"]), r["doc_id"] % 2 if r["doc_id"] % 4 and r["doc_id"] % 3 == 0 else -1) for r in measured]
    model = quality.fit(spark.createDataFrame(fold, "measures binary, fold int"))
    assert 0.65 < model.prior < 0.8


def test_nulls_repeats_and_no_trusted_texts(spark, docs, rows, none):
    nobody = spark.createDataFrame([], "doc_id long")
    got = quality.score_documents(docs, nobody).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    some = quality.score_documents(docs, docs.where("source = 'a'")).collect()
    assert len(some) == len(rows) and all(r["score"] is not None for r in some)
    assert quality.score_documents(none, nobody).collect() == []


def test_measures_of_a_text():
    texts = ["", None, "one two three", "ab## cd. ef|\nab## cd. ef|\nxyz", " ".join("abcdefgh") + " " + " ".join("abcdefgh")]
    rows = quality.measure(pa.array(texts, pa.string())).astype(float) / 255
    name = {m: i for i, m in enumerate(quality.MEASURES)}
    assert (rows[0] == rows[1]).all() and rows[0].sum() == 0
    cube = lambda i, m: rows[i, name[m]] ** 3
    assert np.isclose(cube(3, "ended_words"), 2 / 7, atol=0.02)
    assert np.isclose(cube(3, "symbol_words"), 4 / 7, atol=0.02)
    assert np.isclose(cube(3, "repeated_lines"), 2 / 3, atol=0.02)
    assert cube(4, "repeated_eights") == 1 and cube(2, "repeated_eights") == 0
    assert np.isclose(rows[4, name["distinct_triples"]], 8 / 14, atol=0.02)


def test_least_risk_is_least():
    """No small change of the weights lowers the non-negative risk."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((400, 1)), (rng.random((400, 5)) < 0.4)], 1)
    pos = x[:150][x[:150, 1] == 1]
    p, u = pos.T @ pos, x.T @ x
    for prior in (0.1, 0.5, 0.9):
        w = quality.least_risk(p, u, prior, 1.0)

        def risk(w: np.ndarray, prior: float = prior) -> float:
            plus, minus, rest = ((1 - pos @ w) ** 2).mean() / 4, ((1 + pos @ w) ** 2).mean() / 4, ((1 + x @ w) ** 2).mean() / 4
            return prior * plus + max(0.0, rest - prior * minus) + (w[1:] ** 2).sum() / len(pos)

        least = risk(w)
        assert all(risk(w + rng.normal(0, s, 6)) >= least - 1e-7 for s in (0.001, 0.01, 0.1) for _ in range(200))
