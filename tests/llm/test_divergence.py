import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import DOCS
from meterline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, prior=5, unit=10**9, top=4):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang, docs in seen.items():
        kept = [t for t, n in docs.items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        every = Counter()
        for c in mine.values():
            every.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + unit * (c[t] + prior) // (total + prior * len(kept)) for t in kept}

        q = shares(every)
        p = {s: shares(c) for s, c in mine.items()}
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ["Ab", "é", "zO", "漢字", "q"] for b in "cdefgh"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", "ß", None, f"t{i % 11}"])
        skew = words if source != "hot" else words[:9]
        rows.append((i, rng.choice([" ", "1", "\x7f", "\n"]).join(rng.choices(skew, k=rng.randint(0, 30))), lang, source, None))
    rows += [(900, None, "en", "empty", None), (901, "12 34", "xx", "only", None), (901, "12 34", "xx", "other", None), (3, rows[3][1], *rows[3][2:])]
    rows.append((902, "Ab " * 400_000 + "漢" * 300_000, "en", "long", None))
    return rows


@pytest.mark.parametrize(("block", "cells", "held"), [(256, 1 << 18, 400_000), (3, 40, 7), (1, 10**6, 50)])
def test_audit_is_that_of_brute_force(spark, docs, monkeypatch, block, cells, held):
    monkeypatch.setattr(divergence, "TERMS", 5)
    monkeypatch.setattr(divergence.term_counts, "__defaults__", (held,))
    rows = texts(2)
    frame = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "'x' AS term", "1 AS n", "2 AS p", "3 AS rank")
    got = divergence.audit(frame, least_docs=3, top=4, block=block, task_cells=cells)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_terms_are_never_cut():
    text = ("Straße, x9Y 漢字~ ab" * 50).encode()
    want = [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
    for piece in (1, 2, 7, 100, 10_000):
        assert [t for part in divergence.terms(text, piece) for t in part] == want


def test_empty_table(none):
    assert divergence.audit(none).collect() == []
