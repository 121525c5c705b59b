import random

import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import decontaminate
from tests.llm.conftest import DOCS, prose


def slow_least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_least_edits_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        a = bytes(rng.choices(b"abc", k=rng.randint(1, 20)))
        b = bytes(rng.choices(b"abc", k=rng.randint(0, 40)))
        assert decontaminate.least_edits(a, b) == slow_least(a, b)


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(5)
    return [(k, " ".join(prose(rng, rng.randint(12, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "too short an item"), (None, "x")]


def planted(bench, share, seed):
    """Documents with items whose words are changed, dropped or added at the given share."""
    rng = random.Random(seed)
    rows, want = [], set()
    for n in range(300):
        words = prose(rng, rng.randint(0, 80))
        if n % 3:
            item, text = bench[rng.randrange(40)]
            copy = []
            for w in text.split():
                if rng.random() < share:
                    copy += rng.choice([[], [w, *prose(rng, 1)], prose(rng, 1)])
                else:
                    copy.append(w)
            at = rng.randint(0, len(words))
            words[at:at] = [" ".join(copy).title()]
            want.add((n, item))
        rows.append((n, ", ".join(words), "en", "a", 0))
    return rows, want


@pytest.mark.parametrize("share", [0.0, 0.05])
def test_finds_what_was_planted(spark, docs, bench, share):
    rows, want = planted(bench, share, 9)
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), table).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs <= want
    norm = decontaminate.Items([i for i, _ in bench], [t for _, t in bench])
    by_item = dict(zip(norm.ids, norm.text, strict=True))
    texts = {r[0]: b" ".join(w.encode() for w in r[1].lower().replace(",", " ").split()) for r in rows}
    near = {(d, i) for d, i in want if decontaminate.least_edits(by_item[i], texts[d]) <= int(0.2 * len(by_item[i]))}
    assert len(pairs & near) >= 0.99 * len(near)
    for r in found:
        assert r.edit_distance == decontaminate.least_edits(by_item[r.item_id], texts[r.doc_id])
    kept = {r.doc_id for r in decontaminate.without_leaks(spark.createDataFrame(rows, DOCS), table).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in pairs}


def test_blocks_give_the_same(spark, docs, bench):
    rows, _ = planted(bench, 0.02, 11)
    table, data = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(rows, DOCS)
    one = {tuple(r) for r in decontaminate.find_leaks(data, table).collect()}
    assert one == {tuple(r) for r in decontaminate.find_leaks(data, table, block_bytes=3000).collect()}


def test_edge_rows(spark, docs, none, rows, bench):
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.find_leaks(docs, table).collect() == []
    assert decontaminate.without_leaks(docs, table).count() == len(rows)
    assert decontaminate.without_leaks(docs, table).columns == docs.columns
    assert decontaminate.find_leaks(none, table).collect() == []
    assert decontaminate.find_leaks(docs, table.limit(0)).collect() == []


def worn(rng, words, share, evenly):
    """``words`` with a typo (a letter changed, dropped or added) in a share of them."""
    n, out = max(1, round(share * len(words))), list(words)
    at = [(2 * k + 1) * len(words) // (2 * n) for k in range(n)] if evenly else rng.sample(range(len(words)), n)
    for k in at:
        w, x = out[k], rng.randrange(len(out[k]))
        out[k] = w[:x] + rng.choice(["", "q", "q" + w[x]]) + w[x + 1 :]
    return [w for w in out if w]


def damaged(rng, text, share):
    """``text`` with edits of single letters, scattered over it."""
    for x in sorted(rng.sample(range(len(text)), int(share * len(text))), reverse=True):
        text = text[:x] + rng.choice(["", "q", "q" + text[x]]) + text[x + 1 :]
    return text


def recall(items, copies, rng):
    texts = [" ".join([*prose(rng, 20), c, *prose(rng, 20)]) for _, c in copies]
    near = {(n, i) for n, (i, _) in enumerate(copies) if decontaminate.least_edits(items.chars[i], texts[n]) <= items.limits[i]}
    found = {(r, i) for r, i, _ in decontaminate.leaks(pa.array(texts), items, 0.2)}
    return len(near & found) / len(near)


@pytest.mark.parametrize("n", [8, 24, 30, 40])
def test_recall_of_typos_in_words(n):
    rng = random.Random(n)
    bench = [prose(rng, n) for _ in range(60)]
    items = decontaminate.Items(list(range(60)), [" ".join(w) for w in bench])
    for share in (0.1, 0.2):
        for evenly in (False, True):
            assert recall(items, [(i, " ".join(worn(rng, w, share, evenly))) for i, w in enumerate(bench)], rng) == 1


@pytest.mark.parametrize("n", [8, 24, 30, 40])
def test_recall_of_scattered_edits_at_the_limit(n):
    rng = random.Random(n)
    bench = [" ".join(prose(rng, n)) for _ in range(100)]
    items = decontaminate.Items(list(range(100)), bench)
    copies = [(i, damaged(rng, t, 0.19)) for i, t in enumerate(bench) for _ in range(3)]
    assert recall(items, copies, rng) >= 0.98


def test_short_items_are_found():
    items = decontaminate.Items([1, 2, 3, 4], ["What is the capital of Peru?", "Lima", "the answer is forty-two", "in a b"])
    texts = ["so: what is, the CAPITAL of peru then", "what is the kapital of peru", "near lima.", "limas", "answer is forty two", "in a b", "in ab"]
    found = decontaminate.leaks(pa.array(texts), items, 0.2)
    assert found == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (4, 2, 4), (5, 3, 0)]


def test_scripts_without_blanks():
    rng = random.Random(3)
    item = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    thai = "".join(chr(rng.randrange(0xE01, 0xE2E)) for _ in range(60))
    changed = list(item)
    for x in range(5, 200, 10):
        changed[x] = "猫"
    items = decontaminate.Items([1, 2, 3], [item, thai, item[:6]])
    texts = ["前文" + item + "后文", "前文，" + "".join(changed), item[:50] + "，" + item[50:] + "。", "x " + thai, "文" + item[:6], "文" * 300]
    assert items.lengths.tolist() == [200, 60, 6]
    found = decontaminate.leaks(pa.array(texts), items, 0.2)
    assert [f for f in found if f[1] == 0] == [(0, 0, 0), (1, 0, sum(a != b for a, b in zip(item, changed, strict=True))), (2, 0, 0)]
    assert (3, 1, 0) in found and (4, 2, 0) in found
    assert not [f for f in found if f[0] == 5]


def test_rows_do_not_run_into_each_other():
    items = decontaminate.Items([1], ["one passage that is cut in two by the end of a row"])
    assert decontaminate.leaks(pa.array(["one passage that is cut in", None, " two by the end of a row"]), items, 0.2) == []
    assert decontaminate.leaks(pa.array(["", "x", "one passage that is cut in two by the end of a row", ""]), items, 0.2) == [(2, 0, 0)]


def scripted(rng, text, edits):
    """``text`` with so many edits of single letters, and (place in the copy, place in the text) of every letter left."""
    letters = [x for x, c in enumerate(text) if c != " "]
    at, out, pairs = set(rng.sample(letters, edits)), [], []
    for x, c in enumerate(text):
        # of a word no two neighbours are left out, so that none is gone
        change = rng.choice(["q", "q" + c, "q" if x - 1 in at else ""]) if x in at else c
        if change[-1:] == c:
            pairs.append((len(out) + len(change) - 1, x))
        out += change
    return "".join(out), pairs


@pytest.mark.parametrize("share", [0.02, 0.1, 0.2])
@pytest.mark.parametrize("n", [5, 14, 22, 45, 300])
def test_no_seed_of_a_leak_is_dropped(n, share):
    rng = random.Random(n)
    bench = [" ".join(prose(rng, n)) for _ in range(12)]
    items = decontaminate.Items(list(range(12)), bench)
    for i, text in enumerate(bench):
        copy, pairs = scripted(rng, text, int(share * len(text)))
        around = [" ".join(prose(rng, rng.choice([0, 3, 90]))) for _ in range(2)]
        s = decontaminate.Spelled(pa.array([around[0] + copy + around[1]]))
        kept = {(p + len(around[0]), x) for p, x in pairs}
        size = decontaminate.seed_chars(len(text))
        assert s.text(0, len(s.chars)) == around[0] + copy + around[1]
        assert items.lengths[i] == len(text)
        # undamaged runs of the seed's length that do not reach further to the left
        seeds = [(p, x) for p, x in kept if all((p + k, x + k) in kept for k in range(size))]
        seeds = [(p, x) for p, x in seeds if not x or not p or s.short[p - 1] != items.short[items.first[i] + x - 1]]
        if seeds:
            at, offset = np.array(sorted(seeds)).T
            beside = decontaminate.Beside(s.short, 0, len(s.short))
            assert beside.possible(s, items, at, np.full(len(at), i), offset, np.full(len(at), size)).all()


def test_few_places_are_compared_in_full(monkeypatch):
    """Clean texts in the items' own syllables share short seeds with them nearly everywhere; few pass their neighbours."""
    rng = random.Random(8)
    items = decontaminate.Items(list(range(60)), [" ".join(prose(rng, rng.randint(18, 30))) for _ in range(60)])
    seen, near = [], decontaminate._near
    monkeypatch.setattr(decontaminate, "_near", lambda s, items, places: seen.append(len(places)) or near(s, items, places))
    text = " ".join(prose(rng, 20_000))
    assert decontaminate.leaks(pa.array([text]), items, 0.2) == []
    assert sum(seen) < len(text) / 100


def test_stretches_and_parts_do_not_matter(monkeypatch, bench):
    rows, _ = planted(bench, 0.1, 13)
    texts = pa.array([r[1] for r in rows])
    items = decontaminate.Items([i for i, _ in bench], [t for _, t in bench])
    want = decontaminate.leaks(texts, items, 0.2)
    assert want
    for stretch, chunk in ((700, 50), (5000, 7), (1 << 20, 1 << 20)):
        monkeypatch.setattr(decontaminate, "_STRETCH", stretch)
        monkeypatch.setattr(decontaminate, "_CHUNK", chunk)
        assert decontaminate.leaks(texts, items, 0.2) == want
