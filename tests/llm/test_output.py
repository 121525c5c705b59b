import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from meterline.llm import boilerplate, chat, packing, warc
from meterline.llm.queries import _workers_find_us
from meterline.session import shared_dir


def best_fit_slow(sizes, length):
    rows = []
    for p in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = [(length - sum(sizes[q] for q in r), k) for k, r in enumerate(rows)]
        fits = [x for x in room if x[0] >= sizes[p]]
        if fits:
            rows[min(fits)[1]].append(p)
        else:
            rows.append([p])
    return rows


def test_best_fit_decreasing():
    rng = random.Random(2)
    for length in (1, 7, 8, 64):
        sizes = np.array([rng.randint(1, length) for _ in range(200)])
        fast, slow = packing.best_fit(sizes, length), best_fit_slow(sizes.tolist(), length)
        space = lambda rows: sorted(length - sum(int(sizes[p]) for p in r) for r in rows)
        assert space(fast) == space(slow) and sorted(p for r in fast for p in r) == list(range(200))


def test_packing_round_trip(docs, rows, none):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    tricky = [(7001, "a  b\n c \n\n d\u00a0 e \u2003f\tg  ", None, None, 0), (7002, " ", None, None, 0), (7003, "\x85 x \u1680 y", None, None, 0)]
    data = data.unionByName(docs.sparkSession.createDataFrame(tricky, docs.schema))
    found = packing.pack(data.withColumn("ids", F.lit(1)), length=256, group_bytes=100_000).collect()
    parts = defaultdict(dict)
    for r in found:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[doc][part] = ids[a:b].tolist()
    for i, t in {r.doc_id: r.text for r in data.collect()}.items():
        ids = [x for k in sorted(parts[i]) for x in parts[i][k]] if i in parts else []
        assert ids == plain.encode_ordinary(t or ""), i
    assert packing.pack(none).collect() == []


PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    _workers_find_us(spark)
    rng = random.Random(4)
    big = ["<p>" + "ab é "[: rng.randint(3, 5)] * 400 + "</p>" for _ in range(6)]
    rows = [(i, f"http://h{i % 3}.org/{i} x\n" if i % 7 else None, rng.choice([*big, "", None, "small", "x" * 999, "y" * 1000])) for i in range(0, 900, 3)]
    rows += [(897, "http://again/", big[0]), (897, "http://again/", big[0]), (None, "http://no.id/", big[1]), (5, "u", "z" * 3_000_000)]
    rng.shuffle(rows)
    return rows


def test_warc_round_trip(spark, pages):
    path = shared_dir(spark, "warc-test")
    data = spark.createDataFrame(pages, PAGES).withColumn("digest", F.lit(1)).withColumn("shard", F.lit("s"))
    names = [tuple(r) for r in warc.write_archives(data, path, shards=4, roll_bytes=2000).orderBy("name").collect()]
    assert sum(n[1] for n in names) == len(pages) and len(names) > 8
    first = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            first[h] = max(first.get(h, -1), i)
    want = []
    for i, _, h in pages:
        data_ = (h or "").encode()
        to = first.get(h)
        to = to if to is not None and i != to else None
        want.append((i, len(data_), hashlib.sha1(data_).hexdigest(), "response" if to is None else "revisit", to))
    found = [tuple(r)[:5] for r in warc.read_archives(spark, path).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    again = shared_dir(spark, "warc-test")
    assert names == [tuple(r) for r in warc.write_archives(data.repartition(3), again, shards=4, roll_bytes=2000).orderBy("name").collect()]
    read = lambda p, n: open(f"{p}/{n}".replace("file:", ""), "rb").read()
    assert all(read(path, n[0]) == read(again, n[0]) for n in names)


def test_warc_empty(spark):
    path = shared_dir(spark, "warc-test")
    assert warc.write_archives(spark.createDataFrame([], PAGES), path).collect() == []
    assert warc.read_archives(spark, path).collect() == []


def test_damage_is_seen():
    raw = warc.record(1, "http://x/", b"payload", None)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"pAyload"))


def test_boilerplate_equals_brute_force(spark, docs):
    rng = random.Random(8)
    hosts = ["a.org"] * 40 + ["b.org"] * 10 + ["c.org", ""]
    rows = []
    for i in range(300):
        host = rng.choice(hosts)
        lines = rng.sample(["menu", "about us", "news  today", "footer", "rare"], rng.randint(0, 4)) + [f"own {i}", f"own {i}"]
        rows.append((i, f"https://{host}/p" if host else None, f"<html><script>menu</script><p>{'</p><p>'.join(lines)}</p><!-- footer --></html>"))
    rows += [(None, "https://a.org", None), (1000, "notaurl", ""), (1000, "notaurl", "")]
    counts, totals, kept = defaultdict(int), defaultdict(int), []
    for i, url, html in rows:
        host = "" if not url or "//" not in url else url.split("/")[2]
        body = (html or "").partition("</script>")[2].partition("<!--")[0]
        lines = [" ".join(x.split()) for x in body.replace("</p>", "").split("<p>") if x.strip()]
        totals[host] += 1
        for line in set(lines):
            counts[host, line] += 1
        kept.append((i, host, lines))
    want = []
    for i, host, lines in kept:
        stays = [x for x in lines if not (counts[host, x] >= 3 and counts[host, x] >= 0.3 * totals[host])]
        want.append((i, host, len(lines), len(lines) - len(stays), "\n".join(stays)))
    data = spark.createDataFrame(rows, PAGES).withColumn("salt", F.lit("clash"))
    found = [tuple(r) for r in boilerplate.drop_boilerplate(data).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 100
    assert boilerplate.drop_boilerplate(data.limit(0)).collect() == []


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark, docs):
    rng = random.Random(6)
    bits = ["\\", "#", "<", "### ", "</turn>\n", "\\### Assistant: </turn> ok", "é", "日", ":\n", "", " ", "x" * 50]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a:\n#\\b", None]), rng.choice([None, "".join(rng.choices(bits, k=8))])))
    rows += [(None, 0, "user", "null id"), (None, 1, "assistant", "yes"), (3, None, "assistant", "first"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    rows += [(777, t, "assistant", "long text # " * 50) for t in range(200)]
    rng.shuffle(rows)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    data = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("clash"))
    for part_bytes in (1 << 20, 3000):
        formatted = chat.format_conversations(data, part_bytes=part_bytes)
        found = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
        assert set(found) == set(by)
        for c, turns in by.items():
            turns.sort()
            own = [x for _, _, role, x in turns if role == "assistant"]
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert found[c].n_turns == len(turns)
            assert found[c].turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns))
            assert (found[c].loss_chars, found[c].loss_sha256) == (sum(map(len, own)), sha("".join(own)))
        if part_bytes == 3000:
            assert max(r.part for r in formatted.collect()) > 10
    assert chat.digest_conversations(chat.format_conversations(data.limit(0))).collect() == []


def test_neighbouring_conversations_of_one_long_turn(spark, docs):
    rows = [(c, 0, "assistant", f"{c} " * 500) for c in range(12)] + [(None, 0, "assistant", "n " * 500)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(data, part_bytes=600)
    assert sorted((-1 if r.conv_id is None else r.conv_id, r.part) for r in formatted.collect()) == [(c, 0) for c in range(-1, 12)]
    found = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
    assert len(found) == 13
    for conv, _, role, text in rows:
        assert found[conv].n_turns == 1
        assert found[conv].turns_sha256 == hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest()


def test_packing_null_and_repeated_ids(spark, monkeypatch):
    _workers_find_us(spark)
    rows = [(None, f"text number {i} " * (i % 7 + 1)) for i in range(400)] + [(3, "one text of an id " * 4)] * 300 + [(None, None), (4, "")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want = packing.pack(data, length=64, group_bytes=2000).collect()
    groups = {r.pack_group for r in want if None in r.doc_ids}
    assert len(groups) > 4 and sum(d is None for r in want for d in r.doc_ids) == 400
    assert sum(d == 3 for r in want for d in r.doc_ids) == 300 * max(p + 1 for r in want for d, p in zip(r.doc_ids, r.parts, strict=True) if d == 3)
    assert len({(r.pack_group, r.pack_row) for r in want}) == len(want)


def test_packing_holds_bounded_parts():
    import pyarrow as pa

    part = lambda n: pa.RecordBatch.from_pydict({"doc_id": [n] * 3, "part": [0, 1, 2], "n_tokens": [4, 3, 1], "ids": [b"ab" * 4, b"cd" * 3, b"e\0"]})
    first = packing._bounded(5, [part(1), part(2)], 0, 4, 0, 2)
    second = packing._bounded(5, [part(3)], first.num_rows, 4, 0, 2)
    assert first.column("pack_row").to_pylist() == [0, 1, 2, 3] and second.column("pack_row").to_pylist() == [4, 5]
    assert sum(second.column("n_tokens").to_pylist()) == 8


def test_lines_of_a_host_with_most_pages(spark, monkeypatch):
    pages = [(i, f"https://{'big' if i % 5 else f'h{i % 4}'}.org/{i}", f"<p>menu</p><p>own {i}</p><p>{i % 3}</p>") for i in range(200)] + [(None, None, None)]
    data = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("salts", F.lit(1))
    key = lambda r: (r.page_id is None, r.page_id)
    plain = sorted(boilerplate.drop_boilerplate(data).collect(), key=key)
    monkeypatch.setattr(boilerplate, "SALT_PAGES", 7)
    assert sorted(boilerplate.drop_boilerplate(data).collect(), key=key) == plain
    monkeypatch.setattr(boilerplate, "BROADCAST_BYTES", 0)
    assert sorted(boilerplate.drop_boilerplate(data).collect(), key=key) == plain
    assert plain[1].n_dropped == 2 and plain[1].text == "own 1"
