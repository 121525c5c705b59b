"""Words that are spelling variants of a far more frequent word: one letter inserted, deleted or replaced."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import common

#: Least letters of a word, least occurrences, and how many times as frequent a word's form must be.
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
BLOCK_BYTES = 4 << 20
#: Words the upper tree is fitted on (those of smallest hash), least of them in a cell, and words compared in one piece.
FIT_WORDS, FIT_CELL, CELL = 50_000, 8, 16_384
#: Words in a leaf of the lower tree, queries searched at once, elements of a comparison at once.
LEAF, QUERIES, ELEMENTS = 32, 512, 1 << 22

# Letter counts are written as ones: count k of a letter sets its first k bits, so the L1 distance of two vectors is
# the number of bits that differ. a-z have four bits each, 64 further letters (by code point) two. Counts beyond that
# are left out, which can only make a distance smaller; letters are compared in order at the end anyway.
_SLOTS = 26 + 64
_CAPS = np.array([4] * 26 + [2] * 64)
_OFFSET = np.concatenate([[0], np.cumsum(_CAPS)])
_WORDS = 4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), 0xC3]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


# -- words of texts --------------------------------------------------------------------------------


def _continue_crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of texts with the checksums ``state``, each lengthened by its span of ``data``."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    reg, at, left = ~state[short], starts[short], size[short]
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))
        reg[:n] = _CRC[(reg[:n] ^ data[at[:n] + i]) & np.uint32(0xFF)] ^ (reg[:n] >> np.uint32(8))
    out[short] = ~reg
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def letter_runs(docs: pa.RecordBatch, least_chars: int, plant: int) -> pa.Array:
    """Lower-cased letter runs of at least ``least_chars`` letters, planted deletions done."""
    data, offsets = common.text_bytes(docs.column("text"))
    data = common.lower_ascii(data)
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    starts, ends, row = common.spans(inside, offsets)
    two = np.concatenate([[0], np.cumsum(data == 0xC3)])
    chars = ends - starts - (two[ends] - two[starts])
    long = np.flatnonzero(chars >= least_chars)
    starts, ends, row, chars = starts[long], ends[long], row[long], chars[long]
    planted: list[str] = []
    if plant:
        state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in docs.column("doc_id").to_pylist()], np.uint32)
        crc = _continue_crc(state[row], data, starts, ends)
        hit = crc % plant == 0
        for i in np.flatnonzero(hit):
            if chars[i] > least_chars:
                word, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(chars[i])
                planted.append(word[:at] + word[at + 1 :])
        starts, ends = starts[~hit], ends[~hit]
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    text = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(text))
    return pa.concat_arrays([whole, pa.array(planted, pa.large_string())])


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, plant: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``word`` and ``n`` of all letter runs ([A-Za-z] and U+00C0 to U+00FF, only A-Z lower-cased) of whole texts.

    ``plant`` makes test variants: where it divides the crc32 of ``<doc_id>:<run>``, the letter at crc32 modulo the
    run's length is deleted. Words of fewer than ``least_chars`` letters are left out. Null and empty texts have no
    words; a null doc_id counts as empty; repeated rows count each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", block_bytes):
                found = letter_runs(part, least_chars, plant).value_counts()
                for i in range(0, len(found), 20_000):
                    some = found.slice(i, 20_000)
                    yield pa.RecordBatch.from_arrays([some.field("values").cast(pa.string()), some.field("counts")], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- k-d trees over letter counts -------------------------------------------------------------------


class Words:
    """Words as code points end to end, and their letter counts as bits."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string())
        self.size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, _ = common.text_bytes(column)
        self.code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.first = np.cumsum(self.size) - self.size
        self.bits, self.whole = self._bits()

    def _bits(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(self.size), _WORDS), np.uint64)
        whole = np.zeros(len(self.size), bool)
        letter = self.code.astype(np.int64) - 0x61
        slot = np.where((letter >= 0) & (letter < 26), letter, 26 + (self.code & np.uint32(63)))
        # letters that share a slot with others hide a replacement
        shared = ((letter < 0) | (letter >= 26)) & (self.code >> np.uint32(6) != 3)
        # runs of words whose table of counts stays small
        for a in range(0, len(self.size), 4096):
            b = min(a + 4096, len(self.size))
            begin, end = self.first[a], self.first[b - 1] + self.size[b - 1]
            row = np.repeat(np.arange(b - a), self.size[a:b])
            count = np.bincount(row * _SLOTS + slot[begin:end], minlength=(b - a) * _SLOTS).reshape(-1, _SLOTS)
            ones = np.zeros((b - a, 64 * _WORDS), bool)
            for rank in range(4):
                has = np.flatnonzero(_CAPS > rank)
                ones[:, _OFFSET[has] + rank] = count[:, has] > rank
            out[a:b] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)
            whole[a:b] = (count <= _CAPS).all(1) & (np.bincount(row, shared[begin:end], minlength=b - a) == 0)
        return out, whole

    def letters(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return self.code[self.first[rows][:, None] + np.arange(size)]


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")


class Tree:
    """A k-d tree of bit vectors. A node asks whether a word has a letter at least so many times; the letter and number
    that halve its words best are taken. ``must`` and ``may`` are the node's box: bits that all and that any of its
    words have. With ``tight`` boxes hold just the node's words, else every word that could come there."""

    def __init__(self, bits: np.ndarray, leaf: int, tight: bool = True, most_leaves: int | None = None) -> None:
        self.order = np.arange(len(bits))
        must, may, ask, child, start, stop, self.leaf_nodes = [], [], [], [], [], [], []
        none, every = np.zeros(_WORDS, np.uint64), np.full(_WORDS, ~np.uint64(0))
        todo = [(0, len(bits), none, every, -1, 0)]
        leaves = 1
        for a, b, least, most, parent, side in todo:
            here = len(ask)
            if parent >= 0:
                child[parent][side] = here
            rows = self.order[a:b]
            if tight and b > a:
                least, most = np.bitwise_and.reduce(bits[rows], axis=0), np.bitwise_or.reduce(bits[rows], axis=0)
            must.append(least), may.append(most), start.append(a), stop.append(b), ask.append(-1), child.append([-1, -1])
            split = b - a > leaf and (most_leaves is None or leaves < most_leaves)
            if split:
                ones = _ones(bits[rows])
                total = ones.sum(0, dtype=np.int64)
                bit = int(np.argmin(np.abs(2 * total - (b - a))))
                split = 0 < total[bit] < b - a
            if not split:
                self.leaf_nodes.append(here)
                continue
            leaves += 1
            ask[here] = bit
            has = ones[:, bit].astype(bool)
            self.order[a:b] = np.concatenate([rows[~has], rows[has]])
            mid = b - int(total[bit])
            slot = int(np.searchsorted(_OFFSET, bit, "right")) - 1
            up, down = none.copy(), every.copy()
            for i in range(_OFFSET[slot], bit + 1):
                up[i // 64] |= np.uint64(1) << np.uint64(i % 64)
            for i in range(bit, _OFFSET[slot + 1]):
                down[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
            todo += [(a, mid, least, most & down, here, 0), (mid, b, least | up, most, here, 1)]
        self.must, self.may = np.array(must).reshape(-1, _WORDS), np.array(may).reshape(-1, _WORDS)
        self.ask, self.child = np.array(ask), np.array(child).reshape(-1, 2)
        self.start, self.stop = np.array(start), np.array(stop)

    def near(self, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf node) for all leaves whose box is within ``radius``; whole subtrees beyond it are pruned."""
        query, node = np.arange(len(bits)), np.zeros(len(bits), np.int64)
        found = []
        while len(query):
            own = bits[query]
            gap = np.bitwise_count(self.must[node] & ~own).sum(1) + np.bitwise_count(own & ~self.may[node]).sum(1)
            keep = gap <= radius
            query, node = query[keep], node[keep]
            end = self.ask[node] < 0
            found.append((query[end], node[end]))
            query, node = np.repeat(query[~end], 2), self.child[node[~end]].reshape(-1)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def home(self, bits: np.ndarray) -> np.ndarray:
        """The leaf node each word belongs to."""
        node = np.zeros(len(bits), np.int64)
        while True:
            ask = self.ask[node]
            inner = np.flatnonzero(ask >= 0)
            if not len(inner):
                return node
            bit = ask[inner]
            has = (bits[inner, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)
            node[inner] = self.child[node[inner], has.astype(np.int64)]


def one_edit(queries: Words, points: Words, q: np.ndarray, p: np.ndarray, size: int, grown: bool) -> np.ndarray:
    """Which of the pairs differ by one replaced letter, or (``grown``) by one letter that the point has more."""
    out = np.zeros(len(q), bool)
    step = max(1, ELEMENTS // max(size, 1))
    for a in range(0, len(q), step):
        x, y = queries.letters(q[a : a + step], size), points.letters(p[a : a + step], size + grown)
        if not grown:
            out[a : a + step] = (x != y).sum(1) == 1
            continue
        front, back = x == y[:, :-1], x == y[:, 1:]
        same_front = np.where(front.all(1), size, front.argmin(1))
        same_back = np.where(back.all(1), size, back[:, ::-1].argmin(1))
        out[a : a + step] = same_front + same_back >= size
    return out


def pairs_near(queries: Words, points: Words, tree: Tree, rows: np.ndarray, size: int, grown: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) of one edit. ``rows`` are queries of ``size`` letters; all points have as many, or one more."""
    radius = 1 if grown else 2
    out_q, out_p = [], []
    for a in range(0, len(rows), QUERIES):
        some = rows[a : a + QUERIES]
        query, node = tree.near(queries.bits[some], radius)
        count = tree.stop[node] - tree.start[node]
        # leaves of a tree may be large where many words have the same letters, so pairs are taken in bounded runs
        ends = np.cumsum(count)
        cuts = np.unique(np.searchsorted(ends, np.arange(ELEMENTS // 4, (ends[-1] if len(ends) else 0) + ELEMENTS // 4, ELEMENTS // 4), "right"))
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
            if i == j:
                continue
            n = count[i:j]
            q = some[np.repeat(query[i:j], n)]
            p = tree.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tree.start[node[i:j]], n)]
            gap = np.bitwise_count(queries.bits[q] ^ points.bits[p]).sum(1)
            # where no count was cut off the distance is exact
            keep = (gap == radius) | ((gap < radius) & ~(queries.whole[q] & points.whole[p]))
            q, p = q[keep], p[keep]
            keep = one_edit(queries, points, q, p, size, grown)
            out_q.append(q[keep])
            out_p.append(p[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_p])


class Cells:
    """The upper tree per word length. Its leaves are the cells that Spark shuffles words to."""

    def __init__(self, sample: pa.Array, total: int, cell: int) -> None:
        words = Words(sample)
        self.trees: dict[int, Tree] = {}
        for size in np.unique(words.size).tolist():
            own = words.bits[words.size == size]
            wanted = -(-total * len(own) // max(len(words.size) * cell, 1))
            self.trees[size] = Tree(own, FIT_CELL, tight=False, most_leaves=max(1, wanted))
        self.parts: dict[tuple[int, int], int] = {}

    def tree(self, size: int) -> Tree:
        return self.trees.get(size) or Tree(np.zeros((0, _WORDS), np.uint64), FIT_CELL, tight=False)

    def home(self, words: Words) -> np.ndarray:
        out = np.zeros(len(words.size), np.int64)
        for size in np.unique(words.size).tolist():
            rows = np.flatnonzero(words.size == size)
            out[rows] = self.tree(size).home(words.bits[rows])
        return out

    def visits(self, words: Words, home: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
        """(rows, word length of the cells, cells, part) that words must be compared in: of two cells of one length the words
        of one visit the other, in turns, so that no cell gets all the visits; and cells of words one letter longer."""
        for size in np.unique(words.size).tolist():
            rows = np.flatnonzero(words.size == size)
            for grown in (0, 1):
                row, cell = self.tree(size + grown).near(words.bits[rows], 2 - grown)
                row = rows[row]
                if not grown:
                    turn = (cell == home[row]) | ((cell > home[row]) == ((cell + home[row]) % 2 == 0))
                    row, cell = row[turn], cell[turn]
                parts = np.array([self.parts.get((size + grown, c), 1) for c in cell.tolist()], np.int64)
                for part in range(int(parts.max(initial=0))):
                    yield row[parts > part], size + grown, cell[parts > part], part


def near_words(counts: DataFrame, cell: int = CELL) -> DataFrame:
    """Per word with a near word: n_near, and the near word of largest count (ties: smallest), as ``best``, ``best_n``.

    ``counts`` has distinct words and is read several times, so it should be a stored table. An upper k-d tree per word
    length, fitted on FIT_WORDS words of smallest hash, cuts the words into cells of about ``cell`` words; every word
    goes to its own cell and, as a query, to the cells its letter counts are near enough to. Cells above ``cell``
    words, say of anagrams, are dealt over several parts by hash, and a query goes to each. A task holds the words of
    one part, with a k-d tree of their own, and streams the queries past them.
    """
    spark = counts.sparkSession
    total = counts.count()
    fit = counts.where(F.length("word") <= 64).orderBy(F.xxhash64("word"), "word").limit(FIT_WORDS).select("word").toArrow()
    cells = Cells(fit.column("word").combine_chunks(), total, cell)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(words.size), pa.array(cells.home(words))], names=["size", "cell"])

    # one row per crowded cell: no more than words / cell of them
    sizes = counts.select("word").mapInArrow(at_home, "size long, cell long").groupBy("size", "cell").count().where(F.col("count") > cell)
    cells.parts = {(r["size"], r["cell"]): -(-r["count"] // cell) for r in sizes.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "cell", "part", "is_query", "home", "word", "n"]
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                words = Words(batch.column("word"))
                home = cells.home(words)
                spread = [cells.parts.get(key, 1) for key in zip(words.size.tolist(), home.tolist(), strict=True)]
                part = batch.column("salt").to_numpy() % np.array(spread, np.int64)
                row = np.arange(len(home))
                rows = [(row, words.size, home, part, row < 0)]
                for row, size, cell_of, number in cells.visits(words, home):
                    rows.append((row, np.full(len(row), size), cell_of, np.full(len(row), number), row >= 0))
                row, size, cell_of, number, is_query = (np.concatenate(x) for x in zip(*rows, strict=True))
                for i in range(0, len(row), 20_000):
                    some, to = row[i : i + 20_000], slice(i, i + 20_000)
                    fixed = [size[to], cell_of[to], number[to], is_query[to], home[some]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), *(batch.column(c).take(pa.array(some)) for c in ("word", "n"))], names=names)

    salted = counts.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("salt"))
    placed = salted.mapInArrow(place, "size long, cell long, part long, is_query boolean, home long, word string, n long")
    place_of = ["size", "cell", "part"]
    met = placed.repartition(common.partitions(spark), *place_of).sortWithinPartitions(*place_of, "is_query")
    near = met.mapInArrow(_compare, "word string, n_near long, best string, best_n long")
    return near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    ).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, a part's words before its queries -> matches of every word, added up per batch."""
    key, held, points, tree = None, [], None, None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "cell", "part", "is_query")]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = tuple(int(c[a]) for c in columns[:3])
            if here != key:
                key, held, points = here, [], None
            piece = batch.slice(a, b - a)
            if not columns[3][a]:
                held.append(piece)
                continue
            if not held:
                continue
            if points is None:
                own = pa.Table.from_batches(held).combine_chunks()
                names, counts = own.column("word").combine_chunks(), own.column("n").to_numpy()
                points = Words(names)
                tree = Tree(points.bits, LEAF)
                ranks = _ranks(names, counts)
            yield from _matches(piece, key, points, tree, names, counts, ranks)


def _ranks(words: pa.Array, n: np.ndarray) -> np.ndarray:
    """Place of each word in the order of falling counts, then of words."""
    order = pc.sort_indices(pa.table({"n": pa.array(n), "word": words}), sort_keys=[("n", "descending"), ("word", "ascending")])
    out = np.empty(len(n), np.int64)
    out[order.to_numpy()] = np.arange(len(n))
    return out


def _matches(piece, key, points, tree, names, counts, ranks) -> Iterator[pa.RecordBatch]:
    mine, n, home = piece.column("word"), piece.column("n").to_numpy(), piece.column("home").to_numpy()
    queries = Words(mine)
    found = []
    for size in np.unique(queries.size).tolist():
        rows = np.flatnonzero(queries.size == size)
        found.append(pairs_near(queries, points, tree, rows, size, size < key[0]))
    q, p = (np.concatenate(x) for x in zip(*found, strict=True))
    # two words of one cell meet twice
    twice = (queries.size[q] == key[0]) & (home[q] == key[1])
    later = pc.less(mine.take(pa.array(q)), names.take(pa.array(p))).to_numpy(zero_copy_only=False)
    q, p = q[~twice | later], p[~twice | later]
    if not len(q):
        return
    own_ranks = _ranks(mine, n)
    for who, other, texts, others, their_n, their_ranks in ((q, p, mine, names, counts, ranks), (p, q, names, mine, n, own_ranks)):
        order = np.lexsort((their_ranks[other], who))
        first = np.flatnonzero(np.diff(who[order], prepend=-1))
        best = other[order][first]
        yield pa.RecordBatch.from_arrays(
            [texts.take(pa.array(who[order][first])), pa.array(np.diff(np.append(first, len(order)))), others.take(pa.array(best)), pa.array(their_n[best])],
            names=["word", "n_near", "best", "best_n"],
        )


def group_variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n and root of every distinct word of ``counts`` (word, n) with ``least_count``.

    Words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its near word
    of largest count (ties: smallest by code points) if that is at least ``ratio`` times the word's own; its root is
    where following forms ends, the word itself without a form. Letter counts of near words differ by two at most, by
    one between lengths, so a k-d tree over them finds all candidates; letters in order decide.

    Null and empty words are ignored, repeated rows of a word are added up; an empty table gives no rows; other columns
    are ignored.
    """
    words = counts.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least_count)
    words = common.stored(words, "words")
    near = near_words(words, cell)
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n"))],
    )
    known = common.stored(known, "near-words")
    root = _roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Where following forms ends: every round doubles the steps taken. Counts grow by a factor with each step, so chains
    are short, and a word is the form of no more words than it has one-letter changes."""
    roots = common.stored(forms.withColumnRenamed("form", "root"), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = common.stored(stepped, "roots")
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return roots
