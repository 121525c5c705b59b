"""Benchmark passages in documents: character and word seeds, lower bounds of whole windows, exact edit distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm import common

#: Largest edit distance of a leak as a share of the item's characters.
MAX_EDIT = 0.2
#: Lengths of character seeds, and how many undamaged runs of a seed's length an item must have on average if its edits
#: lie at random: none at all has a chance of exp(-RUNS), 1%. With 4 characters some run is always left.
SEEDS = (12, 10, 8, 6, 5, 4)
RUNS = 4.6
#: Words of a word seed: of 9 words or more with every fifth changed, three neighbours are always left.
WORDS = 3
#: Shorter items in characters must be held word by word; any common phrase is within a few edits of them.
MIN_CHARS = 16
#: Bytes of benchmark text that are handed to the tasks at once.
BLOCK_BYTES = 16 << 20

#: Kinds of characters: 0 parts words, 1 belongs to a word, 2 is a word of its own (scripts without blanks).
_KIND = np.ones(0x110000, np.uint8)
_KIND[:0x80] = 0
_KIND[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = 1
for _a, _b in ((0x80, 0xC0), (0x2000, 0x2070), (0x3000, 0x3040), (0xFE10, 0xFE70), (0xFF00, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66)):
    _KIND[_a:_b] = 0
_KIND[[0xAA, 0xB5, 0xBA, 0xD7, 0xF7]] = [1, 1, 1, 0, 0]
_KIND[0x3005:0x3008] = 2
for _a, _b in ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3000), (0x3040, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000)):
    _KIND[_a:_b] = 2
_MUL = np.uint64(0xD6E8FEB86659FD93)
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)
#: Candidates that are made together, and those that are looked at together.
_TOGETHER = 1 << 21
_CHUNK = 1 << 13
#: Bytes of text that are searched together, and places of them that are hashed and marked together.
_SLICE = 1 << 21
_STRETCH = 1 << 16
#: Pieces of an item beside a seed, outwards from the character next to it: characters of a piece, its distance from the
#: seed, how far edits may have shifted it, and the log of the places that are looked at. Near pieces have few places to
#: lie in, so that shorter ones tell enough.
_BESIDE = [(3, 3 * k + 1, k + 1, 5 if k < 8 else 6) for k in range(16)] + [(4, 4 * k + 49, k + 17, 6 if k < 8 else 7) for k in range(40)]
_REACH = _BESIDE[-1][0] + _BESIDE[-1][1]
#: How many of the pieces so many characters hold.
_STEPS = np.searchsorted([far + q for q, far, _, _ in _BESIDE], np.arange(_REACH + 1), "right").astype(np.uint8)
#: Logs of the places of a block and of the bytes whose bits mark its pieces.
_BLOCK, _BYTES = 4, 8
#: Room between items, more than eight pieces take.
_ROOM = 8 * max(q for q, _, _, _ in _BESIDE)


class Spelled:
    """Texts in lower case as words with one blank between them, none between two characters of a script without blanks.

    ``chars`` are the code points of all rows, ``rows`` the rows' offsets in them; ``starts``, ``ends`` and ``row`` are
    of each word, ``alone`` marks words of one character of a script without blanks.
    """

    def __init__(self, column: pa.Array) -> None:
        data, offsets = common.text_bytes(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(code) != len(data):
            offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        kind = _KIND[code]
        a, b, r = common.spans(kind == 1, offsets)
        lone = np.flatnonzero(kind == 2)
        if len(lone):
            a, b = np.concatenate([a, lone]), np.concatenate([b, lone + 1])
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            r = np.searchsorted(offsets, a, side="right") - 1
        self.row = r
        self.alone = kind[a] == 2 if len(a) else np.zeros(0, bool)
        blank = np.zeros(len(a), np.int64)
        blank[1:] = (r[1:] == r[:-1]) & ~(self.alone[1:] & self.alone[:-1])
        size = b - a
        self.ends = np.cumsum(size + blank)
        self.starts = self.ends - size
        self.chars = np.full(int(self.ends[-1]) if len(a) else 0, 0x20, np.uint32)
        inside = np.repeat(self.starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(a) else []
        if len(a):
            self.chars[inside] = code[(kind > 0)]
        self.words = np.searchsorted(r, np.arange(len(column) + 1))
        self.rows = np.concatenate([[0], self.ends])[self.words]
        self.short = (self.chars ^ (self.chars >> np.uint32(16))).astype(np.uint16)

    def text(self, a: int, b: int) -> str:
        return self.chars[a:b].tobytes().decode("utf-32-le")

    def seeds(self, lengths: Iterable[int], first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Hashes of as many characters as each of ``lengths`` says from every place on, of all places or a stretch.

        The last places read padding.
        """
        last = len(self.short) if last is None else last
        padded = np.zeros(last - first + max(*lengths, 4), np.uint16)
        part = self.short[first : first + len(padded)]
        padded[: len(part)] = part
        four, size = np.ndarray(len(padded) - 3, "<u8", padded, strides=(2,)), last - first
        start = four[:size] * _MUL
        mixed = start ^ (start >> np.uint64(29))
        for n in lengths:
            out = start
            for at in sorted({*range(4, n - 3, 4), n - 4} - {0}):
                out = mixed if out is start else out ^ (out >> np.uint64(29))
                out = out + four[at : at + size]
                out *= _MUL
            yield n, out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words of a row, and the runs' hashes."""
        first = np.arange(max(0, len(self.row) - n + 1))
        first = first[self.row[first] == self.row[first + n - 1]]
        return first, common.span_hashes(self.short, self.starts[first], self.ends[first + n - 1])


def _table(keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    have, first, times = np.unique(keys[order], return_index=True, return_counts=True)
    shift = np.uint64(64 - min(max(len(have).bit_length() + 4, 12), 24))
    # by the upper bits of a key: whether one has them, and the place of the first
    known, place = np.zeros(1 << (64 - int(shift)), bool), np.zeros(1 << (64 - int(shift)), np.int32)
    known[keys >> shift] = True
    place[(have >> shift)[::-1]] = np.arange(len(have) - 1, -1, -1)
    return shift, known, place, np.append(have, ~np.uint64(0)), first, np.append(times, 0), item[order], offset[order]


def _hits(table: tuple[np.ndarray, ...], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index in keys, item, offset in the item) of all keys that the table holds, in bounded pieces."""
    shift, known, place, have, first, times, item, offset = table
    top = (keys >> shift).view(np.int64)
    hit = np.flatnonzero(known.take(top))
    at, key = place[top[hit]].astype(np.int64), keys[hit]
    low = np.flatnonzero(have[at] < key)
    while len(low):
        at[low] += 1
        low = low[have[at[low]] < key[low]]
    same = np.flatnonzero((have[at] == key) & (times[at] > 0))
    hit, lo, times = hit[same], first[at[same]], times[at[same]]
    total = np.concatenate([[0], np.cumsum(times)])
    i = 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _TOGETHER, "right")) - 1)
        entry = np.repeat(lo[i:j] - total[i:j], times[i:j]) + np.arange(total[i], total[j])
        yield np.repeat(hit[i:j], times[i:j]), item[entry], offset[entry]
        i = j


def seed_chars(chars: int, max_edit: float = MAX_EDIT) -> int:
    """Length of the seeds of an item: the longest that leaves RUNS undamaged ones on average."""
    return next((n for n in SEEDS if chars * max_edit * (1 - max_edit) ** n >= RUNS), SEEDS[-1])


class Items:
    """A block of benchmark items: their spelling, their seeds by length, their word seeds, and their pieces."""

    def __init__(self, ids: list, texts: list[str | None], max_edit: float = MAX_EDIT) -> None:
        s = Spelled(pa.array(texts, pa.string()))
        self.ids = ids
        self.lengths = np.diff(s.rows)
        self.chars = [s.text(a, b) for a, b in zip(s.rows, s.rows[1:], strict=False)]
        self.text = [c.encode() for c in self.chars]
        self.limits = (max_edit * self.lengths).astype(np.int64)
        self.band = np.maximum(self.lengths // 8, 1)
        where = np.repeat(np.arange(len(ids)), self.lengths)
        offset = np.arange(len(where)) - s.rows[where] if len(where) else np.zeros(0, np.int64)
        served = np.array([seed_chars(n, max_edit) if n >= MIN_CHARS else 0 for n in self.lengths], np.int64)
        self.seeds = {}
        for n in SEEDS:
            keep = np.flatnonzero((served[where] == n) & (offset + n <= self.lengths[where])) if len(where) else []
            if len(keep):
                self.seeds[n] = _table(next(s.seeds([n]))[1][keep], where[keep], offset[keep])
        first, keys = s.windows(WORDS)
        keep = (self.lengths[s.row[first]] >= MIN_CHARS) & ~s.alone[first] & ~s.alone[first + WORDS - 1]
        self.words = _table(keys[keep], s.row[first[keep]], s.starts[first[keep]] - s.rows[s.row[first[keep]]])
        # short items: the whole of their words
        self.whole = {}
        n_words = np.diff(s.words)
        for n in sorted(set(n_words[(self.lengths < MIN_CHARS) & (n_words > 0)].tolist())):
            first, keys = s.windows(n)
            keep = (n_words[s.row[first]] == n) & (self.lengths[s.row[first]] < MIN_CHARS)
            self.whole[n] = _table(keys[keep], s.row[first[keep]], np.zeros(keep.sum(), np.int64))
        # the items with room between them, so that pieces beyond an item are none
        self.first = s.rows[:-1] + _ROOM * np.arange(1, len(ids) + 1)
        place = np.repeat(self.first, self.lengths) + offset
        self.short = np.zeros(int(s.rows[-1]) + _ROOM * (len(ids) + 1), np.uint16)
        self.short[place] = s.short
        self.marks = {}
        for q in {q for q, _, _, _ in _BESIDE}:
            marks = np.zeros((2, len(self.short) + _ROOM), np.uint8)
            inside = place[offset + q <= self.lengths[where]]
            marks[:, inside] = np.array(_marks(self.short, q))[:, inside]
            # of eight pieces in a row
            eight = np.stack([marks[:, k * q : k * q + len(self.short)] for k in range(8)], axis=2)
            self.marks[q] = eight.view(np.uint64)[:, :, 0]
        byte = _bytes(s.short)
        self.pieces = []
        for o in range(0, int(self.lengths.max(initial=0)), 64):
            size = np.clip(self.lengths - o, 0, 64)
            at = np.flatnonzero((offset >= o) & (offset < o + 64))
            bits = np.zeros(len(ids) * 256, np.uint64)
            np.bitwise_or.at(bits, where[at] * 256 + byte[at], np.uint64(1) << (offset[at] - o).astype(np.uint64))
            self.pieces.append((o, size, bits))


def _bytes(short: np.ndarray) -> np.ndarray:
    return (short ^ (short >> np.uint16(8))).astype(np.uint8)


def _marks(short: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit that mark the ``q`` characters from every place on."""
    four = np.ndarray(len(short), "<u8", np.pad(short, (0, 4)), strides=(2,))
    mark = (((four << np.uint64(64 - 16 * q)) * _MUL) >> np.uint64(61 - _BYTES)).astype(np.uint16)
    return (mark >> np.uint16(3)).astype(np.uint8), _BIT[mark & np.uint16(7)]


class Beside:
    """Which pieces of a few characters start in the blocks of a stretch of a text, by marks of their hashes."""

    def __init__(self, short: np.ndarray, first: int, last: int) -> None:
        margin = 2 * _REACH
        self.first = first - margin
        blocks = ((last - first + 2 * margin) >> _BLOCK) + 1
        part = np.zeros(blocks << _BLOCK, np.uint16)
        a, b = max(0, self.first), min(len(short), self.first + len(part))
        part[a - self.first : b - self.first] = short[a:b]
        row = np.arange(blocks) << _BYTES
        self.marks = {}
        for q in {q for q, _, _, _ in _BESIDE}:
            byte, bit = _marks(part, q)
            marks = np.zeros(blocks << _BYTES, np.uint8)
            for x in range(1 << _BLOCK):
                marks[row + byte[x :: 1 << _BLOCK]] |= bit[x :: 1 << _BLOCK]
            # marks of 1, 2, 4 and so on blocks in a row
            wide, n = marks.view(np.uint64), 1 << (_BYTES - 3)
            for w in range(_BLOCK + 1, max(w for p, _, _, w in _BESIDE if p == q) + 1):
                more = np.empty_like(wide)
                np.bitwise_or(wide[:-n], wide[n:], out=more[:-n])
                more[-n:] = wide[-n:]
                wide, n = more, 2 * n
                self.marks[q, w] = wide.view(np.uint8)

    def possible(self, s: Spelled, items: Items, at: np.ndarray, item: np.ndarray, offset: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which seeds, each of ``n`` characters and the first of a run, may be undamaged parts of leaks.

        The item is cut into pieces outwards from the seed. Before an undamaged piece there are at least as many edits as
        places it is shifted by. So a piece that is not in the text within as many places as there are pieces before it
        means one edit more than these can have, in the piece or before it. If such pieces are more than the limit, no
        leak has this seed undamaged. Marks may show a piece that is not there, never hide one.
        """
        start, left, right = items.first[item] + offset, offset, items.lengths[item] - offset - n
        spare = np.minimum(items.limits[item], 1 << 14).astype(np.int16)
        spare -= left > 0
        spare -= (right > 0) & (s.short.take(at + n, mode="clip") != items.short[start + n])
        other = _STEPS.take(left, mode="clip")
        for room, forward in ((right, True), (left, False)):
            steps = _STEPS.take(room, mode="clip")
            more, other = steps + other, np.zeros(len(at), np.uint8)
            piece, place = (start + n, at + n - self.first) if forward else (start, at - self.first)
            alive = np.arange(len(at))
            for k in range(0, len(_BESIDE), 8):
                # neither dropped nor sure to stay
                can = spare[alive]
                alive = alive[(steps[alive] > k) & (can >= 0) & (can < more[alive].view(np.int8) - np.int16(k))]
                if not len(alive):
                    break
                q, far, _, w = _BESIDE[k]
                move = far + q * np.arange(8) if forward else -far - q * np.arange(8, 0, -1)
                shifted = np.arange(k + 1, k + 9)[:: 1 if forward else -1]
                of = piece[alive] + move[0]
                byte, bit = (m.take(of).view(np.uint8).reshape(-1, 8).T for m in items.marks[q])
                spot = (place[alive] << (_BYTES - _BLOCK)) + ((move - shifted) << (_BYTES - _BLOCK))[:, None]
                spot &= -1 << _BYTES
                spot += byte
                there = self.marks[q, w].take(spot)
                there &= bit
                seen = np.add.reduce(there > 0, axis=0, dtype=np.uint8)
                spare[alive] -= np.minimum(steps[alive] - np.uint8(k), 8) - seen
        return spare >= 0


def least_edits(pattern: bytes | str, text: bytes | str) -> int:
    """Smallest edit distance between ``pattern`` and any substring of ``text``, by bit-parallel columns."""
    if not pattern:
        return 0
    if pattern in text:
        return 0
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int | str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        flat = eq | down
        cross = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(cross | up))
        fall = up & cross
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(flat | rise))
        down = rise & flat
        best = min(best, score)
    return best


def _near(s: Spelled, items: Items, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the windows around candidate places that may hold a leak.

    The least edits of an item's pieces of 64 characters, each near its own place, add up to no more than the item's.
    They are counted by bit-parallel columns for many places at once, and a place is dropped when the sum passes the
    limit, so nothing is lost.
    """
    one, margin = np.uint64(1), int((items.lengths + 2 * items.limits + items.band).max(initial=0)) + 64
    byte = np.pad(_bytes(s.short).astype(np.int32), margin)
    item = places >> 40
    begin = ((places & ((1 << 40) - 1)) - (1 << 39)) * items.band[item]
    order = np.argsort(items.lengths[item], kind="stable")
    for x in range(0, len(order), 4096):
        i, b = item[order[x : x + 4096]], begin[order[x : x + 4096]]
        total = np.zeros(len(i), np.int64)
        for o, sizes, bits in items.pieces:
            size = sizes[i]
            if not len(i) or not size.any():
                break
            k = int(items.limits[i].max())
            start, base, shift = b + (o - k + margin), i.astype(np.int32) * 256, np.maximum(size - 1, 0).astype(np.uint64)
            start = np.clip(start, 0, len(byte) - 1)
            up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
            score, rise, top = size.copy(), np.empty_like(up), np.empty_like(up)
            best = size.copy()
            for t in range(min(64 + 2 * k + int(items.band[i].max()), len(byte) - int(start.max()))):
                eq = bits[base + byte[start + t]]
                cross = eq & up
                cross += up
                cross ^= up
                cross |= eq
                eq |= down
                np.bitwise_or(cross, up, out=rise)
                np.invert(rise, out=rise)
                rise |= down
                cross &= up
                for edge, change in ((rise, np.add), (cross, np.subtract)):
                    np.right_shift(edge, shift, out=top)
                    top &= one
                    change(score, top.view(np.int64), out=score)
                rise <<= one
                cross <<= one
                np.bitwise_and(rise, eq, out=down)
                eq |= rise
                np.invert(eq, out=eq)
                np.bitwise_or(cross, eq, out=up)
                np.minimum(best, score, out=best)
            total += best
            keep = total <= items.limits[i]
            i, b, total = i[keep], b[keep], total[keep]
        m, k, w = items.lengths[i], items.limits[i], items.band[i]
        yield from zip(i.tolist(), (b - k).tolist(), (b + m + k + w).tolist(), strict=True)


def _firsts(s: Spelled, items: Items, first: int, last: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, item, offset in the item, length) of the seeds in a stretch of a text, of a run of equal characters the first."""
    for n, keys in s.seeds(list(items.seeds), first, last):
        for hit, item, offset in _hits(items.seeds[n], keys):
            hit += first
            same = s.short[hit - 1] == items.short[items.first[item] + offset - 1]
            keep = np.flatnonzero((offset == 0) | (hit == 0) | ~same)
            yield hit[keep], item[keep], offset[keep], np.full(len(keep), n)


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of ``parts`` in parts of ``size`` and a last one."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            for i in range(0, n - size + 1, size):
                yield tuple(c[i : i + size] for c in rows)
            held = [tuple(c[n // size * size :] for c in rows)]
            n %= size
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def leaks(text: pa.Array, items: Items, max_edit: float) -> list[tuple[int, int, int]]:
    """(row, item position, edit distance) of the items that the texts hold, each pair once with its least distance."""
    s = Spelled(text)
    if not len(s.row):
        return []
    best = {}
    for n, table in items.whole.items():
        first, keys = s.windows(n)
        for hit, item, _ in _hits(table, keys):
            for w, i in zip(first[hit].tolist(), item.tolist(), strict=True):
                if items.chars[i] == s.text(s.starts[w], s.ends[w + n - 1]):
                    best[int(s.row[w]), i] = 0
    places = []

    def note(at: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        places.append(np.unique((item << 40) + (at - offset) // items.band[item] + (1 << 39)))

    for x in range(0, len(s.short) if items.seeds else 0, _STRETCH):
        y = min(x + _STRETCH, len(s.short))
        beside = Beside(s.short, x, y)
        for part in _gathered(_firsts(s, items, x, y), _CHUNK):
            keep = beside.possible(s, items, *part)
            note(*[c[keep] for c in part[:3]])
    first, keys = s.windows(WORDS)
    for hit, item, offset in _hits(items.words, keys):
        note(s.starts[first[hit]], item, offset)
    if not places:
        return [(r, i, d) for (r, i), d in sorted(best.items())]
    for i, a, b in _near(s, items, np.unique(np.concatenate(places))):
        a, b = max(a, 0), min(b, len(s.chars))
        # a window over several rows is looked at in each of them
        for r in range(int(np.searchsorted(s.rows, a, "right")) - 1, int(np.searchsorted(s.rows, b, "left"))):
            low, high = max(a, int(s.rows[r])), min(b, int(s.rows[r + 1]))
            limit = int(max_edit * items.lengths[i])
            if high - low < items.lengths[i] - limit or best.get((r, i), limit + 1) == 0:
                continue
            distance = least_edits(items.chars[i], s.text(low, high))
            if distance <= limit and distance < best.get((r, i), limit + 1):
                best[r, i] = distance
    return [(r, i, d) for (r, i), d in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_bytes: int, max_edit: float) -> Iterator[Items]:
    """The benchmark in blocks of proven size, one at a time; a benchmark of ordinary size is one block."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = benchmark.where(part == k).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], max_edit)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edit_distance, item_chars for every item that a document holds.

    Texts are lower-cased and cut into runs of letters and digits; in scripts without blanks every character is a word.
    Places where a document shares a seed with an item (WORDS neighbouring words, or as many characters as seed_chars
    says, if the characters beside them leave a leak possible) are compared with the whole item: its least edit distance
    in characters to any passage there is exact and at most ``max_edit`` of the item's length. Documents stay where they are: no shuffle. A benchmark above ``block_bytes``
    is handled in blocks, one pass each.

    No leak is missed whose item has at most every fifth word changed (9 words or more), or some undamaged run of a
    seed's length; of edits scattered at random up to ``max_edit`` about 1% of the leaks have neither. Items under
    MIN_CHARS characters are found as exact copies of their words only.

    Null or empty texts and an empty benchmark give no rows; items without letters and digits are not looked for; a null
    doc_id or item_id is carried as null; equal documents give equal rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, edit_distance long, item_chars long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.sparkSession.createDataFrame([], schema)
    for k, items in enumerate(_blocks(benchmark, block_bytes, max_edit)):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, "text", _SLICE):
                    found = leaks(part.column("text"), items, max_edit)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64())),
                            pa.array([items.ids[i] for _, i, _ in found], pa.int64()),
                            pa.array([d for _, _, d in found], pa.int64()),
                            pa.array([len(items.chars[i]) for _, i, _ in found], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "edit_distance", "item_chars"],
                    )

        block = rows.mapInArrow(run, schema)
        out = block if k == 0 else out.unionByName(block)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; see find_leaks."""
    schema = T.StructType(list(docs.schema.fields))
    for items in _blocks(benchmark, block_bytes, max_edit):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, "text", _SLICE):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, _, _ in leaks(pc.cast(part.column("text"), pa.string()), items, max_edit)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
