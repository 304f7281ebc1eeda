"""Repeated byte strings by suffix arrays that are built by external induced sorting.

`suffix_array` sorts all suffixes of a shard by induction: it names the substrings between LMS positions, sorts the string of
names by recursion where names repeat, and induces the order of all other suffixes from there, first of those larger than
their successor, upwards, then of the rest, downwards. Suffixes wait in a priority queue by first symbol; a queue entry is
(symbol, position, common prefix with the entry before it). Within a symbol entries leave in the order they came, which is
their order as suffixes. The queue holds a bounded number of entries in memory and writes the farthest symbols to disk.
Common-prefix values go through the induction: one symbol more than the least of those between the two inducing suffixes.

Over the corpus, texts are first cut into pieces that can only repeat together: the windows of `size` bytes that share a
minimizer. Where all pieces of a minimizer have the same bytes, one name stands for them and no order is needed. Of the
others those whose windows hold a long core that other pieces have too meet in one shard, and in its suffix array repeated
windows are neighbours with a common prefix of at least `size`. A shard is sorted in memory and holds less than twice
SHARD_BYTES; a minimizer whose pieces are more than that is not sorted: its windows are settled by their hashes, which any number of
tasks share.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bitmaps import among, bitmap_of
from .tables import keep, small_batches

SIZE, GRAM = 400, 64
IN_MEMORY = 4 << 20
FEW = 24  # batches up to this go entry by entry, larger ones as arrays
SHARD_BYTES, AHEAD, RANGES = 2 << 20, 8, 4
FINE = 8  # windows of a group, where a hot minimizer's cores are compared once more


class Queue:
    """Entries (position, common prefix) by symbol; symbols leave upwards or downwards, entries of a symbol as they came.

    Beyond `most` entries the symbols whose turn is farthest go to an unnamed file of this task, which ends with the queue.
    """

    def __init__(self, down: bool, most: int = IN_MEMORY):
        self.sign, self.most, self.held = (-1 if down else 1), most, 0
        self.heap: list[int] = []
        self.parts: dict[int, list] = {}
        self.file = None

    def push_one(self, symbol: int, position: int, common: int) -> None:
        waiting = self.parts.get(symbol)
        if waiting is None:
            self.parts[symbol] = [([position], [common])]
            heapq.heappush(self.heap, self.sign * symbol)
        elif waiting and isinstance(waiting[-1][0], list):
            waiting[-1][0].append(position)
            waiting[-1][1].append(common)
        else:
            waiting.append(([position], [common]))
        self.held += 1
        if self.held > self.most:
            self._spill()

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        if symbol not in self.parts:
            self.parts[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        self.parts[symbol].append((position, common))
        self.held += len(position)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for key in sorted(self.heap, reverse=True):
            waiting = self.parts[self.sign * key]
            for i, part in enumerate(waiting):
                if not isinstance(part[0], int):
                    at = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(part[0], np.int64).tobytes() + np.ascontiguousarray(part[1], np.int64).tobytes())
                    waiting[i] = (at, len(part[0]))
                    self.held -= len(part[0])
            if self.held <= self.most // 2:
                break

    def _load(self, part: tuple) -> tuple:
        if not isinstance(part[0], int):
            self.held -= len(part[0])
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(8 * part[1]), np.int64), np.frombuffer(self.file.read(8 * part[1]), np.int64)

    def next_symbol(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, symbol: int) -> tuple | None:
        """What has come for the symbol since the last call; None, and the symbol is done, if nothing has."""
        waiting = self.parts[symbol]
        if not waiting:
            heapq.heappop(self.heap)
            del self.parts[symbol]
            return None
        self.parts[symbol] = []
        if len(waiting) == 1:
            return self._load(waiting[0])
        position, common = zip(*map(self._load, waiting), strict=True)
        return np.concatenate(position), np.concatenate(common)


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S). The last symbol is the least of all and S."""
    n = len(text)
    differs = np.r_[text[1:] != text[:-1], True]
    at = np.flatnonzero(differs)
    ends = at[np.searchsorted(at, np.arange(n))]  # last place of the run of equal symbols
    out = np.ones(n, bool)
    inner = ends < n - 1
    out[inner] = text[ends[inner]] < text[ends[inner] + 1]
    return out


def _run_length(text: np.ndarray, at: int) -> int:
    if text[at + 1] != text[at]:
        return 1
    own = text[at:]
    stop = np.flatnonzero(own != text[at])
    return int(stop[0]) if len(stop) else len(own)


class _Pass:
    """One pass over all symbols; each suffix that leaves the queue hands on its predecessor if that has the pass's type."""

    def __init__(self, text: np.ndarray, takes: np.ndarray, down: bool, most: int):
        self.text, self.takes, self.queue = text, takes, Queue(down, most)
        self.met: set[int] = set()  # symbols that have been handed something
        self.since: dict[int, int] = {}  # those among them from the present symbol: least common prefix since then
        self.symbols, self.ok = text.tolist(), takes.tolist()

    def hand_on(self, position, common) -> None:
        if len(position) > FEW:
            return self._hand_on_many(np.asarray(position, np.int64), np.asarray(common, np.int64))
        since = self.since
        for at, c in zip(position if isinstance(position, list) else position.tolist(), common if isinstance(common, list) else common.tolist(), strict=True):
            for s, was in since.items():
                if c < was:
                    since[s] = c
            if at and self.ok[at - 1]:
                s = self.symbols[at - 1]
                if s in since:
                    self.queue.push_one(s, at - 1, since[s] + 1)
                elif s in self.met:
                    self.queue.push_one(s, at - 1, 1)
                else:
                    self.met.add(s)
                    self.queue.push_one(s, at - 1, 0)
                since[s] = 1 << 40

    def _hand_on_many(self, position: np.ndarray, common: np.ndarray) -> None:
        before = np.maximum(position - 1, 0)
        at = np.flatnonzero((position > 0) & self.takes[before])
        least = int(common.min())
        touched = {}
        if len(at):
            symbol = self.text[before[at]]
            if len(at) > 1:
                order = np.argsort(symbol, kind="stable")
                at, symbol = at[order], symbol[order]
                new = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]).tolist()
                # least common prefix in (previous of the same symbol, this one]
                gap = np.minimum.reduceat(np.r_[common, 0], np.ravel(np.column_stack([np.r_[0, at[:-1] + 1], at + 1])))[::2] if len(new) < len(at) else common[at]
            else:
                new, gap = [0], common[at]
            for k, lo in enumerate(new):
                hi = new[k + 1] if k + 1 < len(new) else len(at)
                s, own = int(symbol[lo]), at[lo:hi]
                given = gap[lo:hi] + 1
                if s in self.since:
                    given[0] = 1 + min(self.since[s], int(common[: own[0] + 1].min()))
                else:
                    given[0] = 1 if s in self.met else 0
                    self.met.add(s)
                self.queue.push(s, before[own], given)
                rest = common[own[-1] + 1 :]
                touched[s] = int(rest.min()) if len(rest) else 1 << 40
        for s, was in self.since.items():
            if s not in touched:
                self.since[s] = min(was, least)
        self.since.update(touched)


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, common: np.ndarray, most: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, downwards, in parts: (positions, common prefix of each with the one before it in this order).

    `lms`: the LMS suffixes in order, `common`: each one's common prefix with the one before.
    """
    up = _Pass(text, ~small, False, most)
    first = text[lms]
    bounds = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(lms) else np.zeros(0, np.int64)
    seeds = {int(first[a]): (a, b) for a, b in zip(bounds, np.r_[bounds[1:], len(lms)], strict=True)}
    turns = sorted(seeds)
    turn = 0
    large: dict[int, list] = {}
    while turn < len(turns) or up.queue.heap:
        waiting = up.queue.next_symbol()
        c = waiting if waiting is not None and (turn == len(turns) or waiting <= turns[turn]) else turns[turn]
        up.since = {}
        last = -1
        if c == waiting:
            up.met.add(c)
            while (part := up.queue.pop(c)) is not None:
                large.setdefault(c, []).append(part)
                last = int(part[0][-1])
                up.hand_on(*part)
        if turn < len(turns) and c == turns[turn]:
            a, b = seeds[c]
            own = common[a:b].copy()
            own[0] = 0 if last < 0 else min(_run_length(text, last), _run_length(text, int(lms[a])))
            up.hand_on(lms[a:b], own)
            turn += 1
    down = _Pass(text, small, True, most)
    symbols = sorted(large)
    while symbols or down.queue.heap:
        waiting = down.queue.next_symbol()
        c = waiting if waiting is not None and (not symbols or waiting >= symbols[-1]) else symbols[-1]
        down.since = {}
        last = -1
        if c == waiting:
            down.met.add(c)
            while (part := down.queue.pop(c)) is not None:
                last = int(part[0][-1])
                yield part
                down.hand_on(*part)
        if symbols and c == symbols[-1]:
            parts = large.pop(symbols.pop())
            position, asc = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
            head = 0 if last < 0 else min(_run_length(text, last), _run_length(text, int(position[-1])))
            if isinstance(position, list):
                position, own = position[::-1], [head, *asc[:0:-1]]
            else:
                position, own = position[::-1], np.r_[head, asc[:0:-1]]
            yield position, own
            down.hand_on(position, own)


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, symbol by symbol for all pairs at once."""
    out = np.zeros(len(a), np.int64)
    open_, step = np.arange(len(a)), 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        inside = (x < len(text)) & (y < len(text))
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[text[x] == text[y]]
        step += 1
        out[open_] = step
    return out


def _upwards(parts: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes upwards with common prefixes, the last symbol's own in front, from the parts of `induce`."""
    position, common = zip((np.zeros(0, np.int64),) * 2, *parts, strict=True)
    position, common = np.concatenate(position), np.concatenate(common)
    return np.r_[n - 1, position[::-1]], np.r_[0, 0, common[::-1][:-1]][: len(position) + 1]


def _names(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranks of substrings of keys, equal for equal ones. Those that share a rank are told apart by one more key at a time."""
    open_ = np.argsort(key[start], kind="stable")
    name, step = np.empty(len(start), np.int64), 0
    n = np.zeros(len(start), np.int64)
    while len(open_):
        # a rank is the number of smaller substrings, so telling some apart moves no others
        k = key[start[open_] + step]
        group = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        new = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (k[1:] != k[:-1])])
        size = np.diff(np.r_[new, len(n)])
        n = np.repeat(n[new] + new - np.repeat(group, np.diff(np.r_[group, len(n)]))[new], size)
        name[open_] = n
        step += 1
        # no substring is the beginning of another: a key tells whether an LMS symbol ends it
        alive = np.repeat(size > 1, size) & (start[open_] + step < stop[open_])
        open_, n = open_[alive], n[alive]
        order = np.lexsort((key[start[open_] + step], n))
        open_, n = open_[order], n[order]
    return np.unique(name, return_inverse=True)[1]


def _sort_lms(text: np.ndarray, small: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes upwards, each with its common prefix with the one before."""
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return lms, np.zeros(len(lms), np.int64)
    name = _names(2 * text + small, lms, np.r_[lms[1:] + 1, len(text)])
    if name.max() + 1 == len(lms):
        order = np.empty_like(lms)
        order[name] = lms
        return order, np.r_[0, _extend(text, order[:-1], order[1:])]
    below = _types(name)
    upper, upper_common = _sort_lms(name, below, most)
    number, equal = _upwards(induce(name, below, upper, upper_common, most), len(name))
    a, b = number[:-1] + equal[1:], number[1:] + equal[1:]
    common = lms[a] - lms[number[:-1]] + _extend(text, lms[a], lms[b])
    return lms[number], np.r_[0, common]


def suffix_array(text: np.ndarray, most: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes downwards in parts, with common prefixes; the last symbol of `text` must be its only least one, and is left out."""
    small = _types(text)
    yield from induce(text, small, *_sort_lms(text, small, most), most)


def _least_between(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of common[a + 1 .. b] for all pairs a < b."""
    level, tables = 1, [common]
    while 2 * level <= len(common):
        tables.append(np.minimum(tables[-1][:-level], tables[-1][level:]))
        level *= 2
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), common.dtype)
    for k in np.unique(power):
        own = power == k
        out[own] = np.minimum(tables[k][a[own] + 1], tables[k][b[own] - (1 << int(k)) + 1])
    return out


def repeated_starts(pieces: list[bytes], size: int, most: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(flags, offsets): which bytes of the pieces start a string of `size` bytes that also starts elsewhere in them.

    Blocks begin where a hash of the next AHEAD bytes says so, so equal strings have equal blocks. The suffixes at blocks are
    sorted as strings of block names; those between are induced from the next block: by the bytes up to it, then by its rank.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    off = np.r_[0, np.cumsum(lengths + 1)]
    raw = np.zeros(int(off[-1]), np.uint8)
    text = np.ones(len(raw), np.int64)
    inner = np.ones(len(raw), bool)
    inner[off[1:] - 1] = False
    raw[inner] = np.frombuffer(b"".join(pieces), np.uint8)
    text[inner] = raw[inner].astype(np.int64) + 2
    row = np.repeat(np.arange(len(pieces)), lengths + 1)
    end = off[1:][row] - 1
    at = np.arange(len(raw))
    run = A.prefix(raw)
    flag = np.zeros(len(raw), bool)

    def alike(key: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        flag[place[order[1:][same]]] = True
        flag[place[order[:-1][same]]] = True

    able = at + AHEAD <= end
    h = A.span_hash(run, at[able], at[able] + AHEAD)
    block = at[able][h >> np.uint64(59) == 0]
    whole = at[at + size <= end]
    after = np.searchsorted(block, whole)
    none = after >= len(block)
    after[none] = 0
    gap = (block[after] if len(block) else np.zeros(0, np.int64)) - whole if len(block) else np.full(len(whole), size)
    apart = none | (gap + AHEAD > size)  # no block begins in the string: a run without variety
    alike(A.span_hash(run, whole[apart], whole[apart] + size), whole[apart])
    whole, after, gap = whole[~apart], after[~apart], gap[~apart]
    if not len(whole):
        return flag, off
    # a block's name: the rank of its bytes and of the AHEAD bytes behind, or of those up to its piece's end
    stop = np.minimum(np.r_[block[1:], len(raw)] + AHEAD, end[block] + 1)
    _, one, own = np.unique(A.span_hash(run, block, stop), return_index=True, return_inverse=True)
    name = _names(text, block[one], stop[one])[own] + 1
    last_of_piece = np.r_[row[block][1:] != row[block][:-1], True]
    names = np.insert(name + 1, np.flatnonzero(last_of_piece) + 1, 1)  # a separator behind each piece's blocks
    number = np.cumsum(np.r_[0, last_of_piece[:-1]]) + np.arange(len(block))  # place of each block in it
    which = np.full(len(names) + 1, -1)
    which[number] = np.arange(len(block))
    parts = list(suffix_array(np.r_[names, 0], most))
    position = np.concatenate([np.asarray(p) for p, _ in parts])
    equal = np.concatenate([np.asarray(c) for _, c in parts])
    # keep the suffixes at blocks; separators sort apart from them
    is_block = which[position] >= 0
    position, equal = position[is_block], equal[is_block]
    begin = block[which[position]]
    common = np.zeros(len(position), np.int64)
    if len(position) > 1:
        a, b = position[:-1], position[1:]
        # equal names end with their piece at the latest; the bytes behind the last equal one are compared as such
        stop_a, stop_b = which[a + equal[1:]], which[b + equal[1:]]
        known = np.where((stop_a >= 0) & (stop_b >= 0), block[np.maximum(stop_a, 0)] - begin[:-1], 0)
        far = known >= size
        common[1:] = np.where(far, size, known + _extend_few(text, begin[:-1] + known, begin[1:] + known, ~far, size))
    rank = np.empty(len(block), np.int64)
    rank[which[position]] = np.arange(len(position))
    before = A.span_hash(run, whole, block[after])
    order = np.lexsort((rank[after], before))
    same = np.flatnonzero(before[order][1:] == before[order][:-1])
    x, y = order[same], order[same + 1]
    rx, ry = rank[after[x]], rank[after[y]]
    ok = gap[x] + _least_between(common, rx, ry) >= size
    flag[whole[x[ok]]] = True
    flag[whole[y[ok]]] = True
    return flag, off


def _extend_few(text: np.ndarray, a: np.ndarray, b: np.ndarray, some: np.ndarray, most: int) -> np.ndarray:
    """Common prefix at a and b, `most` at the utmost, for some of the pairs."""
    out = np.zeros(len(a), np.int64)
    open_, step = np.flatnonzero(some), 0
    while len(open_) and step < most:
        x, y = a[open_] + step, b[open_] + step
        ok = (x < len(text)) & (y < len(text))
        ok[ok] = (text[x[ok]] == text[y[ok]]) & (text[x[ok]] > 1)
        open_ = open_[ok]
        step += 1
        out[open_] = step
    return out


class Windows:
    """Windows of `size` bytes of a block of texts, and the pieces they form by their minimizers."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int, gram: int):
        self.size, self.gram = size, gram
        self.start = A.starts_of(off, size)
        if not len(self.start):
            self.first = self.last = self.h = self.row = np.zeros(0, np.int64)
            self.s = np.zeros(0, np.uint64)
            return
        run = A.prefix(data)
        n = len(data) - gram + 1
        at = A.minimizers(A.span_hash(run, np.arange(n), np.arange(n) + gram), size - gram + 1)[self.start]
        row = np.searchsorted(off, self.start, side="right") - 1
        new = np.r_[True, (at[1:] != at[:-1]) | (self.start[1:] != self.start[:-1] + 1) | (row[1:] != row[:-1])]
        place = np.flatnonzero(new)
        self.first, self.last = self.start[place], self.start[np.r_[place[1:], len(new)] - 1]
        self.row = row[place]
        self.h = A.span_hash(run, at[place], at[place] + gram)
        self.s = A.mix(A.span_hash(run, self.first, self.last + size) ^ A.mix((at[place] - self.first).astype(np.uint64)))
        self.at, self.run = at[place], run

    def cores(self, some: np.ndarray) -> pa.Array:
        """For each of RANGES groups of a piece's windows a hash of the bytes that all of them hold; a window can only repeat
        where its group's bytes do."""
        step = _coarse(self.size, self.gram)
        at, first, last = self.at[some], self.first[some], self.last[some]
        found, owner = [], []
        for k in range(RANGES):
            lo, hi = at - (k + 1) * step + 1, at - k * step  # where the group's windows start, as far as the piece has them
            ok = np.flatnonzero((hi >= first) & (lo <= last))
            found.append(A.span_hash(self.run, hi[ok], lo[ok] + self.size) + np.uint64(k))
            owner.append(ok)
        owner, found = np.concatenate(owner), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return A.lists(A.signed(found[order]), np.searchsorted(owner[order], np.arange(len(some) + 1)))

    def core_of_each(self, step: int) -> np.ndarray:
        """For each window the hash of the bytes that all windows of its group of `step` hold; with step 1 those of the window."""
        at = np.repeat(self.at, self.last - self.first + 1)
        k = (at - self.start) // step
        return A.span_hash(self.run, at - k * step, at - (k + 1) * step + 1 + self.size) + k.astype(np.uint64)


def _coarse(size: int, gram: int) -> int:
    return -(-(size - gram + 1) // RANGES)


def _pieces(size: int, gram: int):
    """Of each block and minimizer: least and greatest piece, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in A.blocks(batch["text"]):
                w = Windows(data, off, size, gram)
                if len(w.h):
                    s = A.signed(w.s)
                    order = np.lexsort((s, w.h))
                    at = np.flatnonzero(np.r_[True, w.h[order][1:] != w.h[order][:-1]])
                    end = np.r_[at[1:], len(order)]
                    yield pa.RecordBatch.from_arrays([pa.array(A.signed(w.h[order][at])), pa.array(s[order][at]), pa.array(s[order][end - 1]), pa.array(end - at)], ["h", "s0", "s1", "n"])

    return run


def _named(size: int, gram: int, whole, mixed):
    """Rows of a text and a minimizer that repeats (whole), of a text and a piece (mixed), and of a piece with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in A.blocks(batch["text"]):
                w = Windows(data, off, size, gram)
                if not len(w.h):
                    continue
                a = np.flatnonzero(among(whole.value, w.h))
                a = a[A.row_first(w.h[a], w.row[a])]
                b = np.flatnonzero(among(mixed.value, w.h))
                one = b[A.row_first(w.s[b], w.row[b])]
                s, first, n = np.unique(w.s[b], return_index=True, return_counts=True)
                c = b[first]
                ids = batch["doc"].take(pa.array(lo + w.row[np.r_[a, one]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(3, dtype=np.int32), [len(a), len(one), len(c)])),
                        pa.array(A.signed(w.h[np.r_[a, one, c]])),
                        pa.array(A.signed(w.s[np.r_[a, one, c]])),
                        pa.concat_arrays([ids, pa.nulls(len(c), pa.int64())]),
                        pa.array(np.r_[np.zeros(len(a) + len(one), np.int64), n]),
                        pa.array([None] * (len(a) + len(one)) + [data[w.first[i] : w.last[i] + size].tobytes() for i in c], pa.binary()),
                        pa.concat_arrays([pa.nulls(len(a) + len(one), pa.list_(pa.int64())), w.cores(c)]),
                    ],
                    ["kind", "h", "s", "doc", "n", "piece", "cores"],
                )

    return run


def _once(likely):
    """The pieces that may repeat in part, each once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            s = batch["s"].to_numpy()
            take = among(likely.value, s.view(np.uint64)) & ~np.isin(s, seen) & A.row_first(s, np.zeros(len(s), np.int64))
            seen = np.r_[seen, s[take]]
            yield batch.filter(pa.array(take))

    return run


def _groups(size: int, gram: int, step: int, known):
    """Of each piece, the groups of `step` windows with one whose cores are all in the bitmaps of `known` [(step, bitmap)]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch["s"].to_numpy()
            for lo, _, data, off in A.blocks(batch["piece"]):
                w = Windows(data, off, size, gram)
                if not len(w.start):
                    continue
                row, first = (np.repeat(x, w.last - w.first + 1) for x in (w.row, w.first))
                some = np.ones(len(w.start), bool)
                for coarser, bitmap in known:
                    some &= among(bitmap.value, w.core_of_each(coarser))
                some, core = np.flatnonzero(some), w.core_of_each(step)
                some = some[A.row_first(core[some], row[some])]
                yield pa.RecordBatch.from_arrays([pa.array(s[lo + row[some]]), pa.array((w.start - first)[some].astype(np.int32)), pa.array(A.signed(core[some]))], ["s", "at", "core"])

    return run


def _settle(pieces: DataFrame, cores: DataFrame, size: int, gram: int) -> DataFrame:
    """Repeated windows of each of `pieces` (s, piece; each s once) by the windows' hashes, as ranges of starts.

    `cores` are those that several pieces have. Groups that share no core of nearly `size` bytes fall away before their windows are
    dealt out, so a passage that is shorter than a window costs little, in however many texts it is.
    """
    kind = "s long, at int, core long"
    known = [(_coarse(size, gram), bitmap_of(cores, "core"))]
    fine = pieces.mapInArrow(_groups(size, gram, FINE, known), kind).groupBy("core").count().where("count > 1")
    known.append((FINE, bitmap_of(fine, "core")))
    windows = keep(pieces.mapInArrow(_groups(size, gram, 1, known), kind), "suffix-windows")
    again = windows.groupBy("core").count().where("count > 1").select("core")
    starts = windows.join(again, "core").groupBy("s").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return starts.select("s", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("edges"))


def _sort_shards(size: int, most: int):
    """Repeated windows of each piece, as ranges of starts; pieces of one minimizer are in one task, in order."""

    def ranges(pieces: list[bytes], s: list[int]) -> pa.RecordBatch:
        flag, off = repeated_starts(pieces, size, most)
        out_s, out = [], []
        for i, key in enumerate(s):
            own = flag[off[i] : off[i + 1] - 1]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist()
            if edge:
                out_s.append(key)
                out.append(edge)
        return pa.RecordBatch.from_arrays([pa.array(out_s, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["s", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, s, held, last = [], [], 0, None
        for batch in batches:
            for h, own, piece in zip(*(batch[c].to_pylist() for c in ("h", "s", "piece")), strict=True):
                if s and own == s[-1]:
                    continue  # from another task
                if h != last and held >= SHARD_BYTES:
                    yield ranges(pieces, s)
                    pieces, s, held = [], [], 0
                pieces.append(piece), s.append(own)
                held, last = held + len(piece), h
        if pieces:
            yield ranges(pieces, s)

    return run


def _cut(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["found"].to_pylist()
            n_bytes, n_removed, spans, rests = [], [], [], []
            for lo, hi, data, off in A.blocks(batch["text"]):
                w = Windows(data, off, size, gram)
                at = np.searchsorted(w.row, np.arange(hi - lo + 1))
                cover = np.zeros(len(data) + 1, np.int64)
                for i in range(hi - lo):
                    if found[lo + i]:
                        own = slice(at[i], at[i + 1])
                        whole = np.array([f["h"] for f in found[lo + i] if f["edges"] is None], np.int64)
                        hit = np.isin(A.signed(w.h[own]), whole)
                        np.add.at(cover, w.first[own][hit], 1)
                        np.add.at(cover, w.last[own][hit] + size, -1)
                        part: dict[int, list[int]] = {}
                        for f in found[lo + i]:
                            if f["edges"] is not None:
                                part.setdefault(f["h"], []).extend(f["edges"])
                        for s, first in zip(A.signed(w.s[own]).tolist(), w.first[own].tolist(), strict=True) if part else ():
                            edges = part.get(s, ())
                            for a, b in zip(edges[::2], edges[1::2], strict=True):
                                cover[first + a] += 1
                                cover[first + b - 1 + size] -= 1
                dead = np.cumsum(cover)[:-1] > 0
                for i in range(hi - lo):
                    a, b = int(off[i]), int(off[i + 1])
                    d = dead[a:b]
                    edge = np.flatnonzero(np.diff(np.r_[False, d, False].astype(np.int8))).reshape(-1, 2)
                    n_bytes.append(b - a), n_removed.append(int(d.sum()))
                    spans.append([{"start": x, "end": y} for x, y in edge.tolist()])
                    rests.append(data[a:b][~d].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(rests, pa.binary())], ["doc", "n_bytes", "n_removed", "spans", "rest"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, most: int = IN_MEMORY) -> DataFrame:
    """Every text, as UTF-8 bytes, without what lies in a string of `size` bytes that starts anywhere else as well.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed byte ranges) and rest (binary). Null texts are empty. Rows that
    share an id or repeat in full are texts of their own, so each removes the other's strings; null ids are kept. Matches do not
    cross texts. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(size, gram), "h long, s0 long, s1 long, n long")
    several = pieces.groupBy("h").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.sum("n").alias("n")).where("n > 1")
    several = keep(several.select("h", (F.col("s0") == F.col("s1")).alias("whole")), "suffix-groups")
    whole, mixed = several.where("whole").select("h"), several.where("NOT whole").select("h")
    named = keep(texts.mapInArrow(_named(size, gram, bitmap_of(whole, "h"), bitmap_of(mixed, "h")), "kind int, h long, s long, doc long, n long, piece binary, cores array<long>"), "suffix-named")
    held = named.where("kind = 2").withColumn("last", F.octet_length("piece") - size + 1)
    counted = held.groupBy("s").agg(F.first("h").alias("h"), F.sum("n").alias("n"), F.first("last").alias("last"), F.first("cores").alias("cores"))
    cores = counted.select("s", F.explode("cores").alias("core"))
    common = keep(cores.groupBy("core").count().where("count > 1").select("core"), "suffix-cores")
    likely = bitmap_of(cores.join(common, "core").select("s").distinct(), "s")
    # minimizers with more than a shard; at most one for SHARD_BYTES of pieces
    hot = keep(counted.groupBy("h").agg(F.sum(F.col("last") + size - 1).alias("held")).where(F.col("held") > SHARD_BYTES).select("h"), "suffix-hot")
    kind, pieces = "h long, s long, piece binary", held.select("h", "s", "piece")
    shards = pieces.join(F.broadcast(hot), "h", "left_anti").mapInArrow(_once(likely), kind).repartition("h").sortWithinPartitions("h", "s")
    partly = shards.mapInArrow(_sort_shards(size, most), "s long, edges array<int>")
    if not hot.isEmpty():
        crowd = pieces.join(F.broadcast(hot), "h", "left_semi").mapInArrow(_once(likely), kind)
        crowd = keep(crowd.groupBy("s").agg(F.first("piece").alias("piece")), "suffix-crowd")
        partly = partly.unionAll(_settle(crowd, common, size, gram))
    wholly = counted.where("n > 1").select("s", F.array(F.lit(0), F.col("last").cast("int")).alias("edges"))
    repeated = keep(partly.unionAll(wholly), "suffix-repeats")
    found = named.where("kind = 0").select("doc", "h").join(whole, "h").select("doc", F.struct("h", F.lit(None).cast("array<int>").alias("edges")).alias("f"))
    found = found.unionAll(named.where("kind = 1").select("doc", "s").join(repeated, "s").select("doc", F.struct(F.col("s").alias("h"), "edges").alias("f")))
    found = found.groupBy(F.coalesce("doc", F.lit(_NULL)).alias("at")).agg(F.collect_list("f").alias("found"))
    cut = texts.withColumn("at", F.coalesce("doc", F.lit(_NULL))).join(found, "at", "left").select("doc", "text", "found").mapInArrow(_cut(size, gram), "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, rest binary")
    return cut.withColumnRenamed("doc", "doc_id")


_NULL = -(1 << 63)
