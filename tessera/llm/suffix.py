"""Suffix and common-prefix order of a text in files, by external induced sorting.

A suffix is of type S if it is smaller than the next one, else of type L; the S
suffixes behind an L one are the stars.  A first induction sorts the stars'
substrings (up to the next star) and names them; the string of the names is sorted
by recursion, which gives the stars' order; a second induction gives the order of
all suffixes.  This holds at every level of the recursion, for any alphabet.

An induction is two scans.  The first goes up: each scanned suffix hands the one
before it, if that is of type L, to a queue by its first character; the stars are
fed in behind the L suffixes of their character.  The second goes down: the same
with S for L, fed with the L suffixes from the first scan's queue.  `_Scan` is both,
with characters negated in the second.

Queues are by buckets of characters.  A bucket of several characters holds at most
`memory` // TUPLE suffixes and is put in order in memory at once: tuples that come
from earlier buckets stand before those whose next suffix lies in the bucket itself,
and the latter are ranked by the next suffix's rank, in as many rounds as they are
deep.  A character that has more suffixes is a bucket alone and streams through its
queue in parts, as tuples of one character leave in the order they came.

A tuple carries its position, the characters before it (eight bytes or two names,
read from the text anew only when they are used up), its first character, the common
prefix with the queue's tuple of that character before it, and how often its first
character repeats.  A handed-on prefix is one more than the least prefix scanned
since.  The stars' prefixes come from the recursion's: the lengths of the common
names, and the least prefix between the names that differ.  Prefixes are capped at
`cap` characters, the depth anyone asks for, and so is the order.

The text, the names, the stars and the tuples are in unnamed files of the task beyond
what `memory` allows, like the spills of a sort; nothing of them outlives the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that a shard's queues and buckets may take in memory, and working bytes for each suffix of a bucket.
MEMORY, TUPLE = 96_000_000, 1000
#: position, the characters before it, its first character, common prefix, repeats of the first character
_KINDS = (np.int64, np.uint64, np.uint32, np.uint8, np.uint8)
Columns = tuple[np.ndarray, ...]


def scratch(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of zeros; in an unnamed file if it is larger than a small part of the memory."""
    size = max(n, 1) * np.dtype(kind).itemsize
    if size <= memory // 32:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(prefix="suffix-") as file:
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=max(n, 1))[:n]


class Queues:
    """First-in first-out queues of tuples by bucket; beyond `memory` bytes they are in a file, whose parts are used again."""

    def __init__(self, memory: int, n: int = 2**40, bits: int = 32):
        self.memory, self.size = memory, 0
        self.kinds = (np.uint32 if n < 2**32 else np.int64, np.uint64, np.uint8 if bits == 8 else np.uint32, np.uint8, np.uint8)
        self.width = sum(np.dtype(k).itemsize for k in self.kinds)
        self.parts: dict[int, list] = {}
        self.file, self.end, self.free = None, 0, []

    def put(self, bucket: int, columns: Columns) -> None:
        self.parts.setdefault(bucket, []).append(tuple(x.astype(k) for x, k in zip(columns, self.kinds, strict=True)))
        self.size += self.width * len(columns[0])
        if self.size > self.memory:
            self.file = self.file or tempfile.TemporaryFile(prefix="suffix-")
            for parts in self.parts.values():
                for k, part in enumerate(parts):
                    if not isinstance(part[0], int):
                        at = self._place(self.width * len(part[0]))
                        self.file.seek(at)
                        self.file.write(b"".join(x.tobytes() for x in part))
                        parts[k] = (at, len(part[0]))
            self.size = 0

    def _place(self, size: int) -> int:
        """Where a part goes in the file: the first free stretch among the last ones, or the end."""
        for k in range(len(self.free) - 1, max(-1, len(self.free) - 65), -1):
            at, room = self.free[k]
            if room >= size:
                self.free[k] = (at + size, room - size)
                if room == size:
                    self.free.pop(k)
                return at
        self.end += size
        return self.end - size

    def take(self, bucket: int, most: int, backwards: bool = False) -> Iterator[Columns]:
        """The tuples of a bucket, about `most` at a time; those that come meanwhile too.  Backwards: from the last ones to the first."""
        while parts := self.parts.get(bucket):
            held, n = [], 0
            while parts and n < most:
                held.append(self._part(parts.pop(-1 if backwards else 0)))
                n += len(held[-1][0])
            yield _joined(held[::-1] if backwards else held)
        self.parts.pop(bucket, None)

    def _part(self, part: tuple) -> Columns:
        if isinstance(part[0], int):
            self.file.seek(part[0])
            raw, at, n, columns = self.file.read(self.width * part[1]), 0, part[1], []
            self.free.append((part[0], len(raw)))
            for kind in self.kinds:
                columns.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            part = tuple(columns)
        else:
            self.size -= self.width * len(part[0])
        return tuple(x.astype(k) for x, k in zip(part, _KINDS, strict=True))


def _joined(parts: list[Columns]) -> Columns:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, k) for k in _KINDS)


class _Least:
    """Least values of ranges of bytes."""

    def __init__(self, values: np.ndarray, array: Callable = np.empty):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:], out=array(len(last) - step, np.uint8)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, inclusive; a <= b."""
        out = self.levels[0][b]
        wide = np.flatnonzero(a < b)
        level = np.zeros(len(a), np.int8)
        level[wide] = np.frexp((b[wide] - a[wide] + 1).astype(np.float32))[1] - 1
        for k in np.flatnonzero(np.bincount(level, minlength=1)[1:]) + 1:
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - 2**k + 1])
        return out


class Buckets:
    """Ranges of characters: the first of each, and which hold one character of more than `most` suffixes."""

    def __init__(self, counts: np.ndarray, most: int):
        self.most, self.chars, first, self.big = most, len(counts), [], []
        at = 0
        while at < len(counts):
            part = np.cumsum(counts[at : at + most], dtype=np.int64)
            first.append(at)
            self.big.append(bool(part[0] > most))
            at += max(1, int(np.searchsorted(part, most, "right")))
        self.first = np.array(first)

    def of(self, chars: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, chars, "right") - 1


class _Scan:
    """One scan over a level's text; up: from the least character, else from the greatest."""

    def __init__(self, text: np.ndarray, bits: int, buckets: Buckets, cap: int, memory: int, up: bool):
        self.text, self.bits, self.buckets, self.cap, self.memory, self.up = text, np.uint64(bits), buckets, cap, memory, up
        self.queues = Queues(memory, len(text), bits)

    def _key(self, char: np.ndarray) -> np.ndarray:
        return char.astype(np.int64) if self.up else self.buckets.chars - 1 - char.astype(np.int64)

    def _before(self, position: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The characters before, read anew where they are used up; 0 only at the text's start."""
        at = np.flatnonzero((before == 0) & (position > 0))
        if not len(at):
            return before
        at = at[np.argsort(position[at], kind="stable")]
        p, out, value = position[at], before.copy(), np.zeros(len(at), np.uint64)
        for k in range(64 // int(self.bits), 0, -1):
            value = value << self.bits | np.where(p >= k, self.text[np.maximum(p - k, 0)], 0).astype(np.uint64)
        out[at] = value
        return out

    def _handed(self, columns: Columns, seed: np.ndarray) -> tuple[Columns, np.ndarray, Columns]:
        """The tuples with their characters before, which of them hand one on, and those that are handed on (prefix not set)."""
        position, before, char, prefix, run = columns
        before = self._before(position, before)
        columns = position, before, char, prefix, run
        front = (before & np.uint64((1 << int(self.bits)) - 1)).astype(np.uint32)
        key, own = self._key(front), self._key(char)
        at = np.flatnonzero((position > 0) & ((key > own) | (~seed & (key == own))))
        again = np.where(front[at] == char[at], np.minimum(run[at].astype(np.int16) + 1, self.cap), 1)
        return columns, at, (position[at] - 1, before[at] >> self.bits, front[at], np.zeros(len(at), np.uint8), again.astype(np.uint8))

    def _send(self, at: np.ndarray, handed: Columns, prefix: np.ndarray, since: np.ndarray | None = None) -> None:
        """Queue what the scanned suffixes `at` hand on.  prefix: of all scanned; since: the least prefix since each character's last tuple, 0 for none."""
        position, before, char, _, run = handed
        if len(at):
            order = np.argsort(char, kind="stable")
            at, position, before, char, run = at[order], position[order], before[order], char[order], run[order]
            fresh = np.append(True, char[1:] != char[:-1])
            least = _Least(prefix)
            value = np.zeros(len(at), np.uint8)
            inner = np.flatnonzero(~fresh)
            value[inner] = least.of(at[inner - 1] + 1, at[inner])
            heads = np.flatnonzero(fresh)
            if since is not None:
                value[heads] = np.minimum(since[char[heads]], least.of(np.zeros(len(heads), np.int64), at[heads]))
        if since is not None:
            np.minimum(since, prefix.min(), out=since)
            if len(at):
                last = at[np.append(heads[1:], len(at)) - 1]
                since[char[heads]] = self.cap
                more = last + 1 < len(prefix)
                since[char[heads[more]]] = least.of(last[more] + 1, np.full(more.sum(), len(prefix) - 1))
        if not len(at):
            return
        value = np.minimum(value.astype(np.int16) + 1, self.cap).astype(np.uint8)
        bucket = self.buckets.of(char)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.queues.put(int(bucket[a]), (position[a:b], before[a:b], char[a:b], value[a:b], run[a:b]))

    def run(self, seeds: Callable[[int], Iterator[Columns]]) -> Iterator[tuple[int, Columns, np.ndarray]]:
        """Bucket, tuples in scan order, and which are seeds.  A tuple's prefix is with the one before it, 0 where characters differ."""
        many = range(len(self.buckets.first))
        for bucket in many if self.up else reversed(many):
            yield from ((bucket, *x) for x in (self._streamed if self.buckets.big[bucket] else self._at_once)(bucket, seeds))

    def _streamed(self, bucket: int, seeds: Callable[[int], Iterator[Columns]]) -> Iterator[tuple[Columns, np.ndarray]]:
        since, last = scratch(self.buckets.chars, np.uint8, self.memory), None
        for seed, source in ((False, self.queues.take(bucket, self.buckets.most)), (True, seeds(bucket))):
            head = True
            for part in source:
                for a in range(0, len(part[0]), self.buckets.most):
                    columns = tuple(x[a : a + self.buckets.most] for x in part)
                    if head:  # the first tuple, or the first seed behind the others
                        first = 0 if last is None else min(last, columns[4][0]) if seed else columns[3][0]
                        columns = (*columns[:3], np.append(np.uint8(first), columns[3][1:]), columns[4])
                        head = False
                    flags = np.full(len(columns[0]), seed)
                    columns, at, handed = self._handed(columns, flags)
                    self._send(at, handed, columns[3], since)
                    last = columns[4][-1]
                    yield columns, flags

    def _at_once(self, bucket: int, seeds: Callable[[int], Iterator[Columns]]) -> Iterator[tuple[Columns, np.ndarray]]:
        came, fed = _joined(list(self.queues.take(bucket, self.buckets.most))), _joined(list(seeds(bucket)))
        order = np.argsort(self._key(came[2]), kind="stable")
        parts = [tuple(x[order] for x in came), fed]
        n, first = len(order) + len(fed[0]), len(order)
        if not n:
            return
        seed = np.append(np.zeros(first, bool), np.ones(len(fed[0]), bool))
        # members found from others of the bucket: those found in one round are one deeper than the round before
        found, next_of, sent, lo = _joined(parts), [np.full(n, -1)], [], 0
        every: list[Columns] = []
        while len(found[0]):
            found, at, handed = self._handed(found, seed if not every else np.zeros(len(found[0]), bool))
            every.append(found)
            inside = self.buckets.of(handed[2]) == bucket
            sent.append((at[~inside] + lo, tuple(x[~inside] for x in handed)))
            next_of.append(at[inside] + lo)
            lo += len(found[0])
            found = tuple(x[inside] for x in handed)
        position, before, char, prefix, run = _joined(every)
        after = np.concatenate(next_of)
        own = after >= 0
        seed = np.append(seed, np.zeros(len(own) - n, bool))
        # by character: those that came from other buckets, then those found here by what follows them, then the seeds
        key, mine = self._key(char), np.flatnonzero(own)
        order = np.argsort(key * 3 + 2 * seed + own, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        slots, key = np.sort(rank[mine]), key[mine] * len(order)
        for _ in range(min(len(every), self.cap) if len(mine) else 0):  # a round for each depth, or for each character that counts
            by = np.argsort(key + rank[after[mine]], kind="stable")
            if (rank[mine[by]] == slots).all():
                break
            rank[mine[by]] = slots
        order[rank] = np.arange(len(rank))
        char, prefix, run, seed, own, after = char[order], prefix[order].copy(), run[order], seed[order], own[order], after[order]
        same = np.append(False, char[1:] == char[:-1])
        prefix[~same] = 0
        edge = np.flatnonzero(same & seed & np.append(False, ~seed[:-1]))
        prefix[edge] = np.minimum(run[edge - 1], run[edge])
        prefix[same & own] = 1  # behind one that came from another bucket
        pair = np.flatnonzero(same & own & np.append(False, own[:-1]))
        if len(pair):
            a, b = rank[after[pair - 1]], rank[after[pair]]
            a, b = np.minimum(a, b) + 1, np.maximum(a, b)  # the other way round only beyond the cap
            prefix[pair] = self.cap
            live = np.arange(len(pair))
            while len(live):  # from above; a value is right once the lesser ones are
                value = np.minimum(_Least(prefix).of(a[live], b[live]).astype(np.int16) + 1, self.cap).astype(np.uint8)
                moved = pair[live[value != prefix[pair[live]]]]
                prefix[pair[live]] = value
                seen = np.zeros(len(prefix) + 1, np.int32)
                seen[moved + 1] = 1
                np.cumsum(seen, out=seen)
                live = np.flatnonzero(seen[b + 1] > seen[a])
        at = rank[np.concatenate([x[0] for x in sent])]
        handed = _joined([x[1] for x in sent])
        by = np.argsort(at, kind="stable")
        self._send(at[by], tuple(x[by] for x in handed), prefix)
        yield (position[order], before[order], char, prefix, run), seed


class _Level:
    """One level of the recursion: text is positive but for a last 0."""

    def __init__(self, text: np.ndarray, bits: int, counts: np.ndarray, cap: int, memory: int):
        self.text, self.bits, self.cap, self.memory = text, bits, cap, memory
        self.buckets = Buckets(counts, max(4, memory // TUPLE))
        self._classify()

    def _array(self, n: int, kind: type) -> np.ndarray:
        return scratch(n, kind, self.memory)

    def _classify(self) -> None:
        """Find the stars from the text's end to its start: places, repeats of their first character, and queues of them for the first induction."""
        step, n = self.buckets.most, len(self.text)
        self.rough = Queues(self.memory // 4, n, self.bits)
        found = Queues(self.memory // 4, n, self.bits)
        rising, going, count = True, 1, 0
        for lo in range((n - 1) // step * step, -1, -step):
            a, hi = max(lo - 1, 0), min(lo + step, n)
            part = np.asarray(self.text[a : min(hi + 1, n)]).astype(np.int64)
            m = hi - a  # of them, types are found for m
            turn = np.flatnonzero(part[1:] != part[:-1]) if len(part) > 1 else np.zeros(0, np.int64)
            which = np.searchsorted(turn, np.arange(m))
            known = which < len(turn)
            ends = turn[which[known]]
            is_s, run = np.full(m, rising), np.empty(m, np.int64)
            is_s[known] = part[ends + 1] > part[ends]
            run[known] = ends + 1 - np.flatnonzero(known)
            run[~known] = len(part) - 1 - np.flatnonzero(~known) + going if hi < n else m - np.flatnonzero(~known)
            star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
            run = np.minimum(run, self.cap)
            char = part[star].astype(np.uint32)
            columns = (star + a).astype(np.int64), np.zeros(len(star), np.uint64), char, np.ones(len(star), np.uint8), run[star].astype(np.uint8)
            if len(star):
                found.put(0, tuple(c[::-1] for c in columns))  # the whole queue goes down
                count += len(star)
                order = np.argsort(char, kind="stable")
                bucket = self.buckets.of(char[order])
                edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    self.rough.put(int(bucket[x]), tuple(c[order[x:y]] for c in columns))
            rising, going = bool(is_s[lo - a]), int(run[lo - a])
        self.stars, self.star_run = self._array(count + 1, np.int64), self._array(count, np.uint8)
        at = 0
        for position, _, _, _, run in found.take(0, step, backwards=True):
            self.stars[at : at + len(position)], self.star_run[at : at + len(run)] = position[::-1], run[::-1]
            at += len(position)
        self.stars[count] = n  # a place behind the last one
        self.count = count

    def _induce(self, seeds: Callable[[int], Iterator[Columns]]) -> Iterator[tuple[Columns, np.ndarray]]:
        """All suffixes from the greatest to the least; which of them are of type L."""
        kept = Queues(self.memory // 4, len(self.text), self.bits)
        for bucket, columns, seed in _Scan(self.text, self.bits, self.buckets, self.cap, self.memory // 4, True).run(seeds):
            if not seed.all():
                kept.put(bucket, tuple(x[~seed] for x in columns))

        def backwards(bucket: int) -> Iterator[Columns]:
            carried = np.uint8(0)
            for position, before, char, prefix, run in kept.take(bucket, self.buckets.most, backwards=True):
                yield position[::-1], before[::-1], char[::-1], np.append(carried, prefix[:0:-1]), run[::-1]
                carried = prefix[0]

        down = _Scan(self.text, self.bits, self.buckets, self.cap, self.memory // 4, False)
        last = len(self.text) - 1
        down.queues.put(0, tuple(np.array([v], k) for v, k in zip((last, 0, 0, 0, 1), _KINDS, strict=True)))
        for _, columns, seed in down.run(backwards):
            yield columns, seed

    def _names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stars' substrings named in their order: the names by star, each name's common prefix with the one below, and its number."""

        def seeds(bucket: int) -> Iterator[Columns]:
            for part in self.rough.take(bucket, self.buckets.most) if self.buckets.big[bucket] else [_joined(list(self.rough.take(bucket, self.buckets.most)))]:
                order = np.argsort(part[2], kind="stable")
                yield (*(x[order] for x in part[:4]), np.ones(len(order), np.uint8))  # substrings end behind one character

        names, mask = self._array(self.count, np.uint32), np.uint64((1 << self.bits) - 1)
        below, number = Queues(self.memory // 8), -1
        carried, last = self.cap, None
        for (position, before, char, prefix, _), is_l in self._induce(seeds):
            front = (before & mask).astype(np.uint32)
            at = np.flatnonzero(~is_l & (position > 0) & (front > char))
            if not len(at):
                carried = min(carried, int(prefix.min()))
                continue
            common = np.minimum.reduceat(prefix[: at[-1] + 1], np.append(0, at[:-1] + 1))
            common[0] = min(common[0], carried)
            carried = int(prefix[at[-1] + 1 :].min(initial=self.cap))
            star = np.searchsorted(self.stars[: self.count], position[at])
            size = self._size(star)
            former = np.append(size[:1] if last is None else last, size[:-1])
            fresh = ~((common >= self.cap) | ((common >= size) & (size == former)))
            fresh[0] |= last is None
            last = size[-1]
            name = number + np.cumsum(fresh)
            names[star], number = name, int(name[-1])
            values, counts = np.unique(name, return_counts=True)
            starts = np.zeros(len(values), np.uint8)
            starts[np.searchsorted(values, name[fresh])] = common[fresh]
            below.put(0, (values, counts.astype(np.uint64), np.zeros(len(values), np.uint32), starts, np.zeros(len(values), np.uint8)))
        total = number + 1
        prefixes, counts = self._array(total + 1, np.uint8), self._array(total, np.uint32)
        for values, n, _, common, _ in below.take(0, self.buckets.most):
            np.add.at(counts, total - 1 - values, n.astype(np.uint32))
            np.maximum.at(prefixes, total - values, common)  # 0 where a name goes on from the part before
        for a in range(0, self.count, self.buckets.most):
            names[a : a + self.buckets.most] = total - 1 - names[a : a + self.buckets.most]
        return names, prefixes[:total], counts

    def _size(self, star: np.ndarray) -> np.ndarray:
        """Characters of the stars' substrings, the next star's first one included."""
        return np.where(star + 1 < self.count, self.stars[star + 1] - self.stars[star] + 1, 1)

    def _common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes that share `known` characters, where the names can't tell."""
        out, live, n = known.copy(), np.arange(len(a)), len(self.text)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[(np.maximum(x, y) < n) & (self.text[np.minimum(x, n - 1)] == self.text[np.minimum(y, n - 1)])]
            out[live] += 1
            live = live[out[live] < self.cap]
        return out

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """The stars in order, and each one's common prefix with the one before."""
        names, prefixes, counts = self._names()
        order, shared = self._array(self.count, np.int64), self._array(self.count + 1, np.uint8)
        if len(counts) == self.count:
            for a in range(0, self.count, self.buckets.most):
                order[names[a : a + self.buckets.most]] = np.arange(a, min(a + self.buckets.most, self.count))
            depth = self.cap
        else:
            depth, at = (self.cap + 1) // 2, self.count
            for position, common in suffixes(names, 32, counts, depth, self.memory):
                order[at - len(position) : at] = position[::-1]
                shared[at - len(position) + 1 : at + 1] = common[::-1]  # each with the one above
                at -= len(position)
        least, common = _Least(prefixes, self._array), self._array(self.count, np.uint8)
        for lo in range(1, self.count, self.buckets.most):
            hi = min(lo + self.buckets.most, self.count)
            a, b, names_common = np.asarray(order[lo - 1 : hi - 1]), np.asarray(order[lo:hi]), shared[lo:hi].astype(np.int64)
            if len(counts) == self.count:
                names_common[:] = 0
            out = np.full(len(a), self.cap, np.int64)
            at = np.flatnonzero((names_common < depth) & (np.maximum(a, b) + names_common < self.count))
            x, y, k = a[at], b[at], names_common[at]
            known = self.stars[y + k] - self.stars[y]
            near = known < self.cap
            at, x, y, k, known = at[near], x[near], y[near], k[near], known[near]
            inner = least.of(names[x + k].astype(np.int64) + 1, names[y + k].astype(np.int64)).astype(np.int64)
            value = np.minimum(known + inner, self.cap)
            unsure = (inner >= np.minimum(self._size(x + k), self._size(y + k))) & (value < self.cap)  # the substrings differ by the type of a last character only
            value[unsure] = self._common(self.stars[x[unsure]], self.stars[y[unsure]], value[unsure])
            out[at] = value
            common[lo:hi] = np.minimum(out, self.cap)
        return order, common

    def sorted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order, common = self._order() if self.count > 1 else (np.zeros(1, np.int64), np.zeros(1, np.uint8))
        firsts = self._array(self.count, np.uint32)
        for a in range(0, self.count, self.buckets.most):
            firsts[a : a + self.buckets.most] = self.text[self.stars[order[a : a + self.buckets.most]]]
        edges = np.searchsorted(firsts, np.append(self.buckets.first, self.buckets.chars))

        def seeds(bucket: int) -> Iterator[Columns]:
            for a in range(edges[bucket], edges[bucket + 1], self.buckets.most):
                b = min(a + self.buckets.most, edges[bucket + 1])
                star = np.asarray(order[a:b])
                yield np.asarray(self.stars[star]), np.zeros(len(star), np.uint64), np.asarray(firsts[a:b]), np.asarray(common[a:b]), np.asarray(self.star_run[star])

        for (position, _, _, prefix, _), _ in self._induce(seeds):
            yield position, prefix


def suffixes(text: np.ndarray, bits: int, counts: np.ndarray, cap: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all suffixes from the greatest to the least, by their first `cap` (< 256) characters, and each one's common prefix with the one before in this order.

    text: positive but for a last 0, of 8 or 32 bits a character; counts: how often each character occurs.
    """
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
    else:
        yield from _Level(text, bits, counts, max(cap, 2), memory).sorted()


class Shard:
    """Bytes (none of them 255) in a file, and the runs of equal windows among them."""

    def __init__(self, window: int, memory: int = MEMORY):
        self.window, self.memory, self.size = window, memory, 0
        self.counts = np.zeros(257, np.int64)
        self.file = tempfile.TemporaryFile(prefix="suffix-")

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def add(self, raw: np.ndarray) -> None:
        self.file.write((raw + np.uint8(1)).tobytes())
        self.counts[1:] += np.bincount(raw, minlength=256)
        self.size += len(raw)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of windows in such an order that equal ones stand together, and the common prefix with the one before; only of windows that have an equal one, and no run is cut."""
        self.file.write(b"\0")
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r", shape=self.size + 1)
        counts = self.counts.copy()
        counts[0] = 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for position, common in suffixes(text, 8, counts[: np.flatnonzero(counts)[-1] + 1], self.window, self.memory):
            starts = np.flatnonzero(common < self.window)
            if len(starts):
                held.append((position[: starts[-1]], common[: starts[-1]]))
                yield from self._repeated(held)
                held = []
                position, common = position[starts[-1] :], common[starts[-1] :]
            held.append((position, common))
        yield from self._repeated(held)

    def _repeated(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        position, common = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        same = common >= self.window
        same |= np.append(same[1:], False)
        if same.any():
            yield position[same], common[same]
