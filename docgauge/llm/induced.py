"""Suffix sorting with common-prefix values, by external induced sorting.

Sorts all suffixes of many fragments up to a bounded depth.  The suffixes at
left-most minima (S*) are sorted first; scanning the sequence upwards, each
sorted suffix puts the suffix before it, if it is larger than its own successor
(type L), into the queue of that suffix's first byte; scanning downwards, types S
are put likewise.  A tuple is (place, rank of its successor); within a first
byte's queue tuples stand in order of that rank, so the queues together are the
priority queue, and beyond `IN_MEMORY` tuples they go to disk.

Common-prefix values are carried along: two neighbours in a queue share one byte
more than the least value between their successors' ranks.

As only `depth` bytes matter, the S* suffixes are told apart by that many bytes,
which ends the recursion at its first level.
"""

from __future__ import annotations

import tempfile

import numpy as np

IN_MEMORY = 2_000_000


class Queues:
    """A first-in-first-out queue of (place, rank) per first byte; the largest part of what is held goes to disk."""

    def __init__(self):
        self.held: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list[tuple[int, int]]] = {}
        self.size, self.disk = 0, None

    def put(self, byte: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(byte, kind="stable")
        by = byte[order]
        rows = np.stack([place[order], rank[order]])
        cut = np.flatnonzero(np.diff(by, prepend=-1)) if len(by) else []
        for a, b in zip(cut, [*cut[1:], len(by)]):
            self.held.setdefault(int(by[a]), []).append(rows[:, a:b])
        self.size += len(by)
        if self.size > IN_MEMORY:
            self.disk = self.disk or tempfile.TemporaryFile()
            for c, parts in self.held.items():
                data = np.ascontiguousarray(np.concatenate(parts, axis=1))
                self.disk.seek(0, 2)
                self.files.setdefault(c, []).append((self.disk.tell(), data.shape[1]))
                self.disk.write(data.tobytes())
            self.held, self.size = {}, 0

    def take(self, c: int) -> np.ndarray:
        parts = []
        for at, n in self.files.pop(c, []):
            self.disk.seek(at)
            parts.append(np.frombuffer(self.disk.read(16 * n), np.int64).reshape(2, n))
        new = self.held.pop(c, [])
        self.size -= sum(x.shape[1] for x in new)
        return np.concatenate([*parts, *new], axis=1) if parts or new else np.zeros((2, 0), np.int64)

    def close(self) -> None:
        if self.disk:
            self.disk.close()


def _words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros after the end."""
    long = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | long[k : k + len(t)]
    return out


def _byte_lcp(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of numbers that aren't 0."""
    top = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        top += (x >> np.uint64(64 - 8 * k)) == 0
    return top


class InducedSort:
    """`fragments`: bytes without 255. After `run`, `places` (in the joined text) in order and `lcp` with the one before, both up to `depth`."""

    def __init__(self, fragments: list[bytes], depth: int):
        self.depth = depth
        raw = np.frombuffer(b"\xff".join([*fragments, b""]), np.uint8)
        self.text = (raw + np.uint8(1)).astype(np.uint8)  # a fragment's end is 0, other bytes are 1 more
        n = len(raw)
        self.starts = np.cumsum([0, *[len(f) + 1 for f in fragments]])[:-1]
        ends = np.flatnonzero(self.text == 0)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes up to the fragment's end
        step = np.sign(np.diff(self.text.astype(np.int16), append=0))
        following = np.where(step != 0, np.arange(n), n - 1)
        following = np.minimum.accumulate(following[::-1])[::-1]
        self.larger = step[following] < 0  # type L: larger than its successor
        self.larger[ends] = False

    def _direct(self, a: int, b: int) -> int:
        n = int(min(self.left[a], self.left[b], self.depth))
        same = self.text[a : a + n] == self.text[b : b + n]
        return n if same.all() else int(same.argmin())

    def _minima(self) -> tuple[np.ndarray, np.ndarray]:
        """S* places but the ends in order, and their common-prefix values."""
        t = self.text
        at = np.flatnonzero(~self.larger & (t > 0))
        at = at[(at > 0)]
        at = at[self.larger[at - 1]]
        if not len(at):
            return at, np.zeros(0, np.int64)
        words, keys = _words(t), []
        for k in range(0, self.depth, 8):
            rest = np.clip(self.left[at] - k, 0, 8)
            x = words[np.minimum(at + k, len(t) - 1)]
            keep = np.where(rest == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(rest, 1).astype(np.uint64)))
            keys.append(x & keep)
        order = np.lexsort((at, *keys[::-1]))
        at, lcp, same = at[order], np.zeros(len(order), np.int64), np.ones(len(order), bool)
        for k, x in enumerate(keys):
            x = x[order]
            gap = np.concatenate([x[:1], x[1:] ^ x[:-1]])
            here = same & (gap != 0)
            lcp[here] = 8 * k + _byte_lcp(gap[here])
            same &= gap == 0
        lcp[same] = self.depth
        lcp[1:] = np.minimum(lcp[1:], np.minimum(self.left[at[1:]], self.left[at[:-1]]))
        lcp[0] = 0
        return at, np.minimum(lcp, self.depth)

    def _pass(self, firsts: dict[int, tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, up: bool):
        """One scan. `firsts`: per byte what is sorted already (places, lcp), standing after what is put there by induction. Gives per byte what was induced."""
        queues, t, out = Queues(), self.text, {}
        upto, chunks = 0, []
        lcp_at = np.zeros(0, np.int64)
        filled = 0

        def add(places: np.ndarray, lcps: np.ndarray, byte: int):
            nonlocal filled, lcp_at
            n = len(places)
            if filled + n > len(lcp_at):
                lcp_at = np.concatenate([lcp_at[:filled], np.zeros(max(n, len(lcp_at), 1024), np.int64)])
            lcp_at[filled : filled + n] = lcps
            ranks = np.arange(filled, filled + n)
            filled += n
            before = places - 1
            ok = before >= 0
            before, ranks = before[ok], ranks[ok]
            ok = wanted[before] & (t[before] > 0)
            before, ranks = before[ok], ranks[ok]
            same = t[before] == byte
            queues.put(t[before[~same]].astype(np.int64), before[~same], ranks[~same])
            return before[same], ranks[same]

        def between(last_rank, ranks: np.ndarray) -> np.ndarray:
            """For tuples in order of rank: one more than the least value between neighbours; the first against `last_rank`."""
            at = ranks if last_rank is None else np.concatenate([[last_rank], ranks])
            low = np.minimum.reduceat(lcp_at[:filled], np.minimum(at[:-1] + 1, filled - 1)) if len(at) > 1 else np.zeros(0, np.int64)
            if len(at) > 1:
                low[-1] = lcp_at[at[-2] + 1 : at[-1] + 1].min()
            low = np.minimum(low + 1, self.depth)
            return np.concatenate([[0], low]) if last_rank is None else low

        order = range(0, 256) if up else range(255, -1, -1)
        for c in order:
            rows, induced, lcps, last, tail = queues.take(c), [], [], None, None
            place, rank = rows
            while len(place):
                values = between(last, rank)
                induced.append(place)
                lcps.append(values)
                last, tail = rank[-1], place[-1]
                place, rank = add(place, values, c)
            own = (np.concatenate(induced), np.concatenate(lcps)) if induced else (np.zeros(0, np.int64),) * 2
            out[c] = own
            if c in firsts:
                places, values = firsts[c]
                if len(places):
                    values = values.copy()
                    values[0] = self._direct(int(tail), int(places[0])) if tail is not None and c else 0
                    more = add(places, values, c)
                    # what follows from sorted suffixes in the same byte's own queue can't be: their kind differs
                    assert not len(more[0])
        queues.close()
        return out

    def run(self) -> InducedSort:
        t = self.text
        at, lcp = self._minima()
        firsts = {0: (np.flatnonzero(t == 0), np.zeros(int((t == 0).sum()), np.int64))}
        cut = np.flatnonzero(np.diff(t[at].astype(np.int64), prepend=-1)) if len(at) else []
        for a, b in zip(cut, [*cut[1:], len(at)]):
            firsts[int(t[at[a]])] = (at[a:b], lcp[a:b])
        larger = self._pass(firsts, self.larger, up=True)
        down = {c: (p[::-1], np.concatenate([[0], v[1:][::-1]]).astype(np.int64)) for c, (p, v) in larger.items() if len(p)}
        smaller = self._pass(down, ~self.larger, up=False)
        places, lcps = [], []
        for c in range(1, 256):
            big, small = larger.get(c, ((), ())), smaller.get(c, ((), ()))
            p = np.concatenate([np.asarray(big[0], np.int64), np.asarray(small[0], np.int64)[::-1]])
            v = np.concatenate([np.asarray(big[1], np.int64), [0] * (len(small[0]) > 0), np.asarray(small[1], np.int64)[1:][::-1]])
            if len(big[0]) and len(small[0]):
                v[len(big[0])] = self._direct(int(p[len(big[0]) - 1]), int(p[len(big[0])]))
            places.append(p)
            lcps.append(v)
        self.places, self.lcp = np.concatenate(places).astype(np.int64), np.concatenate(lcps).astype(np.int64)
        return self
