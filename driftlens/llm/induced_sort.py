"""Suffix order and common prefixes of one shard by external induced sorting.

Suffixes are classed as L (greater than their successor) or S. The leftmost S suffixes are sorted on the string of
their names; from them the L suffixes are induced in one ascending scan, from those the S suffixes in one descending
scan. A scan is a monotone priority queue with a bucket a character: what is taken out in order pushes its
predecessors into buckets not yet passed, together with the common prefix with the bucket's last entry, which is one
more than the least common prefix met in between. Buckets hold (position, common prefix) tuples in blocks; blocks
beyond a memory limit lie in a temporary file of the task until their bucket is reached, and a large text is
memory-mapped from such a file, so a shard may exceed memory. Common prefixes are capped at DEPTH, and suffixes that
agree on DEPTH bytes need no further order.
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH = 200
MEMORY = 64_000_000  # bytes of queued tuples, and of text, that stay in memory


class BucketQueue:
    """A priority queue over byte keys whose smallest (or largest) bucket is emptied first; blocks spill to disk."""

    def __init__(self, memory: int = MEMORY):
        self.blocks: list[list] = [[] for _ in range(256)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, key: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        size = positions.nbytes + prefixes.nbytes
        if self.held + size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes() + prefixes.tobytes())
            self.blocks[key].append((at, len(positions)))
        else:
            self.held += size
            self.blocks[key].append((positions, prefixes))

    def take(self, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The blocks of a bucket in the order they came; the bucket is empty then."""
        out = []
        for first, second in self.blocks[key]:
            if isinstance(first, int):
                self.file.seek(first)
                raw = self.file.read(5 * second)
                out.append((np.frombuffer(raw, np.int32, second), np.frombuffer(raw, np.uint8, second, 4 * second)))
            else:
                self.held -= first.nbytes + second.nbytes
                out.append((first, second))
        self.blocks[key] = []
        # neighbours are joined as far as memory allows, so that a scan handles few large arrays
        joined, part, size = [], [], 0
        for block in out:
            if part and size + len(block[0]) > self.memory // 40:
                joined.append(part)
                part, size = [], 0
            part.append(block)
            size += len(block[0])
        joined += [part] if part else []
        return [(np.concatenate([p for p, _ in x]), np.concatenate([q for _, q in x])) for x in joined]


class RangeMinimum:
    """Minima of spans of an array of bytes, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least value of each span [start, end), none of them empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.uint8)
        for k in np.unique(level):
            own = level == k
            row = self.levels[k]
            out[own] = np.minimum(row[start[own]], row[end[own] - (1 << k)])
        return out


class Scan:
    """One pass of induction over text; least[c] is the least common prefix met since the last push into bucket c."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, memory: int):
        self.text, self.wanted, self.queue = text, wanted, BucketQueue(memory)
        self.least = np.zeros(256, np.uint8)

    def visit(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Take entries in order (prefixes: with the entry before each) and push the wanted predecessors."""
        if not len(positions):
            return
        before = positions - 1
        at = np.flatnonzero(self.wanted[before] & (positions > 0))
        least = prefixes.min()
        if not len(at):
            np.minimum(self.least, least, out=self.least)
            return
        keys = self.text[before[at]]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        first = np.ones(len(at), bool)
        first[1:] = keys[1:] != keys[:-1]
        start = np.zeros(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[first] = 0
        minima = RangeMinimum(prefixes)
        shared = minima.over(start, at + 1)
        shared[first] = np.minimum(shared[first], self.least[keys[first]])
        shared = np.minimum(shared, DEPTH - 1) + np.uint8(1)
        cuts = np.append(np.flatnonzero(first), len(at))
        # what follows the last push into each bucket
        np.minimum(self.least, least, out=self.least)
        last = at[cuts[1:] - 1]
        tail = np.full(len(last), 255, np.uint8)
        more = last + 1 < len(prefixes)
        if more.any():
            tail[more] = minima.over(last[more] + 1, np.full(more.sum(), len(prefixes)))
        self.least[keys[cuts[:-1]]] = tail
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.queue.push(int(keys[a]), before[at[a:b]], shared[a:b])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number that orders as they do; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(DEPTH + 16, np.uint8)])
    value = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        value <<= np.uint64(8)
        value |= padded[k : k + len(value)]
    return value


def _common(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes a and b of a text of n bytes up to DEPTH, by comparison of eight bytes at a time."""
    out = np.full(len(a), DEPTH, np.int64)
    live = np.arange(len(a))
    for k in range(0, DEPTH, 8):
        differ = words[a[live] + k] ^ words[b[live] + k]
        ends = differ != 0
        if ends.any():
            high = np.zeros(int(ends.sum()), np.int64)
            rest = differ[ends]
            for byte in range(1, 8):
                high += rest < np.uint64(1 << (64 - 8 * byte))
            out[live[ends]] = k + high
            live = live[~ends]
        if not len(live):
            break
    return np.minimum(out, np.minimum(DEPTH, n - np.maximum(a, b))).astype(np.uint8)


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(known[::-1])[::-1]
    return step[after] > 0


def _sorted_seeds(words: np.ndarray, seeds: np.ndarray, depth: int = 0, most: int = 50_000) -> np.ndarray:
    """Leftmost S suffixes that agree on depth bytes, in order of DEPTH bytes at least.

    Eight bytes order most of them; those that tie are compared on all the rest, most at a time, and a larger set that
    ties on the same eight bytes recurses on the bytes behind.
    """
    m = len(seeds)
    if m < 2 or depth >= DEPTH:
        return seeds
    value = words[seeds + depth]
    order = np.argsort(value, kind="stable")
    out, value = seeds[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(new, m))
    tied, size = new[size > 1], size[size > 1]
    steps = np.arange(depth + 8, max(DEPTH, depth + 16), 8)
    k = 0
    while k < len(tied):
        upto = k + max(1, int(np.searchsorted(np.cumsum(size[k : k + most]), most, "right")))
        if size[k] > most:
            a, b = int(tied[k]), int(tied[k] + size[k])
            out[a:b] = _sorted_seeds(words, out[a:b], depth + 8, most)
        else:
            slots = np.repeat(tied[k:upto] - np.concatenate([[0], np.cumsum(size[k:upto])[:-1]]), size[k:upto]) + np.arange(size[k:upto].sum())
            own = out[slots]
            rows = np.concatenate([np.repeat(np.arange(upto - k, dtype=np.uint64), size[k:upto])[:, None], words[np.minimum(own[:, None] + steps, len(words) - 1)]], 1)
            strings = np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel()
            out[slots] = own[np.argsort(strings, kind="stable")]
        k = upto
    return out


def sorted_suffixes(text: np.ndarray, memory: int = MEMORY):
    """Yield (positions, prefixes) of all suffixes of a byte array in descending order of DEPTH bytes at least.

    A prefix is the number of bytes, DEPTH at most, that a suffix shares with the one yielded before it.
    """
    n = len(text)
    if not n:
        return
    if n > memory:
        kept = tempfile.TemporaryFile()
        kept.write(text.tobytes())
        kept.flush()
        text = np.memmap(kept, np.uint8, "r", shape=(n,))
    small = _types(text)
    starts = small.copy()
    starts[0] = False
    starts[1:] &= ~small[:-1]
    words = _words(text)
    seeds = _sorted_seeds(words, np.flatnonzero(starts).astype(np.int64)).astype(np.int32)
    seed_keys = text[seeds]
    seed_cuts = np.searchsorted(seed_keys, np.arange(257))

    ascending = Scan(text, ~small, memory)
    large = BucketQueue(memory)  # what the first scan found, for the second
    ascending.queue.push(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    for key in range(256):
        last = None
        ascending.least[:] = 0 if key == 0 else ascending.least
        fresh = True
        while blocks := ascending.queue.take(key):
            for positions, prefixes in blocks:
                if fresh:
                    prefixes = prefixes.copy()
                    prefixes[0], fresh = 0, False
                large.push(key, positions, prefixes)
                last = positions[-1]
                ascending.visit(positions, prefixes)
        own = seeds[seed_cuts[key] : seed_cuts[key + 1]]
        if len(own):
            before = np.concatenate([own[:1] if last is None else [last], own[:-1]]).astype(np.int64)
            prefixes = _common(words, n, before, own.astype(np.int64))
            if last is None:
                prefixes[0] = 0
            ascending.visit(own, prefixes)

    descending = Scan(text, small, memory)
    for key in range(255, -1, -1):
        last, fresh = None, True
        while blocks := descending.queue.take(key):
            for positions, prefixes in blocks:
                if fresh:
                    prefixes = prefixes.copy()
                    prefixes[0], fresh = 0, False
                last = positions[-1]
                yield positions, prefixes
                descending.visit(positions, prefixes)
        blocks = large.take(key)
        for k in range(len(blocks) - 1, -1, -1):
            positions = blocks[k][0][::-1]
            # prefixes belong to the entry and the one before it in ascending order, so they move on by one
            prefixes = np.empty(len(positions), np.uint8)
            prefixes[1:] = blocks[k][1][:0:-1]
            prefixes[0] = 0 if last is None else _common(words, n, np.array([last], np.int64), positions[:1].astype(np.int64))[0]
            last = positions[-1]
            yield positions, prefixes
            descending.visit(positions, prefixes)


def repeated_starts(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """True at every position whose DEPTH bytes stand at another position of text too."""
    out = np.zeros(len(text), bool)
    last = None
    for positions, prefixes in sorted_suffixes(text, memory):
        same = prefixes >= DEPTH
        if same[0] and last is not None:
            out[last] = True
        out[positions[same]] = True
        out[positions[:-1][same[1:]]] = True
        last = positions[-1]
    return out
