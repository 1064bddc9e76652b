"""Suffix and common-prefix arrays by external induced sorting.

Text, suffix queues and results are files in a scratch folder. Suffixes leave a bucket in the order in which they were
put into it, because what induces them is scanned in order: so a file for each first symbol, read front to back, is a
monotone priority queue on disk. A queue's tuples carry the suffix and its common prefix with the tuple before it, which
is one more than the least common prefix over the inducing suffixes between the two.

The sampled suffixes (leftmost of type S) are sorted by naming their substrings and ordering the reduced string of names
by prefix doubling; all others are induced from them in two scans. Memory holds a bucket of a queue, the counts of each
symbol, the sample (about 2/7 of the text's suffixes, 24 bytes each), and the types and wanted masks of the whole text.

Symbols are 16-bit numbers; common prefixes are counted up to ``cap``. Separators are symbol 0; beyond a separator order and
common prefixes are those of the whole text.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np

BLOCK = 1 << 18


class Tuples:
    """A file of (suffix, common prefix) tuples, appended in blocks and read from the front."""

    def __init__(self, folder: Path, name: str):
        self.path, self.wrote, self.read, self.tail = folder / name, 0, 0, []
        self.held = 0
        self.file = None

    def push(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(suffix), [("s", "<i8"), ("l", "<u2")])
        rows["s"], rows["l"] = suffix, lcp
        self.tail.append(rows)
        self.held += len(rows)
        if self.held >= BLOCK // 64:
            self.spill()

    def spill(self) -> None:
        if self.tail:
            if self.file is None:
                self.file = open(self.path, "w+b")  # noqa: SIM115
            self.file.seek(0, os.SEEK_END)
            for rows in self.tail:
                self.file.write(rows.tobytes())
                self.wrote += len(rows)
            self.tail, self.held = [], 0

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The next block, or None if all that was pushed so far has been read."""
        kind = np.dtype([("s", "<i8"), ("l", "<u2")])
        if self.read < self.wrote:
            self.file.seek(self.read * kind.itemsize)
            rows = np.frombuffer(self.file.read(min(BLOCK, self.wrote - self.read) * kind.itemsize), kind)
            self.read += len(rows)
        elif self.tail:
            rows = np.concatenate(self.tail)
            self.tail, self.held = [], 0
        else:
            return None
        return rows["s"].copy(), rows["l"].copy()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.path.unlink(missing_ok=True)


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S: smaller than the one after it. The last is L, and so is its run."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    change = np.flatnonzero(t[1:] != t[:-1])  # the last place of each run but the last
    ends = np.r_[change, n - 1]
    up = np.r_[t[change] < t[change + 1], False]
    return np.repeat(up, np.diff(np.r_[-1, ends]))


def words(t: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Four symbols from ``at + 4k`` packed in order into 64 bits; 0 beyond the end."""
    n, out = len(t), np.zeros(len(at), np.uint64)
    for j in range(4):
        p = at + 4 * k + j
        out = (out << np.uint64(16)) | np.where(p < n, t[np.minimum(p, n - 1)], 0).astype(np.uint64)
    return out


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, ``cap`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(-(-cap // 4)):
        x = words(t, a[live], k) ^ words(t, b[live], k)
        out[live] += np.select([x >= 1 << 48, x >= 1 << 32, x >= 1 << 16, x > 0], [0, 1, 2, 3], 4)
        live = live[x == 0]
        if not len(live):
            break
    return np.minimum(out, np.minimum(cap, len(t) - np.maximum(a, b)))


def dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def sample_order(t: np.ndarray, s: np.ndarray, cap: int) -> np.ndarray:
    """The leftmost type-S suffixes in order, by names of their substrings and prefix doubling of the reduced string."""
    pos = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    m = len(pos)
    if m < 2:
        return pos
    size = np.diff(np.r_[pos, len(t) - 1]) + 1
    # A symbol of a substring is its number and type, so none is a proper prefix of another.
    typed = t.astype(np.uint32) * 2 + s
    rank, k = np.zeros(m, np.int64), 0
    open_ = np.arange(m)
    while len(open_):
        w = np.zeros(len(open_), np.uint64)
        for j in range(3):
            o = 3 * k + j
            p = pos[open_] + o
            w = (w << np.uint64(20)) | np.where(o < size[open_], typed[np.minimum(p, len(t) - 1)] + 1, 0).astype(np.uint64)
        order = np.lexsort((w, rank[open_]))
        r, v = rank[open_][order], w[order]
        first = np.r_[True, r[1:] != r[:-1]]
        new = first | np.r_[True, v[1:] != v[:-1]]
        # A name is the place of its first substring, so refined groups stay between their neighbours.
        place = np.arange(len(order))
        group = np.maximum.accumulate(np.where(first, place, 0))
        rank[open_[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - group
        alone = new & np.r_[new[1:], True]
        k += 1
        keep = ~alone & (size[open_[order]] > 3 * k)
        open_ = open_[order][keep]
        if k == 1:
            open_ = np.sort(open_)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < m:
        r = rank[order]
        new = np.r_[True, r[1:] != r[:-1]]
        single = new & np.r_[new[1:], True]
        if single.all() or step > cap:
            break
        live = order[~single]
        ahead = np.where(live + step < m, rank[np.minimum(live + step, m - 1)], -1)
        sub = np.lexsort((ahead, rank[live]))
        r, v = rank[live][sub], ahead[sub]
        first = np.r_[True, r[1:] != r[:-1]]
        new = first | np.r_[True, v[1:] != v[:-1]]
        place = np.arange(len(sub))
        group = np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[live[sub]] = r + np.maximum.accumulate(np.where(new, place, 0)) - group
        order = np.argsort(rank, kind="stable")
        step *= 2
    return pos[order]


class Inducer:
    """One scan: what it is fed in order gives the tuples of the suffixes before them, in order for each first symbol."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, queues: list[Tuples], cap: int):
        self.t, self.wanted, self.queues, self.cap = t, wanted, queues, cap
        self.low = np.zeros(len(queues), np.int64)  # least common prefix since the last push to each queue

    def feed(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        if not len(suffix):
            return
        lcp = lcp.astype(np.int64)
        before = suffix - 1
        ok = np.flatnonzero((before >= 0) & self.wanted[np.maximum(before, 0)])
        sym = self.t[before[ok]].astype(np.int64)
        order = np.argsort(sym, kind="stable")
        ok, sym = ok[order], sym[order]
        first = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]][: len(sym)])
        total = lcp.min()
        touched = np.zeros(len(self.low), bool)
        for lo, hi in zip(first, np.r_[first[1:], len(sym)][: len(first)], strict=True):
            c, at = int(sym[lo]), ok[lo:hi]
            least = np.minimum.reduceat(lcp, np.r_[0, at[:-1] + 1])[: len(at)] if len(at) > 1 else np.array([lcp[: at[0] + 1].min()])
            if len(at) > 1:  # the last interval of reduceat runs to the end of the block
                least[-1] = lcp[at[-2] + 1 : at[-1] + 1].min()
            least[0] = min(least[0], self.low[c])
            self.queues[c].push(before[at], np.minimum(least + 1, self.cap))
            rest = lcp[at[-1] + 1 :]
            self.low[c] = rest.min() if len(rest) else self.cap
            touched[c] = True
        self.low[~touched] = np.minimum(self.low[~touched], total)


def suffix_array(t: np.ndarray, folder: str, symbols: int, cap: int = 128):
    """Blocks (suffixes, common prefix of each with the one before it) of all suffixes of ``t`` in order.

    ``t`` is a 16-bit array, in memory or mapped; it must end with the symbol 0, and 0 occurs nowhere before a place
    that a caller compares beyond.
    """
    folder = Path(folder)
    n = len(t)
    if n < 2:
        yield np.arange(n), np.zeros(n, np.int64)
        return
    s = types(t)
    sample = sample_order(t, s, cap)
    sample_lcp = np.r_[0, common(t, sample[:-1], sample[1:], cap)] if len(sample) else np.zeros(0, np.int64)
    bound = np.searchsorted(t[sample], np.arange(symbols + 1)) if len(sample) else np.zeros(symbols + 1, np.int64)

    # Scan 1, smallest first: type-L suffixes from the sample and from each other.
    down = [Tuples(folder, f"l{c}") for c in range(symbols)]
    kept = [Tuples(folder, f"k{c}") for c in range(symbols)]
    scan = Inducer(t, ~s, down, cap)
    down[int(t[-1])].push(np.array([n - 1]), np.array([0]))
    last = None
    for c in range(symbols):
        begun = False
        while (got := down[c].pop()) is not None:
            suffix, lcp = got
            if not begun:
                lcp[0] = 0
                begun = True
            kept[c].push(suffix, lcp)
            scan.feed(suffix, lcp)
            last = suffix[-1]
        a, b = bound[c], bound[c + 1]
        if a < b:
            lcp = sample_lcp[a:b].copy()
            lcp[0] = common(t, np.array([last]), sample[a : a + 1], cap)[0] if begun else 0
            scan.feed(sample[a:b], lcp)
        down[c].close()

    # Scan 2, largest first: type-S suffixes from type L and from each other. A tuple's common prefix is with the one
    # pushed before it, which stands after it in the result.
    up = [Tuples(folder, f"s{c}") for c in range(symbols)]
    done = [Tuples(folder, f"d{c}") for c in range(symbols)]
    scan = Inducer(t, s, up, cap)
    for c in range(symbols - 1, -1, -1):
        begun, last = False, None
        while (got := up[c].pop()) is not None:
            suffix, lcp = got
            if not begun:
                lcp[0] = 0
                begun = True
            done[c].push(suffix, lcp)
            scan.feed(suffix, lcp)
            last = suffix[-1]
        up[c].close()
        blocks = list(_blocks(kept[c]))
        for i in range(len(blocks) - 1, -1, -1):
            suffix, lcp = blocks[i]
            # Backwards, each has its common prefix with the one after it.
            after = np.r_[lcp[1:], blocks[i + 1][1][0] if i + 1 < len(blocks) else 0]
            if i == len(blocks) - 1 and last is not None:
                after[-1] = common(t, suffix[-1:], np.array([last]), cap)[0]
            scan.feed(suffix[::-1], after[::-1])
        # In order: type L of the symbol, then type S, which were found largest first.
        end = None
        for suffix, lcp in blocks:
            end = suffix[-1]
        kept[c].close()
        ss, ls = [np.concatenate(x) for x in zip(*_blocks(done[c]), strict=True)] if done[c].wrote or done[c].tail else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
        done[c].close()
        out = Tuples(folder, f"r{c}")
        for suffix, lcp in blocks:
            out.push(suffix, lcp)
        if len(ss):
            seam = common(t, np.array([end]), ss[-1:], cap)[0] if end is not None else 0
            out.push(ss[::-1], np.r_[seam, ls[:0:-1]])
        done[c] = out
    for c in range(symbols):
        yield from _blocks(done[c])
        done[c].close()


def _blocks(q: Tuples):
    """All tuples of a queue in blocks, from its front."""
    q.spill()
    q.read = 0
    while (got := q.pop()) is not None:
        yield got
