"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A document's candidate windows are those as long as an item that share a five-word shingle with it: any other window has
similarity 0 to it, so nothing is lost. An item of under five words is one shingle as a whole and is looked up among the
document's windows of as many words, where it matches only its equal. Each window's 64-bit SimHash is looked up in an index of the items' fingerprints
cut into four blocks of 16 bits: two fingerprints within RADIUS differ by at most RADIUS // 4 bits in some block, so all
items within RADIUS are found. Those are verified by the exact weighted Jaccard similarity of the shingle sets, where a
shingle weighs ln(1 + items / items that hold it).

The benchmark is searched in slices of about ``SLICE`` items; a slice is what a task holds. Item and shingle counts are of
the whole benchmark, so results don't depend on the slices: with its slice a task gets the count of every shingle that two
items or more hold, whichever slice they are in; one that a single item holds weighs as much as one that none holds.
Documents are scanned whole and need no shuffle.

Words are runs of ASCII letters, digits, underscores and characters beyond ASCII, in lower case. Null, empty texts and items match nothing; a text or item
of under five words is one shingle as a whole, and a window is never longer than its document. Repeated rows of documents
each give their matches; of repeated item ids, and of items without an id, each text counts. Of windows of one item that
tie the first counts, and of these the shortest. A long text is searched whole, in parts of PART words at a time. Empty tables give an empty result. Columns other than
doc_id, text and item_id are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_batch, schema_text, shingle_hashes, stored

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
SLICE = 20_000
#: Windows of a text that are looked at together start within this many words.
PART = 8192
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


def clean(text: str) -> bytes:
    """Lower case, with a blank for each ASCII character that isn't a letter, digit or underscore."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK)


def word_hashes(texts) -> Iterator[np.ndarray]:
    return Words(clean=clean).each(texts)


def bits(x: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1."""
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fold(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums; a sum of 0 is a 0 bit."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Benchmark:
    """A slice's shingles, weights, fingerprints and multi-index.

    ``total`` is the number of items with words and ``common`` the sorted shingles that at least two of them hold, with their
    counts, both of the whole benchmark; without them the slice is the benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], total: int | None = None, common: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.length, self.sets, all_hashes = [], [], [], []
        for (item, _), h in zip(items, word_hashes(t for _, t in items), strict=True):
            if len(h):
                s = shingle_hashes(h, WIDTH)
                self.ids.append(item)
                self.length.append(len(h))
                self.sets.append(frozenset(s.tolist()))
                all_hashes.append(s)
        #: Number of words -> shingle -> items of that many words, under WIDTH of them.
        self.short: dict[int, dict[int, list[int]]] = {}
        for j, (k, s) in enumerate(zip(self.length, self.sets, strict=True)):
            if k < WIDTH:
                self.short.setdefault(k, {}).setdefault(*s, []).append(j)
        n = len(self.ids) if total is None else total
        df: dict[int, list[int]] = {}
        for j, s in enumerate(self.sets):
            for x in s:
                df.setdefault(x, []).append(j)
        self.holders = df
        self.known = np.array(sorted(df), np.uint64)
        self.maybe = np.zeros(1 << 22, bool)  # by a shingle's low bits, whether an item may hold it
        self.maybe[(self.known & np.uint64(0x3FFFFF)).astype(np.int64)] = True
        self.unseen = math.log(1 + n) if n else 1.0
        self.common, held = common or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        each, place = np.unique(held, return_inverse=True)
        self.common_weight = np.array([math.log(1 + n / int(k)) for k in each])[place]
        self.common_fixed = np.array([round(x * 256) for x in self.common_weight.tolist()], np.int64)
        self.weight = {x: math.log(1 + n / len(v)) for x, v in df.items()} if common is None else {x: self.elsewhere(x) for x in df}
        self.fixed = np.array([round(self.weight[int(x)] * 256) for x in self.known], np.int64)
        self.mass = [sum(self.weight[x] for x in s) for s in self.sets]
        self.prints = np.concatenate([fold((bits(s) * self.fixed_of(s)[:, None]).sum(axis=0, keepdims=True)) for s in all_hashes]) if self.ids else np.zeros(0, np.uint64)
        self.near = RADIUS // BLOCKS
        self.masks = np.array([0] + [sum(1 << b for b in c) for r in range(1, self.near + 1) for c in combinations(range(16), r)], np.uint64)
        self.index = []
        for k in range(BLOCKS):
            block = (self.prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            order = np.argsort(block, kind="stable")
            self.index.append((block[order], order))

    def fixed_of(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), round(self.unseen * 256), np.int64)
        for keys, fixed in ((self.common, self.common_fixed), (self.known, self.fixed)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                hit = keys[at] == s
                out[hit] = fixed[at[hit]]
        return out

    def elsewhere(self, x: int) -> float:
        """Weight of a shingle by the counts of the whole benchmark."""
        if len(self.common):
            at = int(np.searchsorted(self.common, np.uint64(x)))
            if at < len(self.common) and int(self.common[at]) == x:
                return float(self.common_weight[at])
        return self.unseen

    def within(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(row of ``prints``, item) of every pair within RADIUS bits, by way of the blocks."""
        found = set()
        for k, (sorted_block, order) in enumerate(self.index):
            block = (prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            if len(order) <= len(self.masks):  # fewer items than neighbours of a block: compare blocks directly
                r, c = np.nonzero(np.bitwise_count(block[:, None] ^ sorted_block[None, :]) <= self.near)
                pairs = np.stack([r, order[c]], axis=1)
            else:
                probe = (block[:, None] ^ self.masks[None, :]).ravel()
                lo, hi = np.searchsorted(sorted_block, probe, "left"), np.searchsorted(sorted_block, probe, "right")
                n = hi - lo
                row = np.repeat(np.repeat(np.arange(len(block)), len(self.masks)), n)
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pairs = np.stack([row, order[at]], axis=1)
            close = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= RADIUS
            found.update(map(tuple, pairs[close].tolist()))
        return sorted(found)

    def similarity(self, window: set[int], j: int) -> float:
        item, w = self.sets[j], self.weight
        both = sum(w[x] for x in window & item)
        own = sum(w[x] if x in w else self.elsewhere(x) for x in window)
        return both / (own + self.mass[j] - both) if both else 0.0

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        at = np.flatnonzero(self.maybe[(s & np.uint64(0x3FFFFF)).astype(np.int64)])
        if not len(at):
            return at
        j = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[j] == s[at]]

    def starts(self, n_words: int, s: np.ndarray, hits: np.ndarray) -> dict[int, np.ndarray]:
        """Window length -> starts of the candidate windows of a document with the shingles ``s``."""
        edges: dict[int, list[tuple[int, int]]] = {}
        for p in hits.tolist():
            for size in {min(self.length[j], n_words) for j in self.holders[int(s[p])]}:
                lo, hi = max(0, p - max(0, size - WIDTH)), min(p, n_words - size) + 1
                runs = edges.setdefault(size, [])
                # Hits come in order, so a run can only reach into the one before it.
                if runs and lo <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
                elif lo < hi:
                    runs.append((lo, hi))
        return {k: np.concatenate([np.arange(lo, hi) for lo, hi in v]) for k, v in edges.items() if v}

    def near_windows(self, s: np.ndarray, starts: np.ndarray, span: int) -> list[tuple[int, int]]:
        """(start, item) where the fingerprint of ``span`` shingles from there is within the radius of the item's."""
        lo = int(starts[0])
        part = s[lo : int(starts[-1]) + span]
        sums = np.zeros((len(part) + 1, 64), np.int64)
        np.cumsum(bits(part) * self.fixed_of(part)[:, None], axis=0, out=sums[1:])
        prints = fold(sums[starts - lo + span] - sums[starts - lo])
        return [(int(starts[row]), j) for row, j in self.within(prints)]

    def search(self, h: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
        """(item, start, words, similarity) of the best window for each item that some window of a text resembles."""
        if not len(h) or not self.ids:
            return []
        s = shingle_hashes(h, WIDTH)
        hits = self.hits(s)
        best: dict[int, tuple[float, int, int]] = {}
        for k, items in self.short.items():
            if len(h) >= k and least <= 1:
                g = shingle_hashes(h, k)
                for at in np.flatnonzero(np.isin(g, np.fromiter(items, np.uint64, len(items)))).tolist():
                    for j in items[int(g[at])]:
                        best.setdefault(j, (1.0, -at, -k))
        for size, starts in self.starts(len(h), s, hits).items():
            span = max(1, size - WIDTH + 1)
            # Windows are looked at a part at a time, those of a part within about PART shingles.
            cut = np.flatnonzero(np.r_[True, starts[1:] // PART != starts[:-1] // PART])
            for part in np.split(starts, cut[1:]):
                for at, j in self.near_windows(s, part, span):
                    sim = self.similarity(set(s[at : at + span].tolist()), j)
                    if sim >= least and (sim, -at, -size) > best.get(j, (0.0, 0, 0)):
                        best[j] = (sim, -at, -size)
        return [(self.ids[j], -at, -size, sim) for j, (sim, at, size) in sorted(best.items())]


def _counts(items: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many items have words, and the shingles of at least two of them, sorted, with their counts."""

    def work(batches):
        for b in batches:
            for h in word_hashes(t.as_py() for t in b["text"]):
                if len(h):
                    s = np.unique(shingle_hashes(h, WIDTH))
                    yield {"x": s.view(np.int64), "first": np.arange(len(s)) == 0}

    held = by_batch(items.select("text"), "x long, first boolean", work).groupBy("x").agg(F.count("*").alias("n"), F.count_if("first").alias("items"))
    held = stored(held, "shingles")
    total = held.agg(F.sum("items")).head()[0] or 0
    got = held.filter("n > 1").select("x", "n").toArrow()
    x, n = got["x"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy()
    order = np.argsort(x)
    return total, (x[order], n[order])


def _slices(benchmark: DataFrame, slice_items: int):
    """Broadcasts of what ``Benchmark`` takes, ``slice_items`` items or about that many at a time."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.filter("text is not null").select("item_id", "text")
    slices = max(1, math.ceil(items.count() / slice_items))
    counts = _counts(items) if slices > 1 else ()
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        yield sc.broadcast((sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), *counts))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, slice_items: int = SLICE) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: each document's best window for each item it resembles."""
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    out = None
    for shared in _slices(benchmark, slice_items):

        def work(batches, shared=shared):
            bench = Benchmark(*shared.value)
            for b in batches:
                got = {c: [] for c in ("doc_id", "item_id", "start", "n_words", "similarity")}
                for doc, h in zip(b["doc_id"].to_pylist(), word_hashes(t.as_py() for t in b["text"]), strict=True):
                    for row in bench.search(h, least):
                        for c, v in zip(got, (doc, *row), strict=True):
                            got[c].append(v)
                yield got

        one = by_batch(docs.select("doc_id", "text"), schema, work)
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, slice_items: int = SLICE) -> DataFrame:
    """``docs`` without the rows that resemble an item; a map over the rows for each slice."""
    for shared in _slices(benchmark, slice_items):

        def work(batches, shared=shared):
            bench = Benchmark(*shared.value)
            for b in batches:
                clean_ = [not bench.search(h, least) for h in word_hashes(t.as_py() for t in b["text"])]
                yield {c: v.filter(pa.array(clean_, pa.bool_())) for c, v in b.items()}

        docs = by_batch(docs, schema_text(docs), work)
    return docs
