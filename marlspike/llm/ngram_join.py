"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection; and its components.

Nodes are distinct shingle sets (named by a 64-bit hash of the set), so copies cost one node. All shingles have one order: those
known to be rare first, then by hash. Of a set of n shingles the first n - ceil(t n) + 1 are its keys: two sets that link share
one of them, whatever the order, and the first that they share bounds their overlap by its places. So keys grow linearly
with a set. Rare are counted shingles of fewer than FEW sets; half of all shingles, by hash, are counted over all documents.

Sets that share a rare key are candidates, at most FEW of them a key. Another key may be in any share of all sets, as
in a group of near copies: its sets are dealt to salts by set, and each has the salt's first as candidate. Candidates pass
the bounds by size and place, then the bound that bitmaps give (a bit set in one only is an element missing from the other),
then the exact intersection. Links found join components. Where a key's sets still are of several components, first one
set of each component meets the key's first; then all sets left apart meet in size-banded tiles: within a task, pairs of different components
pass the bounds by size, place and bits and then the exact intersection, and a link joins its components at once. So no pair
that could join two components is left unverified, and a clique of n near copies costs about n comparisons.

Words are runs of other than ASCII white space with A-Z in lower case. Null and empty texts have no shingle and no link; under
``k`` words, the whole sequence is the one shingle. Repeated rows share a component like any copies. Empty tables give an
empty result. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_batch, discard, mix64, stored
from .graph import connected

#: A shingle of fewer sets is rare, where it was counted; a power of two.
FEW = 32
#: Hashes of shingles that aren't rare: as many at most are told apart, in 2^COLD_BITS bits.
MOST, COLD_BITS = 1 << 21, 26
#: Shingles that a task counts at a time, and that a bucket of counts is made for.
FLUSH, BUCKET = 1 << 20, 1 << 20
#: Key rows given out at a time.
ROWS = 250_000
TILE = 1024
#: Bits of a set's bitmap within a tile.
TILE_BITS = 2048
SPREAD = 8
#: A column of our own while rows of any columns pass through.
NEW = "__marlspike_key__"


def shingle_sets(texts, k: int, words: Words):
    """Sorted distinct 64-bit shingle hashes of each text."""
    for s in words.shingles((t.as_py() for t in texts), k):
        yield distinct(s)


def distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix64(s.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def prefix_length(n: int, num: int, den: int) -> int:
    """Elements of a set of ``n`` that any linked, different set shares one of; 0 if only an equal set can link to it."""
    return n - -(-n * num // den) + 1 if n * (den - num) >= num else 0


def prefix(s: np.ndarray, cold: Cold, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a set in the order that all sets share, and which of them are not known to be rare."""
    p = prefix_length(len(s), num, den)
    if not p:
        return s[:0], np.zeros(0, bool)
    rare = cold.holds(s)
    first = np.flatnonzero(rare)[:p]
    rest = np.flatnonzero(~rare)[: p - len(first)]
    return s[np.r_[first, rest]], np.arange(p) >= len(first)


def least_overlap(n, m, num: int, den: int):
    """The least number of common elements at which sets of ``n`` and ``m`` link."""
    return -(-(n + m) * num // (num + den))


def reachable(n, i, m, j, num: int, den: int):
    """False only where sets of ``n`` and ``m`` elements whose first common one has the places ``i`` and ``j`` can't link."""
    return 1 + np.minimum(n - i - 1, m - j - 1) >= least_overlap(n, m, num, den)


class Cold:
    """Which shingles are known to be in few sets: a counted one is if its bit of a fixed number of bits is unset."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, y: np.ndarray) -> np.ndarray:
        at = (y >> np.uint64(64 - COLD_BITS)).astype(np.int64)
        return counted(y) & ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0)


def counted(y: np.ndarray) -> np.ndarray:
    """Half of all shingles by their hash; only these are counted, and only these can be known to be rare."""
    return y & np.uint64(1) == 0


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set, twice as many as elements at least, in a power of two."""
    size = 64
    while size < 2 * len(s):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[(s % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(n: int, m: int, x: bytes, y: bytes, num: int, den: int) -> bool:
    """False only if sizes or bit counts rule a link out."""
    if min(n, m) * den < num * max(n, m):
        return False
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    # A longer bitmap folds to a shorter one: sizes are powers of two and the bit is the hash modulo the size.
    a = np.bitwise_or.reduce(a.reshape(-1, min(len(a), len(b))), axis=0)
    b = np.bitwise_or.reduce(b.reshape(-1, min(len(a), len(b))), axis=0)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most * den >= num * (n + m - most)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * den >= num * (len(a) + len(b) - both)


def document_sets(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid (null without shingles), n) of every row, and (bucket, y, c): in how many of a task's sets shingles occur.

    A bucket holds a range of hashes: 32 further bits of each counted shingle in order, and how often it came, as arrays of
    bytes. There are as many buckets as keep one to about BUCKET shingles. A task counts a set once, and what it counted at
    a time is summed before it leaves the task.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 10 / BUCKET))))

    def work(batches):
        words, seen, held, count = Words(), set(), [], 0

        def told():
            y, c = np.unique(np.concatenate(held), return_counts=True)
            cut = np.r_[0, np.searchsorted(y >> np.uint64(64 - bits), np.arange(1, 1 << bits)), len(y)] if bits else [0, len(y)]
            low, c = (y >> np.uint64(32 - bits)).astype("<u4"), np.minimum(c, 0xFFFF).astype("<u2")
            own = [(n, low[i:j].tobytes(), c[i:j].tobytes()) for n, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            none = [None] * len(own)
            return {"doc_id": none, "sid": none, "n": none, "bucket": [x[0] for x in own], "y": [x[1] for x in own], "c": [x[2] for x in own]}

        for b in batches:
            ids, sizes = [], []
            for s in shingle_sets(b["text"], k, words):
                sid = set_id(s) if len(s) else None
                ids.append(sid)
                sizes.append(len(s))
                if sid is None or sid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                held.append(s[counted(s)])
                count += len(held[-1])
                if count > FLUSH:
                    yield told()
                    held, count = [], 0
            none = [None] * len(ids)
            yield {"doc_id": b["doc_id"], "sid": ids, "n": sizes, "bucket": [-1] * len(ids), "y": none, "c": none}
        if count:
            yield told()

    both = stored(by_batch(docs.select("doc_id", "text"), "doc_id long, sid long, n long, bucket int, y binary, c binary", work), "members")
    return both.filter("bucket = -1").select("doc_id", "sid", "n"), both.filter("bucket >= 0").select("bucket", "y", "c"), bits


def rare_shingles(counts: DataFrame, bits: int) -> Cold:
    """The bits of counted shingles that FEW sets or more hold; of more sets, where over MOST shingles are in so many.

    Whatever is not known to be rare still joins exactly, so neither the fixed number of bits nor MOST changes results.
    """

    def work(batches):
        now, ys, cs = None, [], []

        def close():
            y, c = np.concatenate(ys), np.concatenate(cs).astype(np.int64)
            y, at = np.unique(y, return_inverse=True)
            c = np.bincount(at, c).astype(np.int64)
            y, c = y[c >= FEW], c[c >= FEW]
            full = (y.astype(np.uint64) << np.uint64(32 - bits)) | (np.uint64(now) << np.uint64(64 - bits) if bits else np.uint64(0))
            return {"at": (full >> np.uint64(64 - COLD_BITS)).astype(np.int32), "c": c}

        for b in batches:
            for bucket, y, c in zip(b["bucket"].to_pylist(), b["y"], b["c"], strict=True):
                if bucket != now:
                    if ys:
                        yield close()
                    now, ys, cs = bucket, [], []
                ys.append(np.frombuffer(y.as_buffer(), "<u4"))
                cs.append(np.frombuffer(c.as_buffer(), "<u2"))
        if ys:
            yield close()

    often = stored(by_batch(counts.repartition("bucket").sortWithinPartitions("bucket"), "at int, c long", work), "often")
    level = F.floor(F.log2("c")).cast("int")
    spread = sorted(((r["k"], r["n"]) for r in often.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 64
    for k, n in spread:
        if total + n > MOST:
            break
        total, least = total + n, k
    at = often.filter(level >= least).select("at").distinct().toArrow()["at"].to_numpy()
    discard(often)
    out = np.zeros(1 << (COLD_BITS - 3), np.uint8)
    np.bitwise_or.at(out, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    return Cold(out)


def key_rows(docs: DataFrame, cold: Cold, salts: int, k: int, num: int, den: int) -> DataFrame:
    """(key, salt, sid, n, place) of each element of each set's prefix; a set that comes again in a task gives them once.

    The salt is 0 for rare shingles. The others, which any share of all sets may hold, have one of ``salts`` by set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cold)  # a fixed number of bits

    def work(batches):
        words, seen = Words(), set()
        for b in batches:
            out, held = [], 0

            def told(out):
                key, hot, sid, n, place = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(5))
                return {"key": key.view(np.int64), "salt": np.where(hot, 1 + (sid & 0x7FFFFFFF) % salts, 0), "sid": sid, "n": n, "place": place}

            for s in shingle_sets(b["text"], k, words):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                key, hot = prefix(s, shared.value, num, den)
                p = len(key)
                out.append((key, hot, np.full(p, sid, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
                held += p
                if held > ROWS:
                    yield told(out)
                    out, held = [], 0
            yield told(out)

    return by_batch(docs.select("text"), "key long, salt int, sid long, n int, place int", work)


def candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, key, n, place) from key rows.

    Of a rare key, all pairs that sizes and places let link, with a null key. Of the others every set ``b`` with the key, and
    with its salt's first set ``a`` (null if sizes and places rule that pair out).
    """

    def may_meet(x, y, n, place):
        return (np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y])) & reachable(n[x], place[x], n[y], place[y], num, den)

    def work(batches):
        carry = None  # rows of the group that goes on: all of a rare key, the first of another
        cols = ("key", "salt", "sid", "n", "place")
        for b in batches:
            c = [b[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in cols]
            old = 0
            if carry is not None:
                old = len(carry[0])
                c = [np.concatenate([x, y]) for x, y in zip(carry, c, strict=True)]
            key, salt, sid, n, place = c
            if not len(key):
                continue
            group = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            again = np.r_[False, sid[1:] == sid[:-1]] & ~group
            if again.any():  # a set that several tasks gave
                old = int((~again[:old]).sum())
                key, salt, sid, n, place, group = (x[~again] for x in (key, salt, sid, n, place, group))
            number = np.cumsum(group) - 1
            first = np.flatnonzero(group)
            hub = first[number]
            step, live, pairs = 1, np.flatnonzero(salt == 0), [np.zeros((2, 0), np.int64)]
            while len(live):
                live = live[live + step < len(key)]
                live = live[number[live] == number[live + step]]
                x, y = live, live + step
                x, y = x[y >= old], y[y >= old]  # pairs of rows that were carried are told already
                ok = may_meet(x, y, n, place)
                pairs.append(np.stack([sid[x[ok]], sid[y[ok]]]))
                step += 1
            a, other = np.concatenate(pairs, axis=1)
            yield {"a": a, "b": other} | {x: pa.nulls(len(a)) for x in ("key", "n", "place")}
            y = np.flatnonzero(salt > 0)
            y = y[y >= old]
            ok = (hub[y] != y) & may_meet(hub[y], y, n, place)
            yield {"a": pa.array(sid[hub[y]], mask=~ok), "b": sid[y], "key": key[y], "n": n[y], "place": place[y]}
            last = int(first[-1])
            keep = slice(last, None) if salt[last] == 0 else slice(last, last + 1)
            carry = [x[keep].copy() for x in (key, salt, sid, n, place)]

    ordered = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "sid").select("key", "salt", "sid", "n", "place")
    return by_batch(ordered, "a long, b long, key long, n int, place int", work)


def needed_sets(docs: DataFrame, members: DataFrame, sids: DataFrame, k: int) -> DataFrame:
    """(sid, n, bits, packed) of ``sids``, from one document of each; ``packed`` is its compressed text, far smaller than the set."""
    ids = members.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    def work(batches):
        words, seen = Words(), set()
        for b in batches:
            out = {c: [] for c in ("sid", "n", "bits", "packed")}
            for s, want, text in zip(shingle_sets(b["text"], k, words), b["sid"].to_pylist(), b["text"], strict=True):
                # Of rows that share an id only those with the wanted set count.
                if not len(s) or (sid := set_id(s)) in seen or (want is not None and want != sid):
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                for c, v in zip(out, (sid, len(s), bitmap(s), packed(text.as_py())), strict=True):
                    out[c].append(v)
            yield out

    # Rows without an id are found by their sets.
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("sid", "text").unionByName(docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("sid"), "text"))
    out = by_batch(rows, "sid long, n long, bits binary, packed binary", work).join(sids, "sid", "left_semi")
    return stored(out.dropDuplicates(["sid"]), "sets")


def packed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8", "surrogatepass").lower(), 4)


class Unpacked:
    """The sets of packed texts; those of the last few hundred asked for are kept, as one set often meets many."""

    def __init__(self, k: int):
        self.words, self.k, self.held, self.size = Words(clean=lambda t: t), k, {}, 0

    def __call__(self, sid: int, text) -> np.ndarray:
        s = self.held.get(sid)
        if s is None:
            s = distinct(next(self.words.shingles([zlib.decompress(text.as_buffer())], self.k)))
            if self.size > 1 << 22:
                self.held, self.size = {}, 0
            self.held[sid] = s
            self.size += len(s)
        return s


def verified(pairs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): first by sizes and bitmaps, then exactly."""

    def side(c: str, cols: list[str]) -> DataFrame:
        return sets.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols])

    def bound(batches):
        for b in batches:
            c = {x: b[x].to_pylist() for x in b}
            keep = [may_link(*x, num, den) for x in zip(c["n_a"], c["n_b"], c["bits_a"], c["bits_b"], strict=True)]
            yield {x: [v for v, ok in zip(c[x], keep, strict=True) if ok] for x in ("a", "b")}

    def exact(batches):
        unpacked = Unpacked(k)
        for b in batches:
            sides = zip(b["a"].to_pylist(), b["packed_a"], b["b"].to_pylist(), b["packed_b"], strict=True)
            keep = [links(unpacked(a, x), unpacked(c, y), num, den) for a, x, c, y in sides]
            yield {x: [v for v, ok in zip(b[x].to_pylist(), keep, strict=True) if ok] for x in ("a", "b")}

    meta = ["n", "bits"]
    few = by_batch(pairs.join(side("a", meta), "a").join(side("b", meta), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), "a long, b long", bound)
    full = few.join(side("a", ["packed"]), "a").join(side("b", ["packed"]), "b").select("a", "b", "packed_a", "packed_b")
    return stored(by_batch(full, "a long, b long", exact), "links")


class Tile:
    """Links between a tile's sets of different components, enough of them to join all that any link joins."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, sid: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, own: np.ndarray, part: np.ndarray, load) -> list[tuple[int, int]]:
        """Pairs of sets of which one at least is of the tile's ``own`` band; where both parts 0 and 1 occur only pairs across
        are looked at, as others have a tile of their own. ``load(i)`` gives the i-th set."""
        num, den, out = self.num, self.den, []
        bits = np.zeros((len(sid), TILE_BITS // 8), np.uint8)
        for j in range(len(sid)):
            at = (load(j) % np.uint64(TILE_BITS)).astype(np.int64)
            np.bitwise_or.at(bits[j], at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        bits = bits.view("<u8")
        label = np.unique(label, return_inverse=True)[1]
        across = part.any() and not part.all()
        for x in np.argsort(-np.bincount(label)[label], kind="stable")[::-1].tolist():
            other = (label != label[x]) & (own | own[x])
            if across:
                other &= part != part[x]
            other &= (np.minimum(n, n[x]) * den >= num * np.maximum(n, n[x])) & reachable(n, place, n[x], place[x], num, den)
            y = np.flatnonzero(other)
            if not len(y):
                continue
            most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64), n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64))
            for z in y[most >= least_overlap(n[x], n[y], num, den)].tolist():
                if label[z] != label[x] and links(load(x), load(z), num, den):
                    out.append((int(sid[x]), int(sid[z])))
                    label[label == label[z]] = label[x]
        return out


def band(n, num: int, den: int):
    """Sets that link are of the same band of sizes or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (1.001 * math.log(den / num))).cast("int")


def tiled(open_: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of links among the sets of each key of ``open_`` (key, sid, n, place, label), of different labels.

    A set goes to the tile of its key and band and, as a neighbour, to that of the band above. A tile of more than TILE sets
    is cut in parts, and each two parts meet.
    """
    x = open_.withColumn("band", band(F.col("n"), num, den)).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    x = x.withColumns({"band": F.col("band") + F.col("up"), "own": F.col("up") == 0}).drop("up")
    sizes = x.groupBy("key", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_parts"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("own").alias("_any")).filter("_lo <> _hi and _any")
    x = of_keys(x, sizes.select("key", "band", "_parts"), "band").withColumn("_b", F.pmod(F.xxhash64("sid"), F.col("_parts")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    x = x.withColumns({"i": F.least("_b", "_o"), "j": F.greatest("_b", "_o"), "part": (F.col("_b") > F.col("_o")).cast("int")})
    cols = ["sid", "label", "n", "place", "own", "part", "packed"]
    x = x.select("key", "band", "i", "j", *cols[:-1]).join(sets.select("sid", "packed"), "sid").select("key", "band", "i", "j", *cols)

    def work(batches):
        tile, unpacked, now, held = Tile(num, den), Unpacked(k), None, []

        def close():
            if len(held) < 2:
                return []
            c = list(zip(*held, strict=True))
            return tile.links(*(np.array(v) for v in c[:-1]), lambda i: unpacked(c[0][i], c[6][i]))

        for b in batches:
            found = []
            c = [b[v] if v == "packed" else b[v].to_pylist() for v in ("key", "band", "i", "j", *cols)]
            for key, band_, i, j, *row in zip(*c, strict=True):
                if (key, band_, i, j) != now:
                    found += close()
                    now, held = (key, band_, i, j), []
                held.append(row)
            yield {"a": [p[0] for p in found], "b": [p[1] for p in found]}
        found = close()
        yield {"a": [p[0] for p in found], "b": [p[1] for p in found]}

    return by_batch(x.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j"), "a long, b long", work)


def of_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The ``rows`` (key, sid, ...) of ``keys``; a key that many sets have is dealt to SPREAD places."""
    keys = keys.withColumn("_s", F.explode(F.array(*map(F.lit, range(SPREAD)))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("sid"), F.lit(SPREAD)).cast("int")).join(keys, ["key", *on, "_s"]).drop("_s")


def labelled(df: DataFrame, label: DataFrame, c: str) -> DataFrame:
    """``df`` with ``_c``, the label of the set in column ``c``; a set without one is its own."""
    return df.join(label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))


def joined(pairs: DataFrame, common: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, label) of all sets that links join, from candidate pairs (a, b) and the sets of common keys (key, sid, n, place).

    Each step looks only at what the one before left apart.
    """
    # One candidate for each set first: most others then lie inside a component and need no look.
    links = [verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, k, num, den)]
    label = stored(connected(links[0]), "labels")
    rest = labelled(labelled(pairs, label, "a"), label, "b").filter("_a <> _b").select("a", "b")
    links.append(verified(rest, sets, k, num, den))

    def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        label = stored(connected(reduce(DataFrame.unionByName, links)), "labels")
        rows = labelled(rows, label, "sid").withColumnRenamed("_sid", "label")
        keys = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("key")
        return label, stored(of_keys(rows, keys), "open")

    label, open_ = apart(common)
    if open_.isEmpty():
        return label
    # Then one set of each component of a key, with the key's first: components of near copies meet without their members.
    of = open_.groupBy("key", "label").agg(F.min("sid").alias("b"))
    pairs = of.join(of.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a <> b").select("a", "b").distinct()
    links.append(verified(pairs, sets, k, num, den))
    label, open_ = apart(open_.drop("label"))
    if open_.isEmpty():
        return label
    links.append(stored(tiled(open_, sets, k, num, den), "links"))
    return connected(reduce(DataFrame.unionByName, links))


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest id reachable over links of num / den similarity or more."""
    docs = docs.select("doc_id", "text")
    members, counts, bits = document_sets(docs, k)
    cold = rare_shingles(counts, bits)
    salts = 16 + members.count() // 20_000
    found = stored(candidates(key_rows(docs, cold, salts, k, num, den), num, den), "candidates")
    pairs = stored(found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    common = found.filter("key is not null").select("key", F.col("b").alias("sid"), "n", "place")
    keys = common.groupBy("key").agg(F.min("sid").alias("_lo"), F.max("sid").alias("_hi")).filter("_lo <> _hi").select("key")
    common = stored(of_keys(common, keys), "common")
    discard(found)
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(common.select("sid")).distinct()
    sets = needed_sets(docs, members, sids, k)
    label = stored(joined(pairs, common, sets, k, num, den), "labels")
    discard(pairs, common, sets)

    # A set that a third of all documents have is one row here; its members get it from SPREAD copies of that row.
    each = members.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n")).join(label.select(F.col("node").alias("sid"), "label"), "sid", "left")
    each = stored(each.filter("_n > 1 or label is not null").withColumn("label", F.coalesce("label", "sid")), "classes")
    least = each.groupBy("label").agg(F.min("_id").alias("_least"))
    of = each.join(least, "label").select("sid", "_least").withColumn("_s", F.explode(F.array(*map(F.lit, range(SPREAD)))))
    named = members.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")).join(of, ["sid", "_s"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def op7(docs: DataFrame) -> DataFrame:
    return components(docs, k=4, num=85, den=100)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id.

    Of rows that repeat an id those with equal texts give one row; with different texts they stay or go together. Rows
    without an id all stay. Columns of any name pass through.
    """
    rest = components(docs, k, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    # Of rows with one id and text one stays: they differ in nothing that is compared.
    kept = docs.join(rest.withColumnRenamed("doc_id", NEW), docs.doc_id == F.col(NEW), "left_anti")
    twice = stored(docs.groupBy("doc_id").agg(F.count("*").alias(NEW)).filter(f"doc_id is not null and {NEW} > 1").select(F.col("doc_id").alias(NEW)), "twice")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, kept.doc_id == F.col(NEW), "left_anti")
    again = kept.join(twice, kept.doc_id == F.col(NEW), "left_semi").withColumn(NEW, F.sha2("text", 256)).dropDuplicates(["doc_id", NEW]).drop(NEW)
    return single.unionByName(again)
