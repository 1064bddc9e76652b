"""Suffix-array dedup: bytes of substrings of ``LENGTH`` bytes that start earlier too are removed.

1. Whole copies: a text that a smaller id has as well is removed without sorting.
2. Every window of LENGTH bytes is owned by the place of its least hashed GRAM-byte string, leftmost of equals. The place
   within the window follows from the window's bytes alone, so equal windows have owners with equal strings. One place owns a
   run of windows; the bytes they span are its region. Places whose string occurs once own no repeated window and go.
   Equal regions are copies: all but the first are removed without sorting; a task settles the copies among its own rows
   before any shuffle.
3. Distinct regions of strings that occur more than once meet in shards by the string. A shard is one text; its suffix and
   common-prefix arrays come from external induced sorting (``induced_sort``) with queues in scratch files of the task, but
   arrays over the whole shard are in memory. In each run of suffixes with a common prefix of LENGTH or more all but the earliest repeat.
4. Removed windows come back to their documents, which drop the bytes they cover.

Null texts are empty. Texts under LENGTH bytes lose nothing. Rows that repeat an id and its text give equal results, each
judged as that id. Rows without an id, and all but one text of an id that has several, count as documents after all ids. Empty tables give an empty result. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, mix64, stored
from .induced_sort import suffix_array

LENGTH = 100
GRAM = 32
#: Bytes that a task hashes at once; a document is cut into overlapping parts beyond it.
CHUNK = 1 << 21
#: Bytes of regions in a shard.
SHARD = 8 << 20
#: Ids of whole copies that may travel to all tasks; beyond it they are joined by shuffle.
BROADCAST = 1_000_000
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32- and 64-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        x, size, power = _BYTE[b], 1, _BASE
        while size < GRAM:
            x = x[:-size] * np.uint64(power) + x[size:]
            size, power = 2 * size, power * power % (1 << 64)
        return x, x[:-GRAM] * np.uint64(power) + x[GRAM:]


def owners(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string hash, region hash, first window, windows) of each run of windows with one owner; no run leaves its part."""
    x32, x64 = grams(b)
    with np.errstate(over="ignore"):
        v = x32 * np.uint64(0xDA942042E4DD58B5)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
    m = (v & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(v), dtype=np.uint64)
    size = 1
    while 2 * size <= LENGTH - GRAM + 1:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = LENGTH - GRAM + 1 - size
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    at = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    at[~valid] = -1
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[cut, len(at)])
    ok = at[cut] >= 0
    lo, n = cut[ok], n[ok]
    span = n + LENGTH - 1
    with np.errstate(over="ignore"):
        region = mix64(x64[lo] + mix64(x64[lo + span // 2 - 32] + mix64(x64[lo + span - 64] + span.astype(np.uint64))))
    return mix64(x32[at[lo]]), region, lo, n


def joined(at: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, sorted and with neighbours made one."""
    o = np.lexsort((at, doc))
    at, n, doc = at[o], n[o], doc[o]
    if not len(at):
        return at, n, doc
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + n[:-1])])
    last = np.r_[cut[1:], len(at)] - 1
    return at[cut], at[last] + n[last] - at[cut], doc[cut]


def windows(docs: DataFrame) -> DataFrame:
    """h, r, doc_id, at, n: runs of windows by owner; a null h is a run known to be a copy of an earlier one."""

    def chunk(parts: list[tuple[int, int, bytes]]) -> dict:
        b = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        starts = np.cumsum(sizes) - sizes
        h, r, lo, n = owners(b, starts, sizes)
        part = np.searchsorted(starts, lo, "right") - 1
        doc = np.array([p[0] for p in parts])[part]
        at = lo - starts[part] + np.array([p[1] for p in parts])[part]
        o = np.lexsort((at, doc, r, h))
        h, r, doc, at, n = h[o], r[o], doc[o], at[o], n[o]
        same = np.r_[False, (h[1:] == h[:-1]) & (r[1:] == r[:-1])]
        again = np.r_[False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])] & same  # the same row twice
        gone = same & ~again
        a, m, d = joined(at[gone], n[gone], doc[gone])
        keep = ~same
        null = [None] * len(a)
        return {"h": h[keep].view(np.int64).tolist() + null, "r": r[keep].view(np.int64).tolist() + null, "doc_id": np.r_[doc[keep], d], "at": np.r_[at[keep], a], "n": np.r_[n[keep], m]}

    def work(batches):
        parts, held = [], 0
        for b in batches:
            for doc, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                step = CHUNK - LENGTH + 1
                for lo in range(0, max(1, len(raw) - LENGTH + 1), step):
                    part = raw[lo : lo + CHUNK]
                    if len(part) >= LENGTH:
                        parts.append((doc, lo, part))
                        held += len(part)
                    if held >= CHUNK:
                        yield chunk(parts)
                        parts, held = [], 0
        if parts:
            yield chunk(parts)

    return by_batch(docs, "h long, r long, doc_id long, at long, n long", work)


def repeated(runs: DataFrame) -> DataFrame:
    """From runs with an h: copies of an earlier equal region (null h), and the first of each region whose string has several."""

    def work(batches):
        carry = np.zeros((0, 6), np.int64)  # rows of the group that goes on: h, r, doc, at, n, 1 if given out
        for b in batches:
            rows = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("h", "r", "doc_id", "at", "n")] + [np.zeros(len(b["h"]), np.int64)], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([carry, rows])
            new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            fresh = new | np.r_[True, rows[1:, 1] != rows[:-1, 1]]
            group = np.cumsum(new) - 1
            several = np.bincount(group, fresh)[group] > 1
            ship = fresh & several & (rows[:, 5] == 0)
            twin = np.r_[False, (rows[1:, 2:4] == rows[:-1, 2:4]).all(axis=1)]
            gone = ~fresh & ~twin & (rows[:, 5] == 0)
            rows[ship, 5] = 1
            lo = np.flatnonzero(new)[-1]
            carry = rows[[lo]] if lo == len(rows) - 1 else rows[[lo, len(rows) - 1]]
            if len(carry) > 1:
                carry[1, 5] = 1
            s = rows[ship]
            at, n, doc = joined(rows[gone, 3], rows[gone, 4], rows[gone, 2])
            yield {"h": s[:, 0].tolist() + [None] * len(at), "doc_id": np.r_[s[:, 2], doc], "at": np.r_[s[:, 3], at], "n": np.r_[s[:, 4], n]}

    ordered = runs.repartition("h").sortWithinPartitions("h", "r", "doc_id", "at")
    return by_batch(ordered, "h long, doc_id long, at long, n long", work)


def regions(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (h, doc_id, at, n) with the bytes of their regions."""
    wanted = runs.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "n")).alias("runs"))

    def work(batches):
        for b in batches:
            out = {c: [] for c in ("h", "doc_id", "at", "n", "region")}
            for doc, t, own in zip(b["doc_id"].to_pylist(), b["text"], b["runs"].to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for x in own:
                    for c, v in zip(out, (x["h"], doc, x["at"], x["n"], raw[x["at"] : x["at"] + x["n"] + LENGTH - 1]), strict=True):
                        out[c].append(v)
            yield out

    both = docs.select("doc_id", "text").join(wanted, "doc_id")
    return by_batch(both, "h long, doc_id long, at long, n long, region binary", work)


def sorted_repeats(shipped: DataFrame, shards: int) -> DataFrame:
    """doc_id, at, n of windows that an earlier region of their shard has, by the shard's suffix array."""

    def work(batches):
        folder = tempfile.mkdtemp(prefix="suffixes-")  # this task's scratch, gone with it
        try:
            doc, at, n, size = [], [], [], 0
            with open(f"{folder}/text", "wb") as f:
                for b in batches:
                    for x in b["region"]:
                        part = np.frombuffer(x.as_buffer(), np.uint8).astype(np.uint16) + 1
                        f.write(part.tobytes() + b"\0\0")
                        size += len(part) + 1
                    doc.append(b["doc_id"].to_numpy(zero_copy_only=False))
                    at.append(b["at"].to_numpy(zero_copy_only=False))
                    n.append(b["n"].to_numpy(zero_copy_only=False))
            if not size:
                return
            doc, at, n = map(np.concatenate, (doc, at, n))
            text = np.memmap(f"{folder}/text", np.uint16, "r", shape=(size,))
            first = np.cumsum(n + LENGTH) - (n + LENGTH)
            _, order = np.unique(doc, return_inverse=True)
            low, tail = None, []  # of the run of equal windows that goes on: the earliest, and the rest's blocks
            for suffix, lcp in suffix_array(text, folder, 257, LENGTH):
                region = np.searchsorted(first, suffix, "right") - 1
                off = suffix - first[region]
                window = off < n[region]
                region, off = region[window], off[window]
                # A window's neighbours in order are windows wherever the common prefix is LENGTH.
                new = (lcp < LENGTH)[window]
                if not len(region):
                    continue
                key = (order[region].astype(np.int64) << 40) + at[region] + off
                new[0] = new[0] or low is None
                run = np.cumsum(new)
                least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
                if low is not None:
                    least[0] = low
                np.minimum.at(least, run, key)
                # The earliest so far of the run may still lose to one in a later block: it is told when beaten.
                late = key > least[run]
                if low is not None and least[0] < low:
                    tail.append(np.array([low]))
                tail.append(key[late])
                low = int(least[-1])
                if sum(map(len, tail)) > 1_000_000:
                    yield told(tail, doc, order)
                    tail = []
            if tail:
                yield told(tail, doc, order)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def told(keys, doc, order):
        k = np.unique(np.concatenate(keys))
        names = np.zeros(int(order.max()) + 1, np.int64)
        names[order] = doc
        a, m, d = joined(k & ((1 << 40) - 1), np.ones(len(k), np.int64), names[k >> 40])
        return {"doc_id": d, "at": a, "n": m}

    return by_batch(shipped.repartition(shards, "h").select("doc_id", "at", "n", "region"), "doc_id long, at long, n long", work)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text, doc_id) where ``id`` is what the row calls itself and ``doc_id`` its place among all documents.

    It is the id, where there is one and its texts are all equal. Of an id with several texts that with the least hash has
    it; all others and the rows without an id come after all ids, by a hash of their text.
    """
    top = docs.agg(F.max("doc_id")).head()[0]
    base = max(-1, -1 if top is None else top) + 1
    after = F.lit(base) + F.pmod(F.xxhash64("text"), F.lit(2**63 - 1 - base))
    digest = F.xxhash64("text")
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi")).filter("_lo <> _hi")
    several = stored(several.select(F.col("doc_id").alias("_of"), "_lo"), "several")
    docs = docs.withColumn("id", F.col("doc_id"))
    if several.isEmpty():
        return docs.withColumn("doc_id", F.coalesce("doc_id", after))
    docs = docs.join(several, F.col("doc_id") == F.col("_of"), "left")
    own = F.col("doc_id").isNotNull() & (F.col("_lo").isNull() | (F.col("_lo") == digest))
    return stored(docs.withColumn("doc_id", F.when(own, F.col("doc_id")).otherwise(after)).select("id", "text", "doc_id"), "keyed")


def removed(docs: DataFrame) -> DataFrame:
    """id, doc_id, text, copy (whole text removed) and runs (arrays of first window and windows) for every row."""
    docs = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    digest = F.sha2("text", 256).alias("_d")
    named = docs.filter(F.octet_length("text") >= LENGTH).select("doc_id", digest)
    several = named.groupBy("_d").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first <> _last")
    copies = stored(named.join(several, "_d").filter("doc_id > _first").select("doc_id").distinct(), "copies")
    few = copies.limit(BROADCAST + 1).count() <= BROADCAST
    copies = copies.withColumn("copy", F.lit(True))
    own = docs.join(F.broadcast(copies) if few else copies, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    single = own.filter(~F.col("copy") & (F.octet_length("text") >= LENGTH)).select("doc_id", "text")

    runs = stored(windows(single), "windows")
    found = stored(repeated(runs.filter("h is not null")), "found")
    ship = found.filter("h is not null")
    shards = max(1, -(-ship.count() * (LENGTH + 32) // SHARD))
    by_sort = sorted_repeats(regions(single, ship), shards)
    marks = runs.filter("h is null").unionByName(found.filter("h is null"), allowMissingColumns=True).select("doc_id", "at", "n").unionByName(by_sort)
    marks = stored(marks, "marks")
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return own.join(marks, "doc_id", "left")


def cut(raw: bytes, at: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """What is left of ``raw`` without the bytes that the windows cover, and how many runs of bytes went."""
    o = np.argsort(at, kind="stable")
    lo, hi = at[o], at[o] + n[o] + LENGTH - 1
    hi = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    starts, ends = lo[first], hi[np.r_[first[1:], len(lo)] - 1]
    kept = [raw[a:b] for a, b in zip(np.r_[0, ends].tolist(), np.r_[starts, len(raw)].tolist(), strict=True)]
    return b"".join(kept), len(first)


def op3(docs: DataFrame) -> DataFrame:
    def work(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for doc, t, copy, runs in zip(b["id"].to_pylist(), b["text"], b["copy"].to_pylist(), b["runs"].to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                if copy:
                    kept, spans = b"", 1
                elif runs:
                    kept, spans = cut(raw, np.array([x["at"] for x in runs]), np.array([x["n"] for x in runs]))
                else:
                    kept, spans = raw, 0
                for c, v in zip(out, (doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[c].append(v)
            yield out

    return by_batch(removed(docs), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)
