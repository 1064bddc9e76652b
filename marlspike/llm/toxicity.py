"""Toxicity: a factorization machine over hashed terms.

A document's features are the hashed terms that occur in it (each once, so long documents don't drown a term) out of at
most ``terms`` hashes: those that by themselves differ most between the labels, and those of pairs whose interaction does,
though each of the two may be as frequent under both labels. The model is

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so a pair of terms can weigh more or less than both alone. It is fitted on a bounded sample of labelled rows
(``sample`` rows at most, those whose hashes are smallest); scoring reads every document's whole text in one pass
without a shuffle.

Null and empty texts have no term and get the score of the bias. Labels that are null, and labelled ids without a
document, are left out of training; of repeated labels for an id each counts. With no training rows, or one class only,
every score is the smoothed base rate. Repeated rows each get their score, and each count in training; rows that tie in
the sample's order are alike. Of a long text every term counts. Columns other than doc_id, text and toxic pass through.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Collection
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, crc_mod, schema_text

BITS = 20
SAMPLE = 16_000
TERMS = 4096
FACTORS = 8
#: Terms whose pairs are looked at.
PAIRED = 1024
#: Documents scored at a time.
ROWS = 256
THRESHOLD = 0.3
_TERM = re.compile(r"[^\W\d_]+").findall


class TermHash(dict):
    """term -> its hash, remembered for up to ``limit`` terms."""

    limit = 400_000

    def __missing__(self, term: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return h


def terms(text: str | None, h: TermHash) -> set[int]:
    return set(map(h.__getitem__, set(_TERM(text.lower())))) if text else set()


class Machine(NamedTuple):
    index: dict[int, int]  # hashed term -> row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[set[int]]) -> np.ndarray:
        """Probability that the label is 1, for documents given as sets of hashed terms."""
        get = self.index.get
        ids = [[j for j in map(get, r) if j is not None] for r in rows]
        at = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.fromiter((j for x in ids for j in x), np.int64, len(at))
        return 1 / (1 + np.exp(-np.clip(self.raw(at, flat, len(ids)), -40, 40)))

    def raw(self, at: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        y = self.w0 + np.bincount(at, self.w[flat], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            y += 0.5 * (np.bincount(at, x, minlength=n) ** 2 - np.bincount(at, x * x, minlength=n))
        return y


def interacting(rows: list[tuple[np.ndarray, int]], y: np.ndarray, t: np.ndarray, support: np.ndarray) -> list[int]:
    """Of the PAIRED most frequent terms those of a pair that acts otherwise together than its terms do alone, by z-score.

    The interaction of a pair is p11 - p10 - p01 + p00, p being the share of label 1 among rows with both, one, or none. Of
    all pairs few have a z-score of 7 by chance.
    """
    top = np.sort(t[np.lexsort((t, -support))[:PAIRED]])
    if len(top) < 2:
        return []
    place = np.full(1 << BITS, -1, np.int64)
    place[top] = np.arange(len(top))
    n, hits = np.zeros((2, len(top), len(top)), np.float32), np.zeros((2, len(top)))
    x = np.zeros((1024, len(top)), np.float32)
    for label in (0, 1):
        own = [place[r[0]] for r, v in zip(rows, y, strict=True) if v == label]
        for lo in range(0, len(own), len(x)):
            x[:] = 0
            for i, r in enumerate(own[lo : lo + len(x)]):
                x[i, r[r >= 0]] = 1
            n[label] += x.T @ x
            hits[label] += x.sum(axis=0)
    total = np.array([len(y) - y.sum(), y.sum()])
    best = np.zeros(len(top))
    for lo in range(0, len(top), 256):
        part = slice(lo, lo + 256)
        n11 = n[:, part].astype(float)
        n10, n01 = hits[:, part, None] - n11, hits[:, None, :] - n11
        cells = (n11, n10, n01, total[:, None, None] - n11 - n10 - n01)
        z, var, few = 0.0, 0.0, np.inf
        for sign, c in zip((1, -1, -1, 1), cells, strict=True):
            size = c.sum(axis=0)
            p = (c[1] + 0.5) / (size + 1)
            z, var, few = z + sign * p, var + p * (1 - p) / (size + 1), np.minimum(few, size)
        best[part] = np.where(few >= 8, np.abs(z) / np.sqrt(var), 0).max(axis=1)
    return [int(top[j]) for j in np.lexsort((top, -best)) if best[j] >= 7]


def fit(rows: list[tuple[Collection[int], int]], factors: int = FACTORS, terms_kept: int = TERMS, epochs: int = 30, seed: int = 7) -> Machine:
    """Fits on rows of (distinct hashed terms, label) by AdaGrad on mini-batches; deterministic for the same rows in any order."""
    rows = sorted(((np.fromiter(t, np.int32, len(t)), label) for t, label in rows), key=lambda r: (r[1], len(r[0]), int(r[0].sum(dtype=np.int64))))
    y = np.array([r[1] for r in rows], float)
    pos, neg = y.sum(), len(y) - y.sum()
    base = float(np.log((pos + 0.5) / (neg + 0.5)))
    empty = Machine({}, base, np.zeros(0), np.zeros((0, factors)))
    if not pos or not neg:
        return empty
    # Rows are ordered by label: those of label 0 come first.
    a, b = (np.bincount(np.concatenate([r[0] for r in part]), minlength=1 << BITS) for part in (rows[int(neg) :], rows[: int(neg)]))
    t = np.flatnonzero(a + b >= 3)
    m = (a[t] + b[t]) / (pos + neg)
    s = -((a[t] / pos - b[t] / neg) ** 2) / (m * (1 - m) * (1 / pos + 1 / neg) + 1e-9)
    # Of a z-score under 3.5 many terms of clean rows would be kept by chance.
    kept = [int(t[j]) for j in np.lexsort((t, s))[:terms_kept] if s[j] < -12]
    kept += [x for x in interacting(rows, y, t, (a + b)[t]) if x not in set(kept)][: max(0, terms_kept - len(kept))]
    index = {term: j for j, term in enumerate(kept)}
    if not index:
        return empty
    place = np.full(1 << BITS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    ids = [np.sort(x[x >= 0]) for x in (place[r[0]] for r in rows)]
    rng = np.random.default_rng(seed)
    k = len(index)
    w0, w, v = base, np.zeros(k), rng.normal(0, 0.01, (k, factors))
    g0, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, factors), 1e-6)
    rate, decay = 0.1, 2e-4
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            n = len(part)
            at = np.repeat(np.arange(n), [len(ids[i]) for i in part])
            flat = np.concatenate([ids[i] for i in part]) if len(at) else np.zeros(0, np.int64)
            m = Machine(index, w0, w, v)
            err = 1 / (1 + np.exp(-np.clip(m.raw(at, flat, n), -40, 40))) - y[part]
            d0 = err.mean()
            e = err[at] / n
            dw = np.bincount(flat, e, minlength=k) + decay * w * (np.bincount(flat, minlength=k) > 0) / 8
            dv = np.zeros_like(v)
            for f in range(factors):
                x = v[flat, f]
                s = np.bincount(at, x, minlength=n)
                dv[:, f] = np.bincount(flat, e * (s[at] - x), minlength=k)
            dv += decay * v * (np.bincount(flat, minlength=k) > 0)[:, None]
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            w0 -= rate * d0 / np.sqrt(g0)
            w = w - rate * dw / np.sqrt(gw)
            v = v - rate * dv / np.sqrt(gv)
    return Machine(index, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on the ``sample`` labelled rows whose id hashes are smallest, in one task: only the machine reaches the driver."""
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = chosen.count()
    if n > sample:
        # The hash is uniform: a cut at this share leaves about as many rows as asked for, and the limit is exact.
        cut = int(min(1.0, 1.2 * sample / n) * 2**31)
        chosen = chosen.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(2**31))).filter(F.col("_h") < cut).orderBy("_h", "doc_id", "toxic").limit(sample).drop("_h")
    chosen = F.broadcast(chosen)  # ``sample`` rows at most

    def work(batches):
        h = TermHash()
        for b in batches:
            yield {"toxic": b["toxic"], "terms": [np.array(sorted(terms(t.as_py(), h)), np.int32) for t in b["text"]]}

    def learn(batches):
        rows = []
        for b in batches:
            # Arrays over the Arrow buffer, as lists of numbers would take many times its bytes.
            at, flat = b["terms"].offsets.to_numpy(), b["terms"].values.to_numpy()
            rows += [(flat[lo:hi], int(y > 0)) for y, lo, hi in zip(b["toxic"].to_pylist(), at[:-1], at[1:], strict=True)]
        yield {"machine": [pickle.dumps(fit(rows))]}

    rows = by_batch(docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text"), "toxic int, terms array<int>", work)
    # An empty table may have no task.
    got = by_batch(rows.repartition(1), "machine binary", learn).head()
    return pickle.loads(got["machine"]) if got else fit([])


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the scores as column ``name``, in place of one so named; a map over the rows."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # at most TERMS rows of FACTORS + 1 numbers

    def work(batches):
        h = TermHash()
        for b in batches:
            # A batch's sets of terms would take many times its texts, so few rows at a time have theirs.
            parts = [b["text"][lo : lo + ROWS] for lo in range(0, len(b["text"]), ROWS)]
            yield b | {name: np.concatenate([np.zeros(0), *(shared.value.scores([terms(t.as_py(), h) for t in p]) for p in parts)])}

    docs = docs.drop(name)
    return by_batch(docs, schema_text(docs) + f", {name} double", work)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    machine = train(docs, labels.filter(~held))
    return (
        score(docs.select("doc_id", "text"), machine)
        .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the machine, fitted on all labels, scores at ``threshold`` or more.

    Where no term tells the labels apart, as without labels or with one only, nothing is known against any row and all stay.
    """
    name = "__marlspike_score__"
    machine = train(docs, labels)
    return score(docs, machine, name).filter(F.col(name) < threshold).drop(name) if machine.index else docs
