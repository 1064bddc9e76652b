"""Best-fit packing: length patterns of few documents fitted to the length histogram by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` entries whatever the input, so it is the only thing the driver
sees. There the patterns (one to three lengths that fill a sequence exactly, or a length repeated) get repeat counts by
NNLS, the counts are rounded down to what the histogram has, and the residual is packed best-fit-decreasing, again on
the histogram and with repeats. The result is a plan of slots: (length, first rank, count, first sequence, offset). A
piece finds its slot by its rank among the pieces of its length; ranks come from counts of (length, bucket), so a length
that a third of all pieces have is dealt to all tasks.

Nulls and empty texts have only the end id. Repeated rows with the same doc_id keep their own pieces and slots.
Empty tables give an empty result. Columns other than ``id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, shared_dir, stored

CAPACITY = 4096
#: Ranks are counted within this many buckets of each length.
BUCKETS = 64


class WordIds(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes; forgets all beyond ``limit`` entries."""

    def __init__(self, encode, limit: int = 400_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = array("I", self.encode(word)).tobytes()
        return out


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def word_encoder(path: str):
    """Ids of one pre-token, or None if the vocabulary's form doesn't allow it.

    The vocabulary's ids are in merge order, so they serve as merge ranks; the end-of-word suffix is written as the byte
    255, which no UTF-8 text holds and which always merges first.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {k for k in vocab if k.startswith("<|")}
    order = sorted((v, k) for k, v in vocab.items() if k not in special)
    if not suffix or [k for _, k in order[512:]] != ["".join(m) for m in merges]:
        return None
    of = byte_of_char()
    ranks = {}
    for rank, token in order:
        end = token.endswith(suffix)
        ranks[bytes(of[c] for c in (token[: -len(suffix)] if end else token)) + b"\xff" * end] = rank
    own = {r for b, r in ranks.items() if len(b) == 2 and b[1] == 255}
    if {r for b, r in ranks.items() if len(b) == 1} | own != set(range(512)):
        return None
    ranks.setdefault(b"\xff", max(ranks.values()) + 1)
    bpe = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    one = bpe._core_bpe.encode_single_piece
    return lambda word: one(word.encode() + b"\xff")


class WordTokenizer:
    """Ids of a tokenizer whose pre-tokens are encoded independently, remembered by pre-token.

    Text that may hold a special token, or for which the tokenizer's normaliser does more than lower-casing ASCII
    or Latin letters, goes to the tokenizer whole; so ids always equal ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.ids = WordIds(word_encoder(path) or (lambda w: self.whole.encode(w, add_special_tokens=False).ids))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+").findall
        self.plain = re.compile(r"[\x09\x0A\x0D\x20-\x7E\u00A1-\u00AC\u00AE-\u017F\u2010-\u2027]*").fullmatch

    def encode(self, text: str) -> bytes:
        if "<|" in text or "İ" in text or not self.plain(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        split = self.ascii if text.isascii() else self.split
        return b"".join(map(self.ids.__getitem__, split(text.lower())))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the token ids themselves stay in the task.

    The tokenizer file's bytes travel with the task (a fixed size), so executors need no path of the driver's.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        import os
        import tempfile

        with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, encoding="utf-8") as f:
            f.write(blob.value)
        tok = WordTokenizer(f.name)
        os.unlink(f.name)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for i, text in zip(b["id"].to_pylist(), b["text"]):
                ids = tok.encode(text.as_py() or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (i, p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            yield out

    return by_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def patterns(hist: dict[int, int], capacity: int, most: int = 60_000) -> list[tuple[int, ...]]:
    """Patterns of one to three documents that fill a sequence exactly: a length with its complement, or with two others."""
    lengths = sorted(hist, reverse=True)
    found = {(capacity,)} if capacity in hist else set()
    found.update((a, capacity - a) for a in lengths if a >= capacity - a and capacity - a in hist)
    weight = sorted(lengths, key=lambda x: -hist[x] * x)
    for a in lengths:
        for b in weight[:200]:
            c = capacity - a - b
            if 0 < c and c in hist:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        if len(found) >= most:
            break
    return sorted(found, reverse=True)


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative x for min ||A x - target||; column j of A counts the lengths ``rows[j]`` (-1: none). Accelerated projected gradient."""
    n, size = len(rows), len(target)
    used = rows >= 0
    safe = np.where(used, rows, 0)

    def forward(x):
        return np.bincount(safe.ravel(), (used * x[:, None]).ravel(), minlength=size)

    # ||A||^2 is at most the largest column sum times the largest row sum.
    step = 1.0 / max(1.0, 3.0 * np.bincount(safe[used], minlength=size).max(initial=1))
    scale = np.array([target[r[r >= 0]].min() for r in rows], float) if n else np.zeros(0)
    spread = np.bincount(safe[used], minlength=size).astype(float)
    x = y = scale / np.maximum(1, spread[safe].max(axis=1)) if n else scale
    t = 1.0
    for _ in range(steps):
        r = forward(y) - target
        g = (used * r[safe]).sum(axis=1)
        z = np.maximum(0, y - step * g)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return np.maximum(x, 0)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, count, first sequence, offset) that cover the histogram, and the number of sequences."""
    left = Counter({k: v for k, v in hist.items() if v > 0})
    slots: list[tuple[int, int, int, int, int]] = []
    given: Counter = Counter()
    sequences = 0

    def use(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in pattern:
            slots.append((length, given[length], times, sequences, at))
            given[length] += times
            left[length] -= times
            at += length
        sequences += times

    found = patterns(left, capacity)
    if found:
        rows = np.array([list(p) + [-1] * (3 - len(p)) for p in found])
        target = np.zeros(capacity + 1)
        for k, v in left.items():
            target[k] = v
        x = nnls(rows, target)
        for j in np.argsort(-x, kind="stable"):
            need = Counter(found[j])
            times = min(int(np.floor(x[j] + 0.5)), *(left[k] // m for k, m in need.items()))
            if times > 0:
                use(found[j], times)
    present = np.zeros(capacity + 1, bool)
    for k, v in left.items():
        present[k] = v > 0
    while present.any():
        room, pattern = capacity, []
        taken: Counter = Counter()
        while room > 0:
            fits = np.flatnonzero(present[: room + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            m = min(left[k] - taken[k], room // k) if pattern else 1
            pattern += [k] * m
            taken[k] += m
            room -= m * k
            if taken[k] == left[k]:
                present[k] = False
        times = min(left[k] // m for k, m in taken.items())
        use(tuple(pattern), times)
        for k in taken:
            present[k] = left[k] > 0
    return slots, sequences


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_df`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    A piece's rank among its length is the count of earlier (length, bucket) cells plus its rank in its own cell.
    The slots are a table of at most a few times ``capacity`` rows and may be broadcast at any input size.
    """
    spark = pieces_df.sparkSession
    cell = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(BUCKETS)).cast("int")
    rows = stored(pieces_df.withColumn("_cell", cell), "pieces")
    cells = rows.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    # At most capacity * BUCKETS rows at any input size.
    got = cells.toPandas()
    hist = {int(k): int(v) for k, v in got.groupby("length")["n"].sum().items()}
    slots, _ = plan(hist, capacity)
    got = got.sort_values(["length", "_cell"])
    got["_before"] = got.groupby("length")["n"].cumsum() - got["n"]
    before = spark.createDataFrame(pa.Table.from_pandas(got[["length", "_cell", "_before"]].astype("int64"), preserve_index=False)) if len(got) else spark.createDataFrame([], "length long, _cell long, _before long")
    slot_of: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, times, seq, at in slots:
        slot_of.setdefault(length, []).append((first, times, seq, at))
    w = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("_in", F.row_number().over(w) - 1).join(F.broadcast(before), ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_in"))

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in pieces_df.schema] + ["sequence_id long", "offset long"]
    keep = pieces_df.columns
    slots_of = spark.sparkContext.broadcast({k: (np.array([x[0] for x in v]), np.array([x[2] for x in v]), np.array([x[3] for x in v])) for k, v in slot_of.items()})

    def work(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["_rank"].to_numpy(zero_copy_only=False)
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                first, s, o = slots_of.value[int(k)]
                i = np.searchsorted(first, rank[own], "right") - 1
                seq[own], at[own] = s[i] + rank[own] - first[i], o[i]
            yield {c: b[c] for c in keep} | {"sequence_id": seq, "offset": at}

    return by_batch(ranked, ", ".join(schema), work)


def op1(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    shared_dir(docs.sparkSession)
    return pack(pieces(docs, tokenizer_path))
