"""LM scoring: marginal likelihood of a subword lattice over an existing vocabulary, with corpus word counts above it.

Every word is a lattice. Its edges are the vocabulary's pieces, whose log weights start from the vocabulary's own scores
and are set to expected counts by one forward-backward pass over the training words; the forward recursion in log space
sums over all segmentations. A word seen c times in training has one more edge, the word itself: with absolute
discounting d,

    P(word) = max(c - d, 0) / N + d * V / N * lattice(word)

and P(end) = c_end / N, so probabilities sum to at most one. A document's score is the log10 of the product.

What is learned from the corpus is a table of all training words and counts. The ``head`` most frequent words (a fixed
bound) go to all tasks as a dictionary; documents' other words are summed by a join with the word table, so neither the
vocabulary nor the longest document has to fit one task.

Null and empty texts are one end token. Each input row yields its own output row, repeated ids and texts too. Columns
other than doc_id and text are ignored. Without training rows the lattice alone,
with its starting weights, gives scores, and base_score is 0 where its formula has N = 0.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, crc_mod, stored, words_of

#: Words that go to all tasks, about, and the most bytes of one. Any other is scored by a join, with the same result.
HEAD, LONG = 200_000, 64
LN10 = math.log(10)
#: Log probability of a byte that no piece covers, per byte.
BYTE = math.log(1e-4 / 256)
#: Words of more characters take logarithms in the forward-backward pass.
SHORT = 40


class Pieces(NamedTuple):
    """piece text -> log weight, and the longest piece."""

    logp: dict[str, float]
    longest: int


def vocabulary(path: str) -> Pieces:
    """Pieces with weights from the model file's own scores: a score of -r, the r-th merge, weighs 1 / (r + 300)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weights = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            weights[sp.id_to_piece(i)] = 1.0 / (300.0 - min(0.0, sp.get_score(i)))
    total = sum(weights.values())
    return Pieces({k: math.log(v / total * 0.9999) for k, v in weights.items()}, max(map(len, weights)))


def forward(word: str, p: Pieces) -> float:
    """Natural log of the sum over all segmentations of the product of their pieces' weights."""
    get, longest, n = p.logp.get, p.longest, len(word)
    alpha = [-math.inf] * (n + 1)
    alpha[0] = 0.0
    for j in range(1, n + 1):
        terms = []
        for i in range(max(0, j - longest), j):
            w = get(word[i:j])
            if w is not None:
                terms.append(alpha[i] + w)
        if get(word[j - 1]) is None:
            terms.append(alpha[j - 1] + BYTE * len(word[j - 1].encode("utf-8", "surrogatepass")))
        m = max(terms)
        alpha[j] = m + math.log(sum(math.exp(t - m) for t in terms)) if len(terms) > 1 else m
    return alpha[n]


def spelled(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "surrogatepass")


def prefixes(p: Pieces) -> dict[str, float]:
    """Each piece with its weight, and each prefix of one that is no piece itself with 0."""
    out = {k[:n]: 0.0 for k in p.logp for n in range(1, len(k))}
    return out | {k: math.exp(w) for k, w in p.logp.items()}


def expected(word: str, count: float, p: Pieces, into: Counter, ways: dict[str, float] | None = None) -> None:
    """Adds the expected number of uses of each piece in ``count`` copies of the word; ``ways`` are ``prefixes(p)``."""
    ways = prefixes(p) if ways is None else ways
    if len(word) > SHORT or not _expected_short(word, count, p, into, ways):
        _expected_long(word, count, p, into, ways)


def _byte(c: str) -> float:
    return BYTE * len(c.encode("utf-8", "surrogatepass"))


def _expected_short(word: str, count: float, p: Pieces, into: Counter, ways: dict[str, float]) -> bool:
    """Without logarithms; false, with nothing added, where the word's probability is too small for that."""
    get, n = ways.get, len(word)
    alpha, steps = [1.0] + [0.0] * n, []
    for i in range(n):
        a, own = alpha[i], []
        for j in range(i + 1, n + 1):
            w = get(piece := word[i:j])
            if w is None:
                break
            if w:
                own.append((j, w, piece))
                alpha[j] += a * w
        if not own or own[0][0] > i + 1:
            w = math.exp(_byte(word[i]))
            own.append((i + 1, w, ""))
            alpha[i + 1] += a * w
        steps.append(own)
    if alpha[n] < 1e-250:
        return False
    beta = [0.0] * n + [count / alpha[n]]
    for i in range(n - 1, -1, -1):
        a, total = alpha[i], 0.0
        for j, w, piece in steps[i]:
            t = w * beta[j]
            total += t
            if piece:
                into[piece] += a * t
        beta[i] = total
    return True


def _expected_long(word: str, count: float, p: Pieces, into: Counter, ways: dict[str, float]) -> None:
    """In log space, in memory of a few numbers for each character."""
    logp, n = p.logp, len(word)

    def steps(i):
        single = False
        for j in range(i + 1, n + 1):
            if (piece := word[i:j]) not in ways:
                break
            if (w := logp.get(piece)) is not None:
                single |= j == i + 1
                yield j, w, piece
        if not single:
            yield i + 1, _byte(word[i]), ""

    def plus(x, y):
        hi, lo = (x, y) if x > y else (y, x)
        return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))

    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        for j, w, _ in steps(i):
            alpha[j] = plus(alpha[j], alpha[i] + w)
    for i in range(n - 1, -1, -1):
        for j, w, piece in steps(i):
            beta[i] = plus(beta[i], w + beta[j])
            if piece:
                into[piece] += count * math.exp(alpha[i] + w + beta[j] - alpha[n])


def piece_uses(counts: DataFrame, p: Pieces) -> dict[str, float]:
    """Expected uses of each piece over the whole table (word, c): summed in each task, then by piece."""
    sc = counts.sparkSession.sparkContext
    shared = sc.broadcast(p)

    def work(batches):
        p, into = shared.value, Counter()
        ways = prefixes(p)
        for b in batches:
            for w, c in zip(b["word"].to_pylist(), b["c"].to_pylist(), strict=True):
                expected(spelled(w), c, p, into, ways)
        yield {"piece": list(into), "uses": list(into.values())}

    parts = by_batch(counts.select("word", "c").repartition(8 * sc.defaultParallelism), "piece string, uses double", work)
    return {r["piece"]: r["uses"] for r in parts.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over column ``text``; summed within a task first, in bounded memory."""

    def work(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(words_of(t.as_py()))
            if len(c) > 300_000:
                yield {"word": list(c), "c": list(c.values())}
                c.clear()
        if c:
            yield {"word": list(c), "c": list(c.values())}

    return by_batch(texts.select("text"), "word binary, c long", work).groupBy("word").agg(F.sum("c").alias("c"))


class Model(NamedTuple):
    pieces: Pieces
    tokens: int  # N
    types: int  # V
    ends: int
    discount: float

    def base(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1))) if self.tokens else 0.0

    def word(self, word: bytes, c: int) -> float:
        lat = forward(spelled(word), self.pieces) / LN10
        if not self.tokens:
            return lat
        rest = lat + math.log10(self.discount * self.types / self.tokens)
        if c <= self.discount:
            return rest
        seen = math.log10((c - self.discount) / self.tokens)
        hi, lo = max(seen, rest), min(seen, rest)
        return hi + math.log10(1 + 10 ** (lo - hi))

    def end(self) -> float:
        return math.log10(max(self.ends, 0.5) / (self.tokens + 1)) if self.tokens else 0.0


def _level() -> Column:
    """A count below 10,000 itself, beyond that a step of one percent: a few thousand levels at any size."""
    return F.when(F.col("c") < 10_000, F.col("c")).otherwise(10_000 + F.floor(F.log(F.col("c") / 10_000) * 100)).cast("long")


def _frequent(spread: dict[int, int], head: int) -> Column:
    """Words of the highest levels, and of the level where ``head`` of them are reached a share by hash; none of over LONG bytes."""
    got = 0
    for k in sorted(spread, reverse=True):
        if got + spread[k] > head:
            share = int((head - got) / spread[k] * 2**31)
            chosen = (_level() > k) | ((_level() == k) & (F.pmod(F.xxhash64("word"), F.lit(2**31)) < share))
            break
        got += spread[k]
    else:
        chosen = F.lit(True)
    return chosen & (F.octet_length("word") <= LONG)


def _collected(words: DataFrame) -> dict[bytes, int]:
    return {bytes(w): int(c) for w, c in zip(*(x.to_pylist() for x in words.select("word", "c").toArrow().columns), strict=True)}


def train(train_docs: DataFrame, model_path: str, head: int = HEAD) -> tuple[Model, DataFrame, dict[bytes, int]]:
    """The model, the table (word, c) of every training word, and about ``head`` of its most frequent words.

    The piece weights are re-estimated on all training words; all counts, N, V and the discount are of the whole corpus too.
    """
    counts = stored(word_counts(train_docs), "words")
    ends = train_docs.count()
    spread = {r["k"]: r["n"] for r in counts.groupBy(_level().alias("k")).agg(F.count("*").alias("n")).collect()}
    total = (counts.agg(F.sum("c")).head()[0] or 0) + ends
    types = sum(spread.values()) + (ends > 0)
    n1, n2 = spread.get(1, 0), spread.get(2, 0)
    discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    top = _collected(counts.filter(_frequent(spread, head)))
    p = vocabulary(model_path)
    uses = piece_uses(counts, p)
    if uses:
        mass = sum(uses.values()) + 0.01 * len(p.logp)
        p = Pieces({k: math.log((uses.get(k, 0.0) + 0.01) / mass * 0.9999) for k in p.logp}, p.longest)
    return Model(p, total, types, ends, discount), counts, top


def score(docs: DataFrame, model: Model, counts: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text).

    A row's key is its id with its number in its task's output, drawn once and stored with the rows it keys.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rare(batches):
        m = shared.value
        for b in batches:
            c = [x or 0 for x in b["c"].to_pylist()]
            w = b["word"].to_pylist()
            yield {"word": w, "known": [int(x > 0) for x in c], "base": [m.base(x) for x in c], "score": [m.word(x, y) for x, y in zip(w, c, strict=True)]}

    scored = "word binary, known long, base double, score double"
    # The frequent words are scored once, a bounded number of them, and not by every task again.
    words = spark.createDataFrame(pa.table({"word": pa.array(top, pa.binary()), "c": pa.array(top.values(), pa.int64())})) if top else None
    heads = by_batch(words.repartition(8 * spark.sparkContext.defaultParallelism), scored, rare).toArrow() if top else None
    known = {bytes(w): (x, y) for w, x, y in zip(*(heads[c].to_pylist() for c in ("word", "base", "score")), strict=True)} if top else {}
    frequent = spark.sparkContext.broadcast(known)

    def first(batches):
        m, memo = shared.value, frequent.value
        for b in batches:
            out = {k: [] for k in ("_row", "doc_id", "n", "known", "base", "score", "word")}
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                row = uuid.uuid4().bytes
                c = Counter(words_of(text.as_py()))
                n, has, base, total = 1, int(m.ends > 0), m.base(m.ends), m.end()
                for w, k in c.items():
                    got = memo.get(w)
                    if got is None:
                        for name, v in zip(out, (row, doc, k, 0, 0.0, 0.0, w), strict=True):
                            out[name].append(v)
                        continue
                    n += k
                    has += k
                    base += k * got[0]
                    total += k * got[1]
                for name, v in zip(out, (row, doc, n, has, base, total, None), strict=True):
                    out[name].append(v)
            yield out

    parts = stored(by_batch(docs.select("doc_id", "text"), "_row binary, doc_id long, n long, known long, base double, score double, word binary", first), "parts")
    tail = parts.filter("word is not null").select("_row", "doc_id", "n", "word")
    lexicon = by_batch(tail.select("word").distinct().join(counts, "word", "left").select("word", "c"), scored, rare)
    tail = tail.join(lexicon, "word").select("_row", "doc_id", "n", (F.col("n") * F.col("known")).alias("known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("score")).alias("score"))
    return (
        parts.filter("word is null").drop("word").unionByName(tail)
        .groupBy("_row", "doc_id")
        .agg(F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .drop("_row")
    )


def op4(docs: DataFrame, model_path: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    docs = docs.select("doc_id", "text")
    model, counts, top = train(docs.filter(~held), model_path)
    return score(docs, model, counts, top).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
