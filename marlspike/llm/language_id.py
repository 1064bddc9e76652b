"""Language ID: words by per-language log frequency, unseen words by progressively shorter character n-grams.

The model has, for each language, the relative frequencies of its known words (seen twice at least, the ``words`` most
frequent of each language) and of the character n-grams of length 5 to 1 of its words, counted over a bounded sample of
labelled rows (``sample`` at most for each of the ``langs`` most frequent languages). A word that is known scores by its log frequencies; any other is
cut into the longest n-grams that are known, taking shorter ones where a longer one is not, and scores by their mean.
All word scores of a document add up; the softmax of the sums is the score.

Text that is null or has no letter is ``und`` with score 0. Rows without a lang are not learned from. With nothing to
learn from everything is ``und``. Ties go to the first language in sorted order. Repeated rows are each learned from and
each get their prediction; of a long text every word counts. Columns other than doc_id, text and lang don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, crc_mod, schema_text

SAMPLE = 5_000
#: Languages learned: the most frequent ones, ties by name.
LANGS = 256
WORDS = 40_000
GRAMS = 20_000
LONGEST = 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    got = _WORD(text.lower()) if text else []
    # The pattern also takes numbers that aren't decimal digits, such as fractions and superscripts.
    return got if "".join(got).isalpha() or not got else "".join(c if c.isalpha() else " " for c in " ".join(got)).split()


class Model(NamedTuple):
    langs: list[str]
    words: dict[str, int]  # row of word_scores
    grams: dict[str, int]
    word_scores: np.ndarray  # log frequency by language
    gram_scores: np.ndarray

    def cut(self, w: str) -> list[int]:
        """Numbers of the n-grams of an unseen word: at each place the longest that is known, then on from its last letter."""
        padded, parts, i, get = f" {w} ", [], 0, self.grams.get
        end = len(padded)
        while i < end:
            for n in range(min(LONGEST, end - i), 0, -1):
                got = get(padded[i : i + n])
                if got is not None:
                    parts.append(got)
                    i += max(1, n - 1)
                    break
            else:
                i += 1
        return parts

    def rows(self, ws: list[str]) -> np.ndarray:
        """Scores (words, langs) of distinct words."""
        out = np.zeros((len(ws), len(self.langs)))
        flat, sizes, at = [], [], []
        for j, w in enumerate(ws):
            got = self.words.get(w)
            if got is not None:
                out[j] = self.word_scores[got]
            elif parts := self.cut(w):
                at.append(j)
                sizes.append(len(parts))
                flat += parts
        if at:
            n = np.array(sizes)
            out[at] = np.add.reduceat(self.gram_scores[flat], np.cumsum(n) - n, axis=0) / n[:, None]
        return out


def tally(rows: DataFrame) -> DataFrame:
    """(lang, kind, key, n): words as ``w`` and n-grams of words as ``g``, summed within a task first."""

    def work(batches):
        c: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b["lang"].to_pylist(), b["text"], strict=True):
                c.setdefault(lang, Counter()).update(words(t.as_py()))
        for lang, seen in c.items():
            grams: Counter = Counter()
            for w, n in seen.items():
                p = f" {w} "
                for k in range(1, LONGEST + 1):
                    for i in range(len(p) - k + 1):
                        grams[p[i : i + k]] += n
            for kind, got in (("w", seen), ("g", grams)):
                yield {"lang": [lang] * len(got), "kind": [kind] * len(got), "key": list(got), "n": list(got.values())}

    return by_batch(rows.select("lang", "text"), "lang string, kind string, key string, n long", work).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE, langs: int = LANGS) -> Model:
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(langs)
    found = sorted(r["lang"] for r in sizes.collect())
    if not found:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    # A cut by hash leaves a little more rows of a language than asked for, and the rank makes the bound exact.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31))
    chosen = labelled.join(F.broadcast(sizes), "lang").withColumn("_h", place).filter(F.col("_h") <= (1.2 * sample + 100) / F.col("_n") * 2**31)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))
    chosen = chosen.withColumn("_r", rank).filter(F.col("_r") <= sample).select("lang", "text")
    # Of each language at most WORDS words and GRAMS n-grams reach the driver.
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = tally(chosen).withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("kind") == "w", WORDS).otherwise(GRAMS)).drop("_r").toArrow()
    at = {k: i for i, k in enumerate(found)}
    counts: dict[str, dict[str, np.ndarray]] = {"w": {}, "g": {}}
    for lang, kind, key, n in zip(*(top[c].to_pylist() for c in ("lang", "kind", "key", "n")), strict=True):
        counts[kind].setdefault(key, np.zeros(len(found)))[at[lang]] = n

    def logs(table: dict[str, np.ndarray], least: int) -> tuple[dict[str, int], np.ndarray]:
        total = sum(table.values(), np.zeros(len(found))) + 1
        kept = [k for k, v in table.items() if v.sum() >= least]
        return {k: j for j, k in enumerate(kept)}, np.array([np.log((table[k] + 0.1) / total) for k in kept]).reshape(-1, len(found))

    (w, ws), (g, gs) = logs(counts["w"], 2), logs(counts["g"], 1)
    return Model(found, w, g, ws, gs)


class Rows(dict):
    """word -> row number in a growing score matrix; forgets all beyond ``limit`` words."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.scores = np.zeros((1024, len(model.langs)))

    def totals(self, docs: list[list[str]]) -> np.ndarray:
        """Sums of word scores, a row for each document."""
        if len(self) > self.limit:
            self.clear()
        new = list(set().union(*docs).difference(self))
        n = len(self) + len(new)
        if n > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(n, 2 * len(self.scores)) - len(self.scores), self.scores.shape[1]))])
        self.scores[len(self) : n] = self.model.rows(new)
        self.update(zip(new, range(len(self), n), strict=True))
        out = np.zeros((len(docs), self.scores.shape[1]))
        for j, ws in enumerate(docs):
            out[j] = self.scores[list(map(self.__getitem__, ws))].sum(axis=0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names; a map over the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS + GRAMS keys for each language

    def work(batches):
        m = shared.value
        rows = Rows(m)
        for b in batches:
            lang, score = [], []
            for lo in range(0, len(b["text"]), 64):
                docs_ = [words(t.as_py()) for t in b["text"][lo : lo + 64]]
                if not m.langs:
                    lang += [UNKNOWN] * len(docs_)
                    score += [0.0] * len(docs_)
                    continue
                for ws, s in zip(docs_, rows.totals(docs_), strict=True):
                    k = int(np.argmax(s))
                    lang.append(m.langs[k] if ws else UNKNOWN)
                    score.append(float(1 / np.exp(s - s[k]).sum()) if ws else 0.0)
            yield dict(b) | {"lang_pred": lang, "score": score}

    docs = docs.drop("lang_pred", "score")
    return by_batch(docs, schema_text(docs) + ", lang_pred string, score double", work)


def op10(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = train(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
