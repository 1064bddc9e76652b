"""Rows without an id, ids with several texts, columns named like our own, a very long text, and words made to collide."""

import hashlib
import random

import numpy as np
import pytest

from marlspike.llm import ann, chat_format, decontaminate, language_id, line_dedup, lm_scoring, ngram_join, packing, suffix_dedup, toxicity
from marlspike.llm.common import Words, shingle_hashes, words_of
from marlspike.llm.queries import vocabulary_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _h long, _n long, label int, n long, word string, copy boolean"


def texts():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(500)}"
    base = " ".join(word() for _ in range(80))
    return [base, base + " end", " ".join(word() for _ in range(50)), None, "", "one two", " ".join(word() for _ in range(120))]


@pytest.fixture(scope="module")
def odd(spark):
    t = texts()
    ids = [1, 2, 3, 4, 5, 6, 7, None, None, None, 3, 3, 1]
    own = [*t, t[0], t[6], None, t[2], t[5], t[0]]
    rows = [(i, x, "en", f"s{k}", 1, 0.5, "x", 9, 9, 1, 1, "a", True) for k, (i, x) in enumerate(zip(ids, own, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_words_are_hashed_whole():
    a = "a"
    for _ in range(12):
        a += a.translate(str.maketrans("ab", "ba"))
    h = next(Words().each([f"{a} {a.translate(str.maketrans('ab', 'ba'))} {a.upper()}"]))
    assert len(a) == 4096 and h[0] != h[1] and h[0] == h[2]
    rng = random.Random(1)
    words = {"".join(rng.choice("abAB") for _ in range(n)) for n in range(1, 600) for _ in range(30)}
    texts = [" ".join(x) for x in (sorted(words), rng.sample(sorted(words), 5000))] + ["", None, " a\tb\x0bc "]
    got = [h.tolist() for h in Words(limit=9000).each(texts)]
    name = {}
    for t, hs in zip(texts, got, strict=True):
        own = words_of(t)
        assert len(own) == len(hs)
        for w, x in zip(own, hs, strict=True):
            assert name.setdefault(w, x) == x
    assert len(set(name.values())) == len(name)
    for k in (1, 4):
        for t, h, s in zip(texts, Words().each(texts), Words(limit=99).shingles(texts, k), strict=True):
            assert shingle_hashes(h, k).tolist() == s.tolist()


def test_join_keeps_such_words_apart(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x y {a} z u v"), (2, f"x y {b} z u v")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.op7(docs).collect()} == {1, 2}


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(k, "plain english words here", "en") for k in range(20)] + [(50, "\u00bd \u00b2", "en"), (51, "\u2163 12 _", "en"), (52, "x\u00b2y", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op10(docs).collect()}
    assert got[50] == ("und", 0.0) and got[52][0] == "en"
    assert got[51][0] == "und"  # a Roman numeral sign is a number
    assert language_id.words("x\u00b2y A\u00bd") == ["x", "y", "a"]


def test_sample_bounds_hold(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 3}", f"l{k % 9}") for k in range(300)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs, 5, 4).langs) == 4
    assert language_id.train(docs, 5, 4).langs == ["l0", "l1", "l2", "l3"]


def test_each_operator_takes_them(spark, odd):
    n = odd.count()
    t = texts()
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(None, t[6]), (None, None), (4, t[6]), (4, t[2])], "item_id long, text string")
    assert packing.op1(odd, vocabulary_file("word_bpe_49k.json")).count() == n
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect()} == {(7, None), (7, 4), (None, None), (None, 4), (3, 4)}
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and {r.text for r in kept.collect()} == {t[0], t[1], None, "", "one two"}
    got = suffix_dedup.op3(odd).collect()
    assert len(got) == n and sum(r.n_bytes for r in got if r.doc_id is None) == len(t[0]) + len(t[6])
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id is None and r.n_bytes)
    assert {r.n_removed for r in got if r.doc_id == 1} == {0}
    assert lm_scoring.op4(odd, vocabulary_file("piece_bpe_32k.model")).count() == n
    assert line_dedup.op6(odd).count() == n
    joined = ngram_join.components(odd).collect()
    assert len(joined) == n and {r.component_id for r in joined if r.doc_id is None} == {1, 7, None}
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 3 and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7, None}  # 6 is a copy of a text of 3
    assert toxicity.op9(odd, labels).count() == n
    clean = toxicity.drop_toxic(odd, labels, 2.0)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert language_id.op10(odd).count() == n
    assert language_id.predict(odd, language_id.train(odd)).select("lang_pred", "score").count() == n
    stripped = line_dedup.strip(odd, line_dedup.boilerplate(odd)).select(*odd.columns)
    assert stripped.count() == n


def test_other_tables_of_odd_rows(spark):
    vec = spark.createDataFrame([(None, [1.0, 0.0], 1), (50, [1.0, 0.5], 1), (1, [0.5, 0.5], 1), (1, [0.1, 0.5], 1)], "vec_id long, embedding array<float>, score int")
    assert [(r.query_id, r.vec_id) for r in ann.op8(vec).collect()] == [(50, 1)]
    turns = spark.createDataFrame([(None, None, None, None, 1), (1, None, "user", "a", 1)], "conv_id long, turn long, role string, text string, input_ids int")
    assert {r.conv_id for r in chat_format.op5(turns, vocabulary_file("byte_bpe_50k.tiktoken")).collect()} == {None, 1, -7}


def test_a_text_of_a_million_words(spark):
    rng = np.random.default_rng(0)
    w = [f"w{x}" for x in rng.integers(0, 3000, 1_000_000)]
    long = " ".join(w)
    near = " ".join([*w[:500_000], *[f"u{i}" for i in range(30_000)], *w[500_000:]])
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short text of few words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    bench = spark.createDataFrame([(7, " ".join(w[700_000:700_040])), (8, "nothing of the kind in there at all")], "item_id long, text string")
    got = decontaminate.matches(docs, bench).select("doc_id", "item_id", "start").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 700_000), (2, 7, 730_000)]
    kept = {r.doc_id: (r.n_bytes - r.n_removed, r.kept_sha256) for r in suffix_dedup.op3(docs).collect()}
    assert kept[1] == (len(long), hashlib.sha256(long.encode()).hexdigest())
    assert abs(kept[2][0] - sum(len(f"u{i} ") for i in range(30_000))) < 2


def test_prefix_is_linear():
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 100_000).astype(np.uint64))
    none = ngram_join.Cold(np.zeros(1 << (ngram_join.COLD_BITS - 3), np.uint8))
    assert len(ngram_join.prefix(s, none, 80, 100)[0]) == len(s) - -(-len(s) * 80 // 100) + 1


def test_labels_that_need_two_terms():
    """Label 1 where one of two terms occurs without the other: neither term says anything by itself."""
    rng = random.Random(0)
    rows = []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(({*([1] * a), *([2] * b), *rng.sample(range(10, 60), 5)}, int(a != b)))
    m = toxicity.fit(rows)
    assert set(m.index) == {1, 2}
    s = m.scores([{1}, {2}, {1, 2}, set()])
    assert min(s[:2]) > 0.8 and max(s[2:]) < 0.3
