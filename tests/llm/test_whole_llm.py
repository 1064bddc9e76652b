"""What operators once left out: each on a small table where it counts."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest

from marlspike.llm import decontaminate, line_dedup, lm_scoring, toxicity
from marlspike.llm.queries import vocabulary_file


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST, 0])
def test_shared_lines_go_from_documents_that_are_mostly_shared(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup.strip, "__defaults__", (*line_dedup.strip.__defaults__[:-1], broadcast))
    texts = [f"the header of every page\nbody number {i} of one page\nthe footer of every page" for i in range(6)] + ["the header of every page"]
    docs = spark.createDataFrame([(i, t, f"site{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.op6(docs).collect()}
    assert got == {i: (3, 2, sha(f"body number {i} of one page")) for i in range(6)} | {6: (1, 1, sha(""))}


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST, 0])
def test_short_shared_lines_go(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup.strip, "__defaults__", (*line_dedup.strip.__defaults__[:-1], broadcast))
    docs = spark.createDataFrame([(i, f"Menu\n\nbody number {i} of one page\n  \nAll rights reserved.", f"site{i}") for i in range(6)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.op6(docs).collect()}
    assert got == {i: (5, 2, sha(f"\nbody number {i} of one page\n  ")) for i in range(6)}


def test_piece_weights_come_from_all_words(spark):
    """Also from words beyond the most frequent 20,000, and from those of over 64 bytes."""
    path = vocabulary_file("piece_bpe_32k.model")
    start = lm_scoring.vocabulary(path)
    words = {f"{k:x}q" for k in range(20_500)} | {"東京" * 40, "東京" * 400, "internationalisation" * 9}
    texts = [(k, " ".join([w] * (1 if w.endswith("3q") or len(w) > 20 else 2))) for k, w in enumerate(sorted(words))]
    model, _, _ = lm_scoring.train(spark.createDataFrame(texts, "doc_id long, text string"), path)
    uses = Counter()
    ways = lm_scoring.prefixes(start)
    for _, t in texts:
        for w, n in Counter(lm_scoring.words_of(t)).items():
            lm_scoring._expected_long(lm_scoring.spelled(w), n, start, uses, ways)
    mass = sum(uses.values()) + 0.01 * len(start.logp)
    want = {k: math.log((uses.get(k, 0.0) + 0.01) / mass * 0.9999) for k in start.logp}
    assert model.pieces.logp == pytest.approx(want, rel=1e-9)
    assert uses["東京"] > 100 or uses["東"] > 100


def test_decontamination_does_not_depend_on_slices(spark):
    """Items share templates, and windows mix passages of several items, also of other slices."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    templates = [[word() for _ in range(20)] for _ in range(4)]
    items = [(i, " ".join(templates[i % 4] + [word() for _ in range(14)])) for i in range(40)] + [(40, ""), (41, None), (7, "one two three four five six")]
    texts = []
    for i in range(40):
        w = items[i][1].split()
        for cut in range(1, 6):
            texts.append(" ".join(w[:-cut] + templates[(i + 1) % 4][:cut] + templates[(i + 2) % 4][5:15]))
            texts.append(" ".join(w[:-cut] + [word() for _ in range(cut)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((*r[:4], round(r.similarity, 9)) for r in decontaminate.matches(docs, bench, slice_items=k).collect()) for k in (20_000, 15, 4)]
    assert got[0] and got[0] == got[1] == got[2]
    kept = [sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, slice_items=k).collect()) for k in (20_000, 15)]
    assert kept[0] == kept[1] == sorted(set(range(len(texts))) - {r[0] for r in got[0]}) and kept[0]


@pytest.mark.parametrize("slice_items", [20_000, 1])
def test_short_items_match_within_longer_texts(spark, slice_items):
    bench = spark.createDataFrame([(1, "Blue whale"), (2, "cat"), (3, "a b c d"), (4, "no such words"), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "the big blue, whale and a blue whale sang"), (11, "cat"), (12, "x a b c d e cats"), (13, "blue and whale"), (14, None), (15, "zero one two three four five")], "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.matches(docs, bench, slice_items=slice_items).collect()))
    assert got == [(10, 1, 2, 2, 1.0), (11, 2, 0, 1, 1.0), (12, 3, 1, 4, 1.0), (15, 5, 1, 5, 1.0)]
    kept = decontaminate.drop_contaminated(docs, bench, slice_items=slice_items).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [13, 14]


def test_the_machine_is_fitted_off_the_driver(spark, monkeypatch):
    """Training rows take many times the machine's memory; the driver gets the machine alone, and the same one."""
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(rows):
        assert os.getpid() != driver, "fitted on the driver"
        return fit(rows)

    texts = [(i, f"{'vile' if i % 3 == 0 else 'kind'} word{i % 7} other{i % 5}") for i in range(300)]
    docs = spark.createDataFrame([*texts, (300, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(302)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.train(docs, labels)
    h = toxicity.TermHash()
    want = fit([(sorted(toxicity.terms(t, h)), int(i % 3 == 0)) for i, t in [*texts, (300, None), (301, "")]])
    assert want.index and got.index == want.index and got.w0 == want.w0 and (got.w == want.w).all() and (got.v == want.v).all()


def test_shared_lines_are_read_once(spark):
    keys = [hashlib.md5(f"line {i}".encode()).digest() for i in range(40)]
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    told = spark.createDataFrame([(k,) for k in keys], "_ld_key binary").mapInArrow(tell, "_ld_key binary")
    docs = spark.createDataFrame([(1, "line 3\nline 50\nline 39"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.strip(docs, told).collect()))
    assert got == [(1, "line 50", 3, 2), (2, None, 0, 0), (3, "", 1, 0)]
    assert read.value == len(keys)
