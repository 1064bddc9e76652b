"""The pipeline's rows against plain versions of its stages, with odd rows, clashing columns and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marlspike.llm import decontaminate, toxicity
from marlspike.llm.common import words_of
from marlspike.llm.queries import vocabulary_file

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": COLUMNS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def material():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(300)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(12, 30))) for i in range(6)] + [(9, None), (9, "")]
    texts = [prose(rng.randint(20, 90)) for _ in range(60)]
    texts += [f"{prose(30)} vile slur {prose(20)}" for _ in range(25)]
    texts += [f"a line of every page\n{prose(40)}\nanother such line" for _ in range(12)]
    base = prose(120).split()
    for k in range(8):
        w = list(base)
        w[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(w))
    texts += [f"{prose(15)} {items[k][1]} {prose(25)}" for k in range(4)] + [texts[3], texts[3], None, "", "one", " \n", "é ü 東京"]
    docs = [(i, t, "en", f"s{i % 9}" if i % 17 else None, len(t) if t else None) for i, t in enumerate(texts)]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts) if i % 2 == 0] + [(5, 1, None), (None, 1, 1), (9999, 0, 1)]
    return [*docs, docs[4], docs[4]], labels, items


def plain(docs, labels, items):
    """doc_id -> text that is left before packing."""
    h = toxicity.TermHash()
    text = {d[0]: d[1] for d in docs}
    rows = [(np.array(sorted(toxicity.terms(d[1], h)), np.int32), label) for i, _, label in labels if label is not None for d in docs if d[0] == i and i is not None]
    m = toxicity.fit(rows)
    docs = [d for d in docs if m.scores([toxicity.terms(d[1], h)])[0] < toxicity.THRESHOLD]
    sites = {}
    for d in docs:
        for x in (d[1] or "").split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(d[3] or "")
    gone = {x for x, s in sites.items() if len(s) >= 5}
    text = {d[0]: d[1] if d[1] is None else "\n".join(x for x in d[1].split("\n") if x.strip(" ") not in gone) for d in docs}
    sets = {}
    for i, t in text.items():
        w = words_of(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    of = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            a, b = sets[x], sets[y]
            if x < y and a and b and len(a & b) * 100 >= 80 * len(a | b) and of[x] != of[y]:
                lo, hi = sorted((of[x], of[y]))
                of = {k: lo if v == hi else v for k, v in of.items()}
    text = {i: t for i, t in text.items() if of[i] == i}
    bench = decontaminate.Benchmark([x for x in items if x[1]])

    def clean(t):
        w = next(decontaminate.word_hashes([t]))
        s = decontaminate.shingle_hashes(w, 5)
        for j in range(len(bench.ids)):
            size = min(bench.length[j], len(w))
            for at in range(len(w) - size + 1) if len(w) else ():
                if bench.similarity(set(s[at : at + max(1, size - 4)].tolist()), j) >= 0.8:
                    return False
        return True

    return {i: t for i, t in text.items() if clean(t)}


def write(spark, folder, tables):
    for (name, schema), rows in zip(TABLES.items(), tables, strict=True):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_is_the_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = material()
    want = plain(docs, labels, items)
    assert {111, 112} <= set(want) and not {105, 106, 107, 108, 109, 110} & set(want) and not any("vile" in (t or "") for t in want.values())
    got = corpus_pipeline.run(spark, write(spark, tmp_path, (docs, labels, items))).collect()
    tok = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    assert Counter({r.doc_id: r.length for r in got}) == Counter({i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()})
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_no_rows(spark, tmp_path, stage):
    docs, labels, items = material()
    name, work = corpus_pipeline.STAGES[stage]
    extra = ", score double, lang_pred string, _h long, _n long, copy boolean, `label` int, sid long, n int"
    odd = [(*d, 0.5, "x", 1, 2, True, 1, 1, 1) for d in [*docs[:20], *docs[-8:], (None, "a text without an id", None, None, None), (None, None, None, None, None), (3, "another text of document three", "en", "s", 1)]]
    folder = write(spark, tmp_path, (docs[:30], labels, items))
    table = spark.createDataFrame(odd, COLUMNS + extra)
    out = work(spark, table, folder)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) >= 20 and None in {r.doc_id for r in rows}
    if stage < 4:
        assert out.columns == table.columns
    assert work(spark, table.limit(0), folder).count() == 0
    for part in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{part}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{part}.parquet")
    assert work(spark, table, f"{tmp_path}/none").count() > 0
