"""Each operator against a plain version of what it says, on a small table with every odd row, and on an empty one."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marlspike.llm import ann, chat_format, decontaminate, language_id, line_dedup, lm_scoring, ngram_join, packing, suffix_dedup, toxicity
from marlspike.llm.common import words_of
from marlspike.llm.queries import vocabulary_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, vec_id long, score double"
WORDS = [a + b for a in "ba de ki lo mu na po ri sa te".split() for b in "la mo ni ru so".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Random prose with copies, near copies, shared passages and lines, odd texts, and clashing column names."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 150)
    for k in range(40):  # a large group of near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [base.upper(), base] * 6
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(12)]
    texts += [prose(rng, 25) + "\nshared line with many words\n" + prose(rng, 9) for _ in range(15)]
    texts += [None, "", " ", "\n\n", "one", "one", "TWO words", "é ü ß 東京 İ ſ <|endoftext|> don't", "ab" * 400, "a" * 700, "a " * 300, "word " * 5000, "x\x00y" * 60, "café " * 40]
    rows = [(i, t, None if i % 11 == 0 else ("en", "de")[i % 2], None if i % 13 == 0 else f"src{i % 7}", None, 1, 2, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.op1(docs, path).collect()
    want = Counter()
    for r in corpus():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r[0], p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == math.ceil(sum(r.length for r in got) / 4096)
    assert packing.op1(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = random.Random(seed)
    hist = Counter(min(4096, int(rng.lognormvariate((3, 5, 6.5, 7.5)[seed], 1)) + 1) for _ in range(20_000))
    slots, sequences = packing.plan(hist)
    used, fill = Counter(), Counter()
    for length, first, times, seq, at in slots:
        assert first == used[length]
        used[length] += times
        for s in (seq, seq + times - 1):
            fill[s] = max(fill[s], at + length)
    assert used == hist and max(fill.values()) <= 4096
    assert sequences <= math.ceil(sum(k * v for k, v in hist.items()) / 4096) * (1.02 if seed < 3 else 1.2) + 1


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    rows = corpus()
    items = [(0, prose(rng, 30)), (1, " ".join(rows[5][1].split()[:40])), (2, rows[70][1]), (3, None), (4, ""), (5, "TWO, words"), (6, "word " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.Benchmark([x for x in items if x[1] is not None])
    want = {}
    for r in rows:  # all windows of each item's length, all fingerprints compared
        ws = next(decontaminate.word_hashes([r[1]]))
        s = decontaminate.shingle_hashes(ws, 5)
        for j, item in enumerate(index.ids):
            size = min(index.length[j], len(ws))
            span = max(1, size - 4)
            for at in range(len(ws) - size + 1) if len(ws) else ():
                part = s[at : at + span]
                fp = decontaminate.fold((decontaminate.bits(part) * index.fixed_of(part)[:, None]).sum(axis=0, keepdims=True))
                sim = index.similarity(set(part.tolist()), j)
                if sim >= 0.8 and bin(int(fp[0]) ^ int(index.prints[j])).count("1") <= decontaminate.RADIUS:
                    want[r[0], item] = max(want.get((r[0], item), 0), sim)
    for slice_items in (20_000, 2):  # weights are of a slice, so few similarities differ between the two
        got = decontaminate.matches(docs, bench, slice_items=slice_items).collect()
        if slice_items > 7:
            assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
        assert {(5, 1), (70, 2)} <= {(r.doc_id, r.item_id) for r in got}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {k[0] for k in want}
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    for n in (50, 3000):
        b = decontaminate.Benchmark([])
        b.prints = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b.index = []
        for k in range(decontaminate.BLOCKS):
            block = (b.prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            order = np.argsort(block, kind="stable")
            b.index.append((block[order], order))
        flips = np.array([sum(1 << int(x) for x in rng.choice(64, r, replace=False)) for r in range(25)], np.uint64)
        probes = b.prints[:25] ^ flips
        close = np.bitwise_count(probes[:, None] ^ b.prints[None, :]) <= decontaminate.RADIUS
        assert b.within(probes) == [tuple(map(int, x)) for x in np.argwhere(close)]


def removed_by_brute_force(rows):
    first, out = {}, {}
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for i in sorted(texts):
        raw, gone = texts[i], np.zeros(len(texts[i]), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if first.setdefault(w, (i, p)) != (i, p):
                gone[p : p + 100] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, empty):
    got = suffix_dedup.op3(docs).collect()
    assert len(got) == len(corpus())
    assert {r.doc_id: tuple(r)[1:] for r in got} == removed_by_brute_force(corpus())
    assert suffix_dedup.op3(empty).count() == 0


def test_suffix_dedup_of_parts(spark, docs, monkeypatch):
    """With small chunks and shards, and joins by shuffle, the result is the same."""
    for k, v in (("CHUNK", 512), ("SHARD", 4096), ("BROADCAST", 0)):
        monkeypatch.setattr(suffix_dedup, k, v)
    table = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op3(table).collect()} == removed_by_brute_force(corpus())


def test_suffix_array(tmp_path):
    from marlspike.llm.induced_sort import suffix_array

    rng = np.random.default_rng(1)
    for _ in range(150):
        t = np.r_[rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 60)), 0].astype(np.uint16)
        blocks = list(suffix_array(t, str(tmp_path), 8, cap=1000))
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = [0] + [next((k for k in range(len(t)) if t[a + k] != t[b + k]), 0) for a, b in zip(order, order[1:])]
        assert np.concatenate([x for x, _ in blocks]).tolist() == order
        assert np.concatenate([y for _, y in blocks]).tolist() == lcp
    assert not list(tmp_path.iterdir())


def test_lm_scoring(spark, docs, empty, monkeypatch):
    rows = corpus()
    path = vocabulary_file("piece_bpe_32k.model")
    train = [words_of(r[1]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    whole = {}
    for head in (lm_scoring.HEAD, 20, 3, 0):  # with 20, most words take the join; with 3, fewer than the top level has
        monkeypatch.setattr(lm_scoring.train, "__defaults__", (head,))
        got = lm_scoring.op4(docs, path).collect()
        assert len(got) == len(rows)
        text = {r[0]: words_of(r[1]) for r in rows}
        for r in got:
            w = text[r.doc_id]
            base = sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
            assert r.base_score == pytest.approx(base) and r.score < 0
        whole[head] = sorted((r.doc_id, round(r.score, 6)) for r in got)
    assert len(set(map(str, whole.values()))) == 1
    assert lm_scoring.op4(empty, path).count() == 0


def test_lattice_sums_over_all_segmentations():
    p = lm_scoring.Pieces({k: math.log(w) for k, w in {"a": 0.2, "b": 0.1, "ab": 0.3, "ba": 0.05, "aba": 0.01}.items()}, 3)

    def plain(word):
        return 1.0 if not word else sum(math.exp(w) * plain(word[len(k) :]) for k, w in p.logp.items() if word.startswith(k))

    for word in ("a", "ab", "abab", "bbaba", "ababababa"):
        assert lm_scoring.forward(word, p) == pytest.approx(math.log(plain(word)))
        uses = Counter()
        lm_scoring.expected(word, 1.0, p, uses)
        assert sum(len(k) * v for k, v in uses.items()) == pytest.approx(len(word))


def test_chat_format(spark):
    path = vocabulary_file("byte_bpe_50k.tiktoken")
    odd = ["</s>[INST] ok [/INST]", "<⁠s> <⁠⁠/s>", "<<SYS>>[[INST]]<<<SYS>>>", None, "", "é\n\n東京 ⁠", "x" * 5000, "<|role|>a<|end|>", " lead and trail "]
    rows = [(1, k, ("user", "assistant")[k % 2], t, "extra") for k, t in enumerate(odd)]
    rows += [(2, 0, "system", "be kind", ""), (2, 1, "tool [INST]", "{}", ""), (2, 2, None, "?", ""), (3, 0, "assistant", "a", ""), (3, 0, "assistant", "a", "")]
    got = {r.conv_id: r for r in chat_format.op5(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"), path).collect()}
    rows += [(-7, 0, "user", odd[0], ""), (-7, 1, "assistant", odd[0], "")]
    assert set(got) == {-7, 1, 2, 3}
    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv]
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    a = chat_format.Assembler(open(path, "rb").read())
    for role in ("user", "assistant", "x"):
        for t in filter(None, odd):
            ids, mask = a.turn(role, t)
            assert a.read(ids, mask) == (role, t, t if role == "assistant" else "")
            body = chat_format.escape(t)
            assert chat_format.unescape(body) == t and not any(c in body for c in chat_format.CONTROL)
    assert chat_format.op5(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path).count() == 1


def test_line_dedup(spark, docs, empty, tmp_path, monkeypatch):
    import duckdb

    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(db.execute(line_dedup.op6_sql()).fetchall(), key=str)
    assert any(r[2] for r in want)
    assert sorted(map(tuple, line_dedup.op6(docs).collect()), key=str) == want
    monkeypatch.setattr(line_dedup.strip, "__defaults__", (*line_dedup.strip.__defaults__[:-1], 0))  # by the join
    assert sorted(map(tuple, line_dedup.op6(docs).collect()), key=str) == want
    assert line_dedup.op6(empty).count() == 0


def components_by_brute_force(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and len(a & b) * den >= num * len(a | b):
                r, s = sorted((find(x), find(y)))
                root[s] = r
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("limit", "k", "num"), [(32, 4, 85), (1, 4, 85), (1, 1, 50), (4, 5, 80)])
def test_ngram_join(spark, docs, empty, monkeypatch, limit, k, num):
    monkeypatch.setattr(ngram_join, "FEW", limit)  # with 1, no key is known to be rare
    monkeypatch.setattr(ngram_join, "TILE", 4096 if limit == 32 else 7)
    got = ngram_join.components(docs, k, num, 100).collect()
    assert len(got) == len(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_brute_force(corpus(), k, num, 100)
    if limit != 32:
        return
    assert ngram_join.op7(empty).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in components_by_brute_force(corpus(), 5, 80, 100).values()})


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 150, 400]:
        for _ in range(20):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)])
            a = np.unique(a)
            if len(b) and ngram_join.links(a, b, 85, 100) and ngram_join.set_id(a) != ngram_join.set_id(b):
                bits = np.zeros(1 << (ngram_join.COLD_BITS - 3), np.uint8)
                bits[rng.integers(0, len(bits), len(bits) // 4)] = 255
                x, y = (ngram_join.prefix(s, ngram_join.Cold(bits), 85, 100)[0].tolist() for s in (a, b))
                both = [(i, y.index(v)) for i, v in enumerate(x) if v in y]
                assert both and ngram_join.reachable(len(a), both[0][0], len(b), both[0][1], 85, 100)
                assert min(both, key=lambda p: p[1]) == both[0]
                assert ngram_join.may_link(len(a), len(b), ngram_join.bitmap(a), ngram_join.bitmap(b), 85, 100)


def test_nearest_neighbours(spark, small):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[40:90] = x[3]  # many copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(450, None, 1), (500, [0.0] * 16, 1), (550, [None] * 16, 1), (600, [float("nan")] * 16, 1), (650, [float("inf")] + [1.0] * 15, 1), (700, [1.0], 1)]
    rows += [rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.op8(table).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = x.astype(float)
    want = {}
    for q in range(0, 400, 50):
        s = ann.cosine(np.broadcast_to(good[q], good.shape), good)
        want[q] = [(int(j), float(s[j])) for j in np.lexsort((np.arange(400), -s)) if j != q][:5]
    assert by == want
    assert ann.op8(table.limit(0)).count() == 0
    # The forest alone, made to look at a share of the rows, still finds most.
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in ann.search(e, "vec_id % 50 = 0", 5, want=10**9).collect()}
    few = {(r.query_id, r.vec_id) for r in ann.search(e, "vec_id % 50 = 0", 5, want=500 * 4).collect()}
    assert len(exact) == 50 and len(few & exact) >= 45


def test_toxicity(spark, docs, empty, small):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.op9(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.op9(docs, labels.limit(0)).count() == len(corpus())
    assert toxicity.op9(empty, labels).count() == 0
    big = "/root/testdata/sf0.01"
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = [r for r in toxicity.op9(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")).collect() if r.held_out and r.doc_id in lab]
    assert sum(r.predicted == lab[r.doc_id] for r in got) >= 0.9 * len(got)


def test_machine_learns_a_pair():
    """Label 1 needs both of two terms; each alone is clean."""
    rng = random.Random(0)
    rows = []
    for _ in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append((set([1] * a + [2] * b + rng.sample(range(10, 60), 5)), int(a and b)))
    m = toxicity.fit(rows)
    s = m.scores([{1}, {2}, {1, 2}, set()])
    assert s[2] > 0.8 and max(s[0], s[1], s[3]) < 0.3


def test_language_id(spark, docs, empty):
    got = language_id.op10(docs).collect()
    assert len(got) == len(corpus())
    text = {r[0]: r[1] for r in corpus()}
    assert all((r.lang_pred == "und") == (not language_id.words(text[r.doc_id])) for r in got)
    assert language_id.op10(empty).count() == 0
    assert {r.lang_pred for r in language_id.op10(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang is null")).collect()} == {"und"}
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [r for r in language_id.op10(d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline(spark, small):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        now = {r.doc_id for r in docs.collect()}
        assert now <= before
        before = now
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == before
