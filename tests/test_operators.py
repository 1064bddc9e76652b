"""Operators against plain versions where SQL has no say."""

import base64
import os

import pytest
from pyspark.sql import functions as F

from marlspike.functions import filters, text, tokens
from marlspike.operators import graph
from marlspike.sources.store import Store

KEY = "relation string, s_domain string, s_type string, s_name string, o_domain string, o_type string, o_name string, layer string, asserting_file string, argc int, spread boolean"


def edges(spark, pairs):
    return spark.createDataFrame([("Injects", "d", "T", a, "d", "T", b, "l", "f", None, None) for a, b in pairs], KEY)


def test_witness_is_the_same_beyond_the_limit(spark):
    df = edges(spark, [("a", "z"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("c", "q"), ("q", "b")])
    want = [("Injects", ("d", "T", a), ("d", "T", b)) for a, b in (("b", "c"), ("c", "d"), ("d", "b"))]
    assert graph.cycle_witness(df) == graph.cycle_witness(df, limit=0) == want
    assert graph.cycle_witness(edges(spark, [("a", "b"), ("b", "c")])) == []


def test_file_cycles(spark):
    df = spark.createDataFrame([("f", "a", "b"), ("f", "b", "a"), ("f", "b", "c"), ("f", "c", "c"), ("g", "a", "b")], "file_id string, from_id string, to_id string")
    assert sorted(map(tuple, graph.file_cycles(df).collect())) == [("f", "a,b"), ("f", "c")]


def test_trace(spark):
    df = spark.createDataFrame([("m.a", "m.b", "Calls"), ("m.b", "m.c", "Calls"), ("m.c", "m.d", "Calls"), ("m.d", "m.e", "Calls"), ("m.z", "m.a", "Calls")], "from_id string, to_id string, label string")
    names = lambda x: sorted((r.from_id, r.to_id) for r in x.collect())
    assert names(graph.trace(df, "m.a", "c")) == [("m.b", "m.c"), ("m.c", "m.d")]
    assert names(graph.trace(df, "m.a", "m.z")) == [("m.z", "m.a")]
    assert len(names(graph.trace(df, "m.a", ""))) == 4
    assert names(graph.trace(df, "m.a", "m.a")) == []
    assert names(graph.trace(df, "m.a", "e")) == []


def test_rows_that_are_no_edges_are_nodes(spark):
    df = spark.createDataFrame([("f", "p.py", "Function", 3)], "`n.name` string, `n.file_path` string, `n.label` string, degree int")
    assert graph.rows_to_edges(df).columns == ["id", "name", "file", "label", "properties"]
    r = graph.rows_to_edges(df).head()
    assert (r.id, r.file, r.label) == ("f", "p.py", "Function")


@pytest.mark.parametrize("most", range(3, 14))
def test_bounded_cuts_between_characters(spark, most):
    s = "aé東😀bcd"
    got = spark.createDataFrame([(s,)], "s string").select(text.bounded(F.col("s"), most).alias("x")).head().x
    cut = s.encode()[:most].decode(errors="ignore")
    assert got == (s if len(s.encode()) <= most else cut + "…[truncated]")


def test_token_counts(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a b c", "", None, "東京 internationalisation  x\n\n", "word " * 500]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.counter(spark, path)("t").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(bpe.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_rules_of_a_folder(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[filters.x]\nhead_lines = 1\n[filters.y]\nhead_lines = 2\n')
    (tmp_path / "b.toml").write_text('[filters.x]\nhead_lines = 3\n')
    (tmp_path / "note.txt").write_text("no rules")
    assert [(r.name, r.head) for r in filters.load_directory(str(tmp_path))] == [("x", 3), ("y", 2)]


def test_store_without_a_table(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/none")
    assert store.read() is None and store.load_latest() is None
    os.makedirs(f"{tmp_path}/broken")
    with pytest.raises(Exception):
        Store(spark, f"file://{tmp_path}/broken").read()


def test_paths_of_many_kinds_meet_each_reference_once(spark):
    refs = [(i, ["a.T", "T"], 0) for i in range(200)]
    # Ids 500 and 501 stand twice; a null kind decides but names nothing; 505 has no candidate of its arity.
    refs += [(500, ["b.T"], 0), (500, ["c.T"], 0), (501, ["c.T"], 0), (501, ["c.T"], 1), (502, ["n.T", "c.T"], 0), (503, ["m.T"], 0), (504, [None, "c.T"], 0), (505, ["c.T"], 9), (506, [], 0), (507, ["x", "c.T"], None)]
    refs = spark.createDataFrame(refs, "ref_id long, candidates array<string>, arity int")
    declared = [("a.T", 0, f"k{i}") for i in range(300)] + [("b.T", 0, "B"), ("b.T", 0, "B"), ("c.T", 0, "C"), ("c.T", 1, "D"), ("n.T", 0, None), ("m.T", 0, None), ("m.T", 0, "M"), ("T", 0, "Class")]
    got = graph.resolve_paths(refs, spark.createDataFrame(declared, "path string, arity int, kind string"))
    assert sorted(map(tuple, got.collect())) == [(500, "b.T", "B"), (500, "c.T", "C"), (503, "m.T", "M"), (504, "c.T", "C")]

    def rows_joined(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        name = plan.nodeName()
        below += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return own + sum(map(rows_joined, below))

    assert 0 < rows_joined(got._jdf.queryExecution().executedPlan()) <= 500
