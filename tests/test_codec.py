"""Odd values for compact text, style sheets, edit batches and aliases, against plain versions."""

import json

from pyspark.sql import functions as F

from marlspike.functions import codec, markup
from marlspike.operators import edit


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).head()[0]


def test_headers(spark):
    parse = lambda s: one(spark, codec.parse_header, s)
    assert tuple(parse("§245:67:72.6|L|3:12:5§")) == (245, 67, 72.6, 3, 12, 5)
    assert [parse(s) for s in (None, "", "§§", "§1:2|L|3:4:5§", "§1:2:3|L|3:4§", "1:2:3|L|3:4:5", "§1:2:3|L|3:4:5|α1§")] == [None] * 7
    assert [one(spark, codec.savings_text, x, "double") for x in (0.0, 100.0, 72.65, 99.94)] == ["0", "100", "72.7", "99.9"]


def test_short_json(spark):
    short = lambda s: one(spark, codec.short_json, s)
    assert short(None) is None and short("") == "" and short("{}") == "" and short("[]") == "" and short("null") == ""
    assert short("no\tjson {") == "nojson {"
    assert short(json.dumps({"name": "a", "results": [{"id": 1}, {"id": 2}]})) == "nm:a\nr:i:1 i:2"
    assert short(json.dumps([1, 2, 3, 4])) == "1\n2\n3\n4"
    assert short("[" * 50_000) == "[" * 50_000


def test_language(spark):
    guess = lambda s: one(spark, codec.language_of, s)
    assert guess(None) is None and guess("") == "typescript"
    assert guess("fn main() {}") == "typescript" and guess("pub(crate) fn x()") == "rust"
    assert guess("x => y\nimport java.util.List;") == "typescript" and guess("x => y -> z\nimport java.util.List;") == "java"


def test_style(spark):
    shape = lambda s: one(spark, markup.style_shape, s)
    assert tuple(shape(None)) == tuple(shape("")) == ([], [], [])
    assert tuple(shape(".a{} /* .b")) == ([".a"], [], []) and tuple(shape("x 'y .c")) == ([], [], [])
    assert tuple(shape(".z{} .a{} .z{} @use 'q'; @include m; @use x; --: 1; .5em")) == ([".a", ".z"], [], ["@use", "@include"])
    many = " ".join(f".c{i}" for i in range(10, 40))
    assert one(spark, lambda c: markup.style_line(markup.style_shape(c)), many) == "Φsty:" + ",".join(f".c{i}" for i in range(10, 18))


def test_edit_batch(spark):
    kind = "array<struct<start int, stop int, put string, actual string, expected string>>"
    error = lambda ops: one(spark, edit.edit_error, ops, kind)
    op = lambda a, b, there="x", want=None: (a, b, "", there, want)
    assert error([]) is None and error([op(0, 3, "a\r\nb", "a\nb")]) is None
    assert error([op(0, 3, None, "x")]) == "mismatch" and error([op(0, 3, "x", "y")]) == "mismatch"
    assert error([op(0, 3), op(2, 5)]) == "overlap" and error([op(0, 3), op(3, 5)]) is None
    # a point strictly inside the range before; not at its ends; and only neighbours in request order are looked at
    assert error([op(0, 3), op(1, 1)]) == "overlap" and error([op(0, 3), op(3, 3)]) is None and error([op(0, 3), op(9, 9), op(1, 2)]) is None
    assert error([op(i, i) for i in range(65)]) == "too_many" and error([op(i, i) for i in range(64)]) is None


def test_aliases(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1), ("b", 0), (None, 0), ("d", None)], "f string, at int")
    named = lambda known=None: {r.path: r.alias for r in edit.aliases(rows, "f", "at", known=known).collect()}
    got = named()
    assert got == {"d": "α1", "b": "α2", "c": "α3", "a": "α4"}
    known = spark.createDataFrame([("α7", "c"), ("α3", "gone")], "alias string, path string")
    assert named(known) == {"c": "α7", "gone": "α3", "d": "α8", "b": "α9", "a": "α10"}
    assert edit.aliases(rows.limit(0), "f", "at").count() == 0
    assert edit.aliases(rows, "f", "at", known=known.limit(0)).count() == 4


def test_overview(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[1]",), ('{"packages": null}',), ('{"packages": [{"name": "x"}]}',)], "body string")
    got = [(len(r.modules), len(r.dependencies)) for r in edit.overview(rows, "body").collect()]
    assert got == [(0, 0)] * 4 + [(1, 0)]
