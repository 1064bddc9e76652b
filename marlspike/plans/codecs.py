"""Queries over compact text, style sheets, aliases, edit batches and printed differences; see ``queries`` for how they are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, markup
from ..operators import edit
from ..sources.derived import table
from .registry import query

_CAPTURES = ("throw.root", "for.root", "if.root", "while.root", "return.root", "class.root")


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _sql_pick(values, c):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + {c} % {len(values)}]"


query("g30_control_markers", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '⊕!' || p_name WHEN 1 THEN '⊕loop' WHEN 2 THEN '⊕guard' WHEN 3 THEN '⊕loop' WHEN 4 THEN '⊕⇒' || p_name END AS marker FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", codec.control_marker(_pick(_CAPTURES, F.col("p_partkey")), F.col("p_name")).alias("marker")))
query("g30_expand", "SELECT p_partkey, 'a' || ['', '→ ', 'throws: '][1 + p_size % 3] || p_name || '⊕x' AS line FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", codec.expand_markers(F.concat(F.lit("a"), _pick(("⊕loop⊕guard", "⊕⇒", "⊕!"), F.col("p_size")), "p_name", F.lit("⊕x"))).alias("line")))
query("g25_micro_opcodes", "SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN replace(regexp_replace(html, '[{}]', '§C', 'g'), '$ctor', '§P') || '§I§L§E' ELSE html || '⊕guard⊕loop⊕⇒' END) AS h FROM pages WHERE html IS NOT NULL")(
    lambda s, d: table(s, d, "pages").filter("html is not null").select("page_id", F.sha2(codec.micro_opcodes(F.concat("html", F.lit("⊕guard⊕loop⊕⇒")), _pick(("Low", "High"), F.col("page_id"))), 256).alias("h")))
_PCT = "CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '72.6' WHEN 2 THEN '100' ELSE '12.5' END"


def _pct():
    return F.element_at(F.array(F.lit(0.0), F.lit(72.62), F.lit(100.0), F.lit(12.5)), (F.col("event_id") % 4 + 1).cast("int"))


def _header(s, d):
    return table(s, d, "events").withColumn("h", codec.compact_header(F.col("event_id"), F.col("user_id"), _pct(), F.lit(3), F.lit(12), F.lit(5)))


query("g31_header", f"SELECT event_id, '§' || event_id || ':' || user_id || ':' || {_PCT} || '|L|3:12:5§' AS h FROM events")(lambda s, d: _header(s, d).select("event_id", "h"))
query("g31_parse_header", f"SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id END AS raw, CASE WHEN event_id % 5 > 0 THEN user_id END AS compressed, CASE WHEN event_id % 5 > 0 THEN CAST({_PCT} AS DOUBLE) END AS pct, CASE WHEN event_id % 5 > 0 THEN 12::BIGINT END AS methods FROM events")(
    lambda s, d: _header(s, d).select("event_id", codec.parse_header(F.when(F.col("event_id") % 5 == 0, F.concat("h", F.lit("|"))).otherwise(F.concat(F.lit(" "), "h"))).alias("p")).select("event_id", "p.raw", "p.compressed", "p.pct", "p.methods"))
query("g31_cache_hit", f"SELECT event_id, '§' || event_id || ':' || user_id || ':' || {_PCT} || '|C|α' || (event_id % 7) || '§' || chr(10) || '// [CACHE_HIT] α' || (event_id % 7) || ' unchanged. Use historic memory.' || chr(10) AS h FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", codec.cache_hit(F.col("event_id"), F.col("user_id"), _pct(), F.concat(F.lit("α"), (F.col("event_id") % 7).cast("string"))).alias("h")))


def _symbols(s, d):
    pair = F.struct(F.when(F.col("l_linenumber") == 1, "$e").otherwise(F.concat(F.lit("$"), F.col("l_linenumber").cast("string"))).alias("alias"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("value"))
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", pair.alias("p")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))).alias("a"))
    return x.withColumn("p", F.transform("a", lambda r: r["p"]))


query("g22_symbol_footer", """SELECT l_orderkey, CASE WHEN o_custkey IS NULL OR n = 0 THEN '' ELSE '§SYM' || chr(10) || body END AS footer FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 3 > 0 THEN 1 END AS o_custkey, count(*) FILTER (l_linenumber > 1) AS n,
 string_agg('  $' || l_linenumber || ' = t' || l_partkey || chr(10), '' ORDER BY l_linenumber, 't' || l_partkey) FILTER (l_linenumber > 1) AS body FROM lineitem GROUP BY l_orderkey)""")(
    lambda s, d: _symbols(s, d).select("l_orderkey", codec.symbol_footer(F.when(F.col("l_orderkey") % 3 == 0, F.concat("p", F.array_repeat(F.element_at("p", 1), 33))).otherwise(F.col("p")), F.array(F.lit("$e"))).alias("footer")))
query("g24_path_footer", "SELECT l_orderkey, '§PATHMAP' || chr(10) || string_agg('  ' || CASE WHEN l_linenumber = 1 THEN '$e' ELSE '$' || l_linenumber END || ' = t' || l_partkey || chr(10), '' ORDER BY l_linenumber, 't' || l_partkey) AS footer FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: _symbols(s, d).select("l_orderkey", codec.footer("PATHMAP", F.col("p")).alias("footer")))
query("g23_path_aliases", "SELECT 'α' || row_number() OVER (ORDER BY min(l_orderkey), 'p' || l_partkey) AS alias, 'p' || l_partkey AS path FROM lineitem GROUP BY l_partkey")(
    lambda s, d: edit.aliases(table(s, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("f"), "l_orderkey"), "f", "l_orderkey"))
query("g23_aliases_after_known", "SELECT 'Φ' || (40 + n_nationkey) AS alias, n_name AS path FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'Φ' || (44 + row_number() OVER (ORDER BY n_nationkey, n_name)), n_name FROM nation WHERE n_nationkey >= 5")(
    lambda s, d: (lambda n: edit.aliases(n, "n_name", "n_nationkey", "Φ", n.filter("n_nationkey < 5").select(F.concat(F.lit("Φ"), (F.col("n_nationkey") + 40).cast("string")).alias("alias"), F.col("n_name").alias("path"))))(table(s, d, "nation")))

# --- languages and frameworks: a sign is put before each text

_SIGNS = ("namespace x", "impl x", "fn x struct y", "import java.x", "interface x class y private z", "interface x class y", "export interface x class y private z", "import {x} from y\nclass y private z public ", "@Override =>", "")
_GUESS = ("csharp", "rust", "rust", "java", "java", "typescript", "typescript", "typescript", "typescript", "typescript")
query("g35_language", f"SELECT p_partkey, {_sql_pick(_GUESS, 'p_partkey')} AS language FROM part WHERE NOT regexp_matches(p_name, '(namespace|using|public|private|impl|trait|fn|struct|enum|use|mod|package|import|interface|class|protected|extends|implements|export) ')")(
    lambda s, d: table(s, d, "part").filter("NOT p_name rlike '(namespace|using|public|private|impl|trait|fn|struct|enum|use|mod|package|import|interface|class|protected|extends|implements|export) '").select("p_partkey", codec.language_of(F.concat(_pick(_SIGNS, F.col("p_partkey")), F.lit("\n"), "p_name")).alias("language")))
_FRAME = ("@Injectable()", "@Input() x", "import '@angular/core'; @Input() x", "import '@angular/core'", "@Output x")
query("k26_angular", "SELECT p_partkey, p_partkey % 5 IN (0, 2) AS angular FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", markup.is_angular(F.concat(_pick(_FRAME, F.col("p_partkey")), F.lit(" "), "p_name")).alias("angular")))


def _css(s, d):
    n = F.col("p_partkey").cast("string")
    body = F.concat(F.lit(".b-"), n, F.lit(" .a { $v"), n, F.lit(": 'it\\'s .no'; --w: \".no\\\"$no\"; } /* .no $no @use */ @media x { @include y; @mixin z; @include q } // .no\n.a{c:1.5em; margin: -- ;}"))
    return table(s, d, "part").select("p_partkey", markup.style_shape(F.when(F.col("p_partkey") % 9 == 0, "x { y: 1 }").otherwise(body)).alias("x"))


query("k18_style_shape", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '.a .b-' || p_partkey END AS classes, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '$v' || p_partkey || ' --w' END AS variables, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '@include @mixin' END AS rules FROM part")(
    lambda s, d: _css(s, d).select("p_partkey", F.array_join("x.classes", " ").alias("classes"), F.array_join("x.variables", " ").alias("variables"), F.array_join("x.at_rules", " ").alias("rules")))
query("k18_style_line", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Φsty:empty' ELSE 'Φsty:.a,.b-' || p_partkey || ' $$v' || p_partkey || ',--w @@include,@mixin' END AS line FROM part")(lambda s, d: _css(s, d).select("p_partkey", markup.style_line(F.col("x")).alias("line")))

# --- edits and printed differences

_OPS = "CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 50 ELSE l_suppkey % 50 END"


def _ops(s, d):
    start = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 50).otherwise(F.col("l_suppkey") % 50)
    lf, crlf = F.lit("a\nb"), F.lit("a\r\nb")
    op = F.struct("l_linenumber", "l_partkey", start.alias("start"), (start + F.col("l_linenumber") % 4).alias("stop"), F.lit("").alias("put"), crlf.alias("actual"), F.when(F.col("l_partkey") % 40 == 0, "c").when(F.col("l_partkey") % 2 == 0, lf).alias("expected"))
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(op)).alias("o"))
    return x.select("l_orderkey", edit.edit_error(F.when(F.col("l_orderkey") % 11 == 0, F.flatten(F.array_repeat("o", 65))).otherwise(F.col("o"))).alias("error"))


query("j12_edit_batch", f"""WITH x AS (SELECT l_orderkey, l_partkey, {_OPS} AS a, {_OPS} + l_linenumber % 4 AS b, lead({_OPS}) OVER w AS c, lead({_OPS} + l_linenumber % 4) OVER w AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, {_OPS}))
 SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'too_many' WHEN bool_or(l_partkey % 40 = 0) THEN 'mismatch' WHEN bool_or(coalesce(CASE WHEN a < b AND c < e THEN c < b AND a < e WHEN a < b OR c < e THEN c > a AND c < b ELSE false END, false)) THEN 'overlap' END AS error FROM x GROUP BY 1""")(_ops)


def _printed(s, d):
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "modified").when(F.col("l_returnflag") == "A", "added").when(F.col("l_linestatus") == "O", "unchanged").otherwise("removed")
    x = table(s, d, "lineitem").select("l_orderkey", (n.cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("at"), F.when(n % 3 == 1, "class").when(n % 3 == 2, "method").otherwise("field").alias("target"), kind.alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("label"),
        F.col("l_linestatus").alias("detail"), F.when(F.col("l_suppkey") % 2 == 0, "old").alias("was"), F.when(F.col("l_suppkey") % 3 == 0, "body").when(F.col("l_suppkey") % 3 == 1, "markers").otherwise("").alias("reason"))
    return edit.printed(x, "at", F.col("l_orderkey") % 2 == 0, ["l_orderkey"]).select("l_orderkey", F.sha2("text", 256).alias("h"))


_LINE = """CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN k = '=' THEN '= p' || l_partkey || ' (unchanged)' ELSE k || ' p' || l_partkey || ' ' || l_linestatus END
 WHEN k = '~' AND l_linenumber % 3 = 2 AND l_suppkey % 3 < 2 THEN i || '~ p' || l_partkey || CASE l_suppkey % 3 WHEN 0 THEN ' (body changed)' ELSE ' (markers changed)' END
 WHEN k = '~' THEN i || '~ p' || l_partkey || ' ~ ' || l_linestatus || CASE WHEN l_suppkey % 2 = 0 THEN chr(10) || i || '    was: old' ELSE '' END WHEN k = '=' THEN i || '= ' || l_linestatus ELSE i || k || ' p' || l_partkey || ' ' || l_linestatus END || chr(10)"""
query("j9_printed_diff", f"""WITH x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN '~' WHEN l_returnflag = 'A' THEN '+' WHEN l_linestatus = 'O' THEN '=' ELSE '-' END AS k, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE '  ' END AS i FROM lineitem),
 y AS (SELECT *, {_LINE} AS line FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, line) AS r FROM y)
 SELECT l_orderkey, sha256(string_agg(CASE WHEN l_linenumber % 3 = 1 AND r > 1 AND i <> '' THEN chr(10) ELSE '' END || line, '' ORDER BY r)) AS h FROM z GROUP BY 1""")(_printed)
_BODY = '{"packages": [{"name": "p%d", "node_count": %d}, {"node_count": 3}, {"name": "q"}], "boundaries": [{"from": "a", "to": "b%d"}, {"from": "a"}]}'
query("d23_overview", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'p' || event_id || '=' || event_id || ' q=0' END AS modules, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'a>b' || event_id || ' calls' END AS dependencies FROM events")(
    lambda s, d: edit.overview(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "no json").otherwise(F.format_string(_BODY, "event_id", "event_id", "event_id")).alias("body")), "body").select(
        "event_id", F.array_join(F.transform("modules", lambda m: F.concat(m["name"], F.lit("="), m["file_count"].cast("string"))), " ").alias("modules"), F.array_join(F.transform("dependencies", lambda x: F.concat(x["from"], F.lit(">"), x["to"], F.lit(" "), x["kind"])), " ").alias("dependencies")))
_DEEP = '{"zeta": null, "name": " x%d ", "results": [1, "", 2.5, true], "data": {"id": %d}, "file": [1, 2, 3, 4], "kind": [], "own": {"b": 1, "a": "y"}}'
query("g17_short_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a b' || chr(10) || 'c' || event_id ELSE 'd:i:' || event_id || chr(10) || 'f:1' || chr(10) || '2' || chr(10) || '3' || chr(10) || '4' || chr(10) || 'nm:x' || event_id || chr(10) || 'own:a:y' || chr(10) || 'b:1' || chr(10) || 'r:1 2.5 true' END AS short FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", codec.short_json(F.when(F.col("event_id") % 4 == 0, F.format_string("a\t b\r\nc%d", "event_id")).otherwise(F.format_string(_DEEP, "event_id", "event_id"))).alias("short")))
