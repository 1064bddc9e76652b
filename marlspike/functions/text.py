"""Scalar text functions. All are native columns and fuse into the scan's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(s: Column) -> Column:
    """Lines without their ends; a final empty line isn't one."""
    each = F.split(s, "\r?\n")
    return F.when(F.element_at(each, -1) == "", F.slice(each, 1, F.size(each) - 1)).otherwise(each)


def strip_ansi(s: Column) -> Column:
    return F.regexp_replace(s, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def replace_in_lines(s: Column, pattern: str, replacement: str) -> Column:
    return F.array_join(F.transform(lines(s), lambda x: F.regexp_replace(x, pattern, replacement)), "\n")


def words(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))


def tokens_by_words(s: Column) -> Column:
    """0 if blank, else 1.3 a word rounded down, 1 at least."""
    n = words(s)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.floor(n * F.lit(1.3)), F.lit(1))).cast("long")


def tokens_by_bytes(s: Column) -> Column:
    return (F.floor(F.octet_length(s) / 4) + 1).cast("long")


def tokens_by_bytes_up(s: Column) -> Column:
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def tokens_by_bytes_down(s: Column) -> Column:
    return F.floor(F.octet_length(s) / 4).cast("long")


def squeeze(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def compact_expression(s: Column, fidelity: Column) -> Column:
    """Low: the first identifier of the first line; Medium: what is before a brace; High: the first line; others unchanged."""
    first = F.trim(F.element_at(F.split(s, "\r?\n"), 1))
    ident = F.regexp_extract(first, "[A-Za-z0-9_]+", 0)
    return (
        F.when(fidelity == "Low", F.when(ident == "", first).otherwise(ident)).when(fidelity == "Medium", F.trim(F.regexp_extract(first, r"^[^{]*", 0)))
        .when(fidelity == "High", first).otherwise(s)
    )


def is_json(s: Column) -> Column:
    """Brackets at the trimmed ends and parseable between."""
    t = F.trim(s)
    shaped = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.coalesce(shaped & F.try_parse_json(t).isNotNull(), F.lit(False))


def trim_symbol(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\[\](){}<>.,;:!?\"'`]+|[\[\](){}<>.,;:!?\"'`]+$", "")


def encode_identifiers(s: Column, codes: dict[str, str]) -> Column:
    """Whole identifiers that have a code are replaced by it, in one pass over the text's parts."""
    if not codes:
        return s
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    parts = F.regexp_extract_all(s, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(m, p), p)), "")


def field_key(s: Column) -> Column:
    return F.trim(F.regexp_extract(s, "^[^:?=;]*", 0))


def method_key(s: Column) -> Column:
    return F.regexp_extract(s, r"([A-Za-z0-9_$]+)\s*(?:<[^>]*>)?\s*\(", 1)


def duration(secs: Column) -> Column:
    h, m, s = F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60
    t = lambda x: x.cast("long").cast("string")
    return F.when(h > 0, F.concat(t(h), F.lit("h "), t(m), F.lit("m "), t(s), F.lit("s"))).when(m > 0, F.concat(t(m), F.lit("m "), t(s), F.lit("s"))).otherwise(F.concat(t(s), F.lit("s")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def slug(s: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(x == "", "default").otherwise(x)


def has_type(s: Column, name: str) -> Column:
    return F.array_contains(F.split(s, "[^A-Za-z0-9_$]"), name)


def glob(s: Column, pattern: str) -> Column:
    """``*`` and ``?`` over the whole string."""
    special = r"\.[]{}()+^$|"
    return s.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$")


def path_matches(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def name_search(s: Column, q: str) -> Column:
    """A query with regular-expression characters is one; any other is looked for anywhere."""
    return s.rlike(q) if any(c in q for c in r".*+?[](){}|^$\\") else s.contains(q)


def ref_is_valid(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9][A-Za-z0-9._/~-]*$")


def path_is_safe(s: Column) -> Column:
    return (s != "") & ~s.startswith("/") & ~s.startswith("-") & ~s.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(s, "[/\\\\]"), "..")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


# Line starts that count as imports, functions, types and test markers.
IMPORTS = ["use ", "extern crate ", "import ", "from ", "using "]
FUNCTIONS = ["fn ", "pub fn ", "async fn ", "pub async fn ", "function ", "export function ", "async function "]
TYPED_FUNCTIONS = ["void ", "Task ", "int ", "string ", "bool ", "async "]
TYPES = ["struct ", "pub struct ", "enum ", "pub enum ", "trait ", "pub trait ", "impl<", "interface ", "export interface ", "type ", "export type ", "class ", "export class ", "public class ", "public struct ", "public interface ", "public enum "]
TESTS = ["#[test]", "#[cfg(test)]", "@Test", "describe(", "it("]


def _starts(x: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | x.startswith(s)
    return out


def count_lines(s: Column, test) -> Column:
    return F.size(F.filter(lines(s), lambda x: test(F.trim(x))))


def count_imports(s: Column) -> Column:
    return count_lines(s, lambda x: _starts(x, IMPORTS))


def count_functions(s: Column) -> Column:
    return count_lines(s, lambda x: _starts(x, FUNCTIONS) | (_starts(x, TYPED_FUNCTIONS) & x.contains("(") & x.contains(")")))


def count_types(s: Column) -> Column:
    return count_lines(s, lambda x: _starts(x, TYPES) | (x.startswith("impl ") & x.contains(" for ")))


def count_tests(s: Column) -> Column:
    return count_lines(s, lambda x: _starts(x, TESTS))


def is_test_path(p: Column) -> Column:
    x = F.lower(p)
    return x.contains("/test/") | x.contains("/tests/") | x.contains("/__tests__/") | x.contains(".test.") | x.contains(".spec.")


def is_config_path(p: Column) -> Column:
    x = F.lower(p)
    return F.arrays_overlap(F.split(x, "/"), F.array(*map(F.lit, ("config", "settings", "configs")))) | extension(p).isin("json", "toml", "yaml", "yml", "env")


def is_implementation_path(p: Column) -> Column:
    return F.lower(p).rlike(r"\.(component|controller|handler|middleware|service|repository|guard|interceptor|resolver|pipe)\.")


def is_template_path(p: Column) -> Column:
    return F.lower(p).endswith(".component.html")


def to_eol(s: Column, crlf: Column) -> Column:
    """All line ends as CRLF where ``crlf``, else as LF."""
    lf = F.replace(s, F.lit("\r\n"), F.lit("\n"))
    return F.when(crlf, F.replace(lf, F.lit("\n"), F.lit("\r\n"))).otherwise(lf)


def bounded(s: Column, most: int) -> Column:
    """``s``, or its first ``most`` bytes or so, cut between characters, and a note."""
    raw = F.encode(s, "UTF-8")
    inside = lambda i: F.hex(F.substring(raw, i + 1, 1)).rlike("^[89AB]")
    cut = F.lit(most - 3)
    for i in range(most - 2, most + 1):
        cut = F.when(~inside(i), i).otherwise(cut)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit("…[truncated]")))


def class_summary(fields: Column, methods: Column) -> Column:
    part = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}")))
    return F.concat_ws(", ", part(fields, "fields"), part(methods, "methods"))
