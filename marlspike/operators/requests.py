"""Transforms of requests (model, tools, system, messages as nested columns) on their way to a model, and what responses say."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scrub import scrubbed
from ..functions.text import is_json, strip_ansi

# Where the shell tool's description is cut, what is put there, and the counters of the cache.
TRIM_TOOL, TRIM_AT = "Bash", "Committing changes"
TRIM_NOTE = "…\n\n[Git commit/PR sections removed by proxy — set TRIM_BASH_GIT=0 to restore]"
CACHE_COUNTERS = ["total_injected", "tools_slots", "system_slots", "messages_slots", "tail_slots", "small_blocks_filtered", "client_breakpoints_stripped", "client_breakpoints_preserved", "cache_read_tokens", "cache_creation_tokens"]
TRANSFORM_COUNTERS = ["tools_dropped", "ansi_sequences_stripped", "bash_git_trims", "model_overrides", "secrets_scrubbed", "tool_filters_applied", "items_aged", "bytes_removed"]
OPENAI_STARTS = ["gpt-", "o1", "o3", "o4", "chatgpt-"]
SMALL_BLOCK = 500
#: Bytes up to which a whole JSON document passes where its cut would break it.
JSON_MOST = 50_000


def drop_tools(tools: Column, names: list[str]) -> Column:
    """An array of struct(name, description) without the tools of these names."""
    return F.filter(tools, lambda t: ~F.coalesce(t["name"], F.lit("")).isin(names)) if names else tools


def trim_tool(tools: Column) -> Column:
    """The first shell tool that has the section loses it and all after it."""
    hit = lambda t: (t["name"] == TRIM_TOOL) & F.coalesce(F.instr(t["description"], TRIM_AT) > 0, F.lit(False))
    first = F.array_position(F.transform(tools, hit), F.lit(True))
    cut = lambda t: F.concat(F.substring(t["description"], F.lit(1), F.instr(t["description"], TRIM_AT) - 1), F.lit(TRIM_NOTE))
    return F.transform(tools, lambda t, i: F.when(i + 1 == first, t.withField("description", cut(t))).otherwise(t))


def override_model(model: Column, to: str) -> Column:
    return F.when(model.isNotNull(), F.lit(to))


def each_text(messages: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` on every text of messages (role, content: blocks of type, text, content, parts): block texts, and of tool results the string and the parts' texts."""

    def block(b: Column) -> Column:
        result = b["type"] == "tool_result"
        parts = F.transform(b["parts"], lambda p: p.withField("text", f(p["text"])))
        return b.withField("text", f(b["text"])).withField("content", F.when(result, f(b["content"])).otherwise(b["content"])).withField("parts", F.when(result, parts).otherwise(b["parts"]))

    return F.transform(messages, lambda m: m.withField("content", F.transform(m["content"], block)))


def scrub_messages(messages: Column) -> Column:
    return each_text(messages, scrubbed)


def strip_messages(messages: Column) -> Column:
    return each_text(messages, strip_ansi)


def pipeline(drop: list[str] = (), ansi: bool = False, trim: bool = False, model: str | None = None, scrub: bool = False, text_filter: Callable[[Column], Column] | None = None, age: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The stages that are switched on, always in this order, as one transform of requests (model, tools, messages)."""
    stages: list[Callable[[DataFrame], DataFrame]] = []
    put = lambda c, f: stages.append(lambda df: df.withColumn(c, f(F.col(c))))
    if drop:
        put("tools", lambda t: drop_tools(t, list(drop)))
    if ansi:
        put("messages", strip_messages)
    if trim:
        put("tools", trim_tool)
    if model is not None:
        put("model", lambda m: override_model(m, model))
    if scrub:
        put("messages", scrub_messages)
    if text_filter is not None:
        put("messages", lambda m: each_text(m, text_filter))
    if age is not None:
        stages.append(age)
    return lambda df: reduce(lambda d, f: f(d), stages, df)


def json_guard(original: Column, filtered: Column, truncated: Column, reduce_json: bool = False) -> Column:
    """struct(text, truncated): a cut through whole JSON gives the document itself, or a note where it is too long."""
    if reduce_json:
        return F.struct(filtered.alias("text"), truncated.alias("truncated"))
    whole = truncated & is_json(original)
    short = F.octet_length(original) <= JSON_MOST
    note = F.concat(F.lit("[JSON document omitted: "), F.octet_length(original).cast("string"), F.lit(" bytes]"))
    return F.struct(F.when(whole & short, original).when(whole, note).otherwise(filtered).alias("text"), (truncated & ~(whole & short)).alias("truncated"))


def marker(program: Column, before: Column, after: Column, percent: Column) -> Column:
    return F.format_string("§FILTERED %s: %d → %d lines (%.1f%% ↓)", program, before, after, percent)


def platform(model: Column) -> Column:
    """Which service's request form a model's name stands for."""
    open_ = F.lit(False)
    for start in OPENAI_STARTS:
        open_ = open_ | model.startswith(start)
    return F.when(F.contains(model, F.lit("claude")), "anthropic").when(open_, "openai").otherwise("generic")


def tool_result(platform_: str, block: Column) -> Column:
    """Whether a block (type, role) is a tool's result, in the form of a service."""
    return F.coalesce(block["type"] == "tool_result" if platform_ == "anthropic" else block["role"] == "tool", F.lit(False))


def cache_slots(requests: DataFrame, by: str) -> DataFrame:
    """Where each request's cache may end, of blocks (by, part: tools, system or messages; message from 0, pos, kind, size, marked).

    Four slots: the last tool, the last system block of over 500 bytes, the last cacheable block of the first message, and the
    last one of all. A request whose client set marks of its own keeps these and gets none.
    """
    at = F.struct("message", "pos")
    cacheable = (F.col("part") == "messages") & F.col("kind").isin("text", "tool_result", "image")
    g = requests.groupBy(by).agg(
        F.max("marked").alias("preserved"), F.max(F.when(F.col("part") == "tools", F.col("pos"))).alias("tool"),
        F.max(F.when((F.col("part") == "system") & (F.col("size") > SMALL_BLOCK), F.col("pos"))).alias("system"),
        F.max(F.when(cacheable & (F.col("message") == 0), F.col("pos"))).alias("first"), F.max(F.when(cacheable, at)).alias("tail"),
    )
    own = lambda c: F.when(~F.col("preserved"), c)
    return g.select(by, "preserved", own(F.col("tool")).alias("tool"), own(F.col("system")).alias("system"), own(F.col("first")).alias("first"), own(F.col("tail.message")).alias("tail_message"), own(F.col("tail.pos")).alias("tail_pos"))


def usage(body: Column) -> Column:
    """struct(read, creation) of a response: of its JSON, or of the first message_delta event of its stream; 0 where neither says."""
    fields = ("cache_read_input_tokens", "cache_creation_input_tokens")
    events = F.transform(F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    delta = F.get(F.filter(events, lambda x: F.coalesce(F.get_json_object(x, "$.type") == "message_delta", F.lit(False))), F.lit(0))
    source = F.when(is_json(body), body).otherwise(delta)
    return F.struct(*(F.coalesce(F.get_json_object(source, f"$.usage.{f}").cast("long"), F.lit(0)).alias(n) for f, n in zip(fields, ("read", "creation"), strict=True)))


def merged(stats: DataFrame, counters: list[str], by: list[str] = ()) -> DataFrame:
    """Sums of counters over requests."""
    return stats.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))
