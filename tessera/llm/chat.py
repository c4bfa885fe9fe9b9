"""Tool-call linking: calls meet results by identifier, in a topological order, checked, as JSON.

- :func:`inline_calls` reads calls (``<tool_call>{...}</tool_call>``) and results (messages of role
  ``tool`` holding ``{"tool_call_id": ..., "content": ...}``) from the texts of messages;
  :func:`turn_calls` takes each user turn as a call and the turn after it as its result.
- :func:`link` joins calls and results on (scope, call_id), a shuffled equi-join.
- :func:`validate` checks arguments against schemas (``type``, ``required``, ``properties``, ``enum``,
  ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``additionalProperties``).
- :func:`ordered` orders the calls of a scope topologically: a call's level is the longest path of
  dependencies below it, found by pointer doubling along chains.
- :func:`canonical` writes each call as JSON with sorted keys and no white space.

No step gathers a conversation into one row or task: rows stay one per call, so a conversation
may hold any share of them.

Defined results: messages with null scope, turn or role make no call; a null text counts as empty;
of calls with one identifier the first (least turn, sequence, arguments) stands, and of results
likewise, with their number; calls without result have a null result; results without call are
dropped; unknown dependencies are listed as errors; calls on a cycle have a null level and an error;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

CALL = "scope string, call_id string, turn long, seq int, name string, arguments string, depends_on array<string>"
RESULT = "scope string, call_id string, turn long, seq int, content string"

#: The tool that a user turn stands for.
ASK = {"ask": {"type": "object", "required": ["text", "words"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 100_000}, "words": {"type": "integer", "minimum": 1, "maximum": 100}}}}


def _messages(df: DataFrame) -> DataFrame:
    return df.select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).filter("scope IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")


def turn_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn as a call of ``ask`` that depends on the call two turns before, each turn
    of another role as the result of the call one turn before."""
    m = _messages(conversations)
    at = F.concat_ws("-", "scope", F.col("turn").cast("string"))
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")).cast("long")
    before = F.concat_ws("-", "scope", (F.col("turn") - 2).cast("string"))
    calls = m.filter("role = 'user'").select(
        "scope", at.alias("call_id"), "turn", F.lit(0).alias("seq"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("text"), words.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(before)).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = m.filter("role <> 'user'").select("scope", F.concat_ws("-", "scope", (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.lit(0).alias("seq"), F.col("text").alias("content"))
    return calls, results


def inline_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written into the texts of messages."""
    m = _messages(conversations)
    bodies = m.select("scope", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))).alias("seq", "body"))
    calls = bodies.select(
        "scope", F.get_json_object("body", "$.id").alias("call_id"), "turn", "seq", F.get_json_object("body", "$.name").alias("name"),
        F.coalesce(F.get_json_object("body", "$.arguments"), F.lit("{}")).alias("arguments"),
        F.coalesce(F.from_json(F.get_json_object("body", "$.depends_on"), "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    ).filter("call_id IS NOT NULL")
    results = m.filter("role = 'tool'").select("scope", F.get_json_object("text", "$.tool_call_id").alias("call_id"), "turn", F.lit(0).alias("seq"), F.get_json_object("text", "$.content").alias("content")).filter("call_id IS NOT NULL")
    return calls, results


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per identifier with its first call, first result and number of results."""
    first = calls.groupBy("scope", "call_id").agg(F.min(F.struct("turn", "seq", "arguments", "name", "depends_on")).alias("c"))
    answer = results.groupBy("scope", "call_id").agg(F.min(F.struct("turn", "seq", "content")).alias("r"), F.count("*").alias("n_results"))
    joined = first.join(answer, ["scope", "call_id"], "left")
    return joined.select("scope", "call_id", "c.turn", "c.seq", "c.name", "c.arguments", "c.depends_on", F.col("r.content").alias("result"), F.coalesce("n_results", F.lit(0)).alias("n_results"))


_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def validate(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Any]]) -> Column:
    """Array of errors of a call's arguments against the schema of its tool; empty: valid."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    checks: list[tuple[Column, str]] = []
    for tool, schema in schemas.items():
        own = name == tool
        properties = schema.get("properties", {})
        for p in schema.get("required", []):
            checks.append((own & ~F.array_contains(keys, p), f"{p}: missing"))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(p) for p in properties]).cast("array<string>")
            checks.append((own & (F.size(F.array_except(keys, known)) > 0), "unknown argument"))
        for p, rule in properties.items():
            there = own & F.array_contains(keys, p)
            part = F.try_variant_get(value, f"$['{p}']", "variant")
            text = F.try_variant_get(value, f"$['{p}']", "string")
            number = F.try_variant_get(value, f"$['{p}']", "double")
            if "type" in rule:
                kind = F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)
                checks.append((there & ~F.coalesce(kind.isin(_TYPES[rule["type"]]), F.lit(False)), f"{p}: not {rule['type']}"))
            if "enum" in rule:
                checks.append((there & ~F.coalesce(text.isin([str(v) for v in rule["enum"]]), F.lit(False)), f"{p}: not allowed"))
            for bound, bad in (("minimum", lambda b, n=number: n < b), ("maximum", lambda b, n=number: n > b), ("minLength", lambda b, t=text: F.length(t) < b), ("maxLength", lambda b, t=text: F.length(t) > b)):
                if bound in rule:
                    checks.append((there & bad(rule[bound]), f"{p}: {bound}"))
    unknown = ~F.coalesce(name.isin(list(schemas)), F.lit(False))
    listed = [F.when(unknown, F.lit("unknown tool")), F.when(~unknown & keys.isNull(), F.lit("not an object"))]
    listed += [F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for bad, said in checks]
    return F.array_compact(F.array(*listed))


def ordered(calls: DataFrame) -> DataFrame:
    """Add ``level``, the longest path of known dependencies below a call (calls follow in order of
    level, turn, seq; null: on a cycle or behind one), and ``missing``, the dependencies without a call.

    Calls with a single known dependency form chains; each doubles its way down its chain, so a chain
    of n calls takes log n rounds. Calls with several are then placed round by round, one round for
    each of *them* on a path, each taking the deepest of what it needs.
    """
    edges = calls.select("scope", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = calls.select("scope", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    found = edges.join(known, ["scope", "needs"], "left")
    missing = found.filter("there IS NULL").groupBy("scope", "call_id").agg(F.array_sort(F.collect_list("needs")).alias("missing"))
    needs = stored(found.filter("there").select("scope", "call_id", "needs"), "chat-needs")
    counted = needs.groupBy("scope", "call_id").agg(F.count("*").alias("n_needs"), F.min("needs").alias("down"))
    nodes = calls.select("scope", "call_id").join(counted, ["scope", "call_id"], "left")
    # A call points ``dist`` steps down its chain to ``down``; calls without or with several needs end chains.
    single = F.col("n_needs") == 1
    chains = stored(nodes.select("scope", "call_id", F.when(single, F.col("down")).otherwise(F.col("call_id")).alias("down"), F.when(single, 1).otherwise(0).alias("dist"), F.coalesce("n_needs", F.lit(0)).alias("n_needs")), "chat-chains0")
    turn, steps = 0, 1
    longest = chains.count()
    while steps <= longest:
        on = chains.select("scope", F.col("call_id").alias("down"), F.col("down").alias("further"), F.col("dist").alias("more"))
        turn, steps = turn + 1, steps * 2
        fresh = stored(chains.join(on, ["scope", "down"]).select("scope", "call_id", F.col("further").alias("down"), (F.col("dist") + F.col("more")).alias("dist"), "n_needs", (F.col("more") > 0).alias("moved")), f"chat-chains{turn}")
        chains = fresh.drop("moved")
        if fresh.filter("moved").isEmpty():
            break
    # Chains that have not ended by now run in circles: what they point to is no end.
    ends = chains.filter("dist = 0").select("scope", F.col("call_id").alias("down"), F.col("n_needs").alias("end_needs"))
    chains = stored(chains.join(ends, ["scope", "down"]), "chat-ended")
    free = chains.filter("end_needs = 0").select("scope", "call_id", F.col("dist").alias("level"))
    levels, left = free, chains.filter("end_needs > 1")
    if not left.isEmpty():
        levels = free.unionByName(_joints(needs, chains, free))
    base = calls.join(missing, ["scope", "call_id"], "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return base.join(levels, ["scope", "call_id"], "left")


def _joints(needs: DataFrame, chains: DataFrame, free: DataFrame) -> DataFrame:
    """Levels of the calls with several dependencies and of those whose chains end in one."""
    joints = chains.filter("n_needs > 1").select("scope", "call_id")
    below = needs.join(joints, ["scope", "call_id"]).join(chains.select("scope", F.col("call_id").alias("needs"), F.col("down").alias("end"), "dist", "end_needs"), ["scope", "needs"], "left")
    # end: the joint that a dependency's chain ends in (null: a dependency on a cycle); none: level known.
    open_rows = stored(below.select("scope", "call_id", "end", (F.col("dist") + 1).alias("plus"), F.coalesce(F.col("end_needs") == 0, F.lit(False)).alias("known")), "chat-joints0")
    placed: list[DataFrame] = []
    while True:
        ready = open_rows.groupBy("scope", "call_id").agg(F.bool_and("known").alias("known"), F.max("plus").alias("level")).filter("known").drop("known")
        ready = stored(ready, f"chat-placed{len(placed)}")
        if ready.isEmpty():
            break  # what is left stands on cycles or behind them
        placed.append(ready)
        rest = open_rows.join(ready.select("scope", "call_id"), ["scope", "call_id"], "left_anti")
        rest = rest.join(ready.select("scope", F.col("call_id").alias("end"), F.col("level").alias("below")), ["scope", "end"], "left")
        met = F.col("below").isNotNull() & ~F.col("known")
        open_rows = stored(rest.select("scope", "call_id", "end", F.when(met, F.col("plus") + F.col("below")).otherwise(F.col("plus")).alias("plus"), (F.col("known") | met).alias("known")), f"chat-joints{len(placed)}")
    made = placed[0] if placed else free.limit(0)
    for more in placed[1:]:
        made = made.unionByName(more)
    tails = chains.filter("dist > 0 AND end_needs > 1").select("scope", "call_id", F.col("down").alias("end"), "dist")
    follow = tails.join(made.select("scope", F.col("call_id").alias("end"), F.col("level").alias("below")), ["scope", "end"])
    return made.select("scope", "call_id", F.col("level").cast("int")).unionByName(follow.select("scope", "call_id", (F.col("dist") + F.col("below")).cast("int").alias("level")))


def canonical(c: DataFrame) -> Column:
    """A linked, validated and ordered call as JSON with sorted keys; so are its arguments, as a text in it."""
    return F.to_json(F.struct(F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments")).alias("arguments"), F.col("depends_on"), F.col("errors"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("result")), {"ignoreNullFields": "false"})


def format_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """scope, call_id, turn, seq, level, n_results, valid and canonical JSON, one row per call."""
    rows = ordered(link(calls, results))
    late = F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(validate(F.col("name"), F.col("arguments"), schemas), F.transform("missing", lambda m: F.concat(F.lit("missing call: "), m)), late)
    rows = rows.withColumn("errors", errors)
    return rows.select("scope", "call_id", "turn", "seq", "level", "n_results", (F.size("errors") == 0).alias("valid"), canonical(rows).alias("json"))
