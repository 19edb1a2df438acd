"""Chat formatting with linked tool calls, in DataFrame functions only.

``events`` has a row for each message, call or result: ``conv_id, turn, kind`` (``message``, ``call``, ``result``), ``role``,
``content``, ``call_id``, ``tool``, ``arguments`` (JSON text) and ``depends`` (identifiers of calls whose results it uses).
Calls and results are hash-joined by conversation and identifier, so a long conversation is never gathered.  Order
is topological: a result comes after its call, a call after the results it depends on.  ``after`` is the greatest turn among an event
and all it depends on, ``level`` the longest chain below it; ordering a conversation by ``after, level, turn`` keeps
the given order wherever the links allow it.  A call with a single need is a pointer, and pointers are doubled, so a chain takes as many rounds as
its length has binary digits; calls with several needs are resolved in rounds, one for each of them on the longest path.  What is not
resolved is on a cycle or behind one.

Arguments are parsed as JSON and held against the tool's schema.  ``json`` is canonical: keys sorted at every depth, no white space.

Defined cases: a null conversation is a conversation of its own; a call without identifier is ``unanswered``, a result without one
or without its call ``orphan``; of calls that share an identifier the least by turn, tool and arguments counts, those
that differ from it are ``duplicate``; identical rows are all kept and alike; several results of a call are all linked; unknown
identifiers in ``depends`` are ignored; arguments that are no JSON object (null, or with a key twice) are invalid and kept as text; null
content, identifiers and roles are written as ``null``; numbers are equal by value (``1.0`` is an integer), ``1``, ``"1"`` and ``true`` differ; a
call that depends on itself through others is ``cyclic`` with null level and its own turn; an empty table gives an empty
result; columns beyond those named are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch

#: JSON type -> pattern of the type that a parsed value reports.
TYPES = {"string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*", "boolean": r"BOOLEAN", "object": r"OBJECT.*", "array": r"ARRAY.*", "null": r"VOID"}
#: Keys of null values are written.
WRITTEN = {"ignoreNullFields": "false"}


def _at(path: str, name: str) -> str:
    return path + "['" + name.replace("'", "\\'") + "']"


def _checks(value: Column, spec: dict, path: str = "$", label: str = "") -> list[Column]:
    """Null or a problem, of the part of a parsed value at ``path`` under ``{"type", "enum", "minimum", "maximum", "properties", "required", "additional", "items"}``."""
    found, number = F.try_variant_get(value, path, "variant"), F.try_variant_get(value, path, "double")
    kind, there = F.schema_of_variant(found), found.isNotNull()
    numeric = F.coalesce(kind.rlike(rf"\A({TYPES['number']})\z"), F.lit(False))
    say = lambda what: F.lit(f"{label}: {what}" if label else what)
    out = []
    if "type" in spec:
        fits = kind.rlike(rf"\A({TYPES[spec['type']]})\z")
        if spec["type"] == "integer":  # a number without a fraction, however it is written
            fits = fits | numeric & (number == F.floor(number))
        out.append(F.when(there & ~F.coalesce(fits, F.lit(False)), say(f"not {spec['type']}")))
    if "enum" in spec:
        numbers = [float(x) for x in spec["enum"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
        others = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in spec["enum"] if isinstance(x, bool) or not isinstance(x, (int, float))]
        allowed = F.when(numeric, number.isin(*numbers) if numbers else F.lit(False)).otherwise(F.to_json(found).isin(*others) if others else F.lit(False))
        out.append(F.when(there & ~F.coalesce(allowed, F.lit(False)), say("not allowed")))
    if "minimum" in spec:
        out.append(F.when(numeric & (number < spec["minimum"]), say("too small")))
    if "maximum" in spec:
        out.append(F.when(numeric & (number > spec["maximum"]), say("too large")))
    if "items" in spec:
        wrong = F.exists(F.try_variant_get(value, path, "array<variant>"), lambda x: F.concat_ws("", *_checks(x, spec["items"])) != "")
        out.append(F.when(wrong, say("wrong items")))
    is_object, fields = F.coalesce(kind.startswith("OBJECT"), F.lit(False)), spec.get("properties", {})
    for name in sorted({*fields, *spec.get("required", [])}):
        own = f"{label}.{name}" if label else name
        if name in spec.get("required", []):
            out.append(F.when(is_object & F.try_variant_get(value, _at(path, name), "variant").isNull(), F.lit(f"{own}: missing")))
        out += _checks(value, fields.get(name, {}), _at(path, name), own)
    if not spec.get("additional", True):
        unknown = F.array_sort(F.array_except(F.json_object_keys(F.to_json(found)), F.array(*[F.lit(n) for n in sorted(fields)]).cast("array<string>")))
        out.append(F.when(is_object & (F.size(unknown) > 0), F.concat(say("unknown"), F.lit(": "), F.array_join(unknown, ","))))
    return out


def _problems(value: Column, schema: dict) -> Column:
    """Problems of a parsed object under a tool's schema, joined."""
    out = _checks(value, schema)
    return F.concat_ws("; ", *out) if out else F.lit("")


def check_arguments(tool: Column, value: Column, schemas: dict) -> Column:
    """Empty if the parsed arguments fit the tool's schema, else what is wrong."""
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.when(~is_object, F.lit("arguments: not an object"))
    for name in sorted(schemas):
        out = out.when(tool == name, _problems(value, schemas[name]))
    return out.otherwise(F.lit("tool: unknown"))


def link_tool_calls(events: DataFrame, schemas: dict, scratch: Scratch | None = None) -> DataFrame:
    """``conv_id, turn, kind, call_id, link, valid, problems, after, level, json``, a row for each event."""
    scratch = scratch or Scratch(events.sparkSession, "chat")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))
    rows = events.select("conv_id", key.alias("conv"), F.col("turn").cast("long").alias("turn"), "kind", F.lower(F.trim("role")).alias("role"), "content", "call_id", "tool", "arguments", "depends")
    first = rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "tool", "arguments", "depends")).alias("c"))
    calls = scratch.keep(first.select("conv", "call_id", "c.*"), "calls")
    answers = scratch.keep(rows.where("kind = 'result' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.max("turn").alias("last_result"), F.lit(True).alias("answered")).join(calls.select("conv", "call_id"), ["conv", "call_id"]), "answers")
    levels = _levels(calls, answers, scratch)
    of_call = calls.select("conv", "call_id", F.struct("turn", "tool", "arguments").alias("c_first")).join(answers, ["conv", "call_id"], "left").join(levels, ["conv", "call_id"], "left")
    joined = rows.join(of_call, ["conv", "call_id"], "left")
    is_call, is_result, known = F.col("kind") == "call", F.col("kind") == "result", F.col("c_first").isNotNull()
    same = F.struct("turn", "tool", "arguments").eqNullSafe(F.col("c_first"))
    link = (
        F.when(is_call & known & ~same, "duplicate")
        .when(is_call & known & F.col("c_level").isNull(), "cyclic")
        .when(is_call & F.col("answered").isNotNull(), "linked")
        .when(is_call, "unanswered")
        .when(is_result & known, "linked")
        .when(is_result, "orphan")
    )
    placed = F.col("link").isin("linked", "unanswered") & F.col("c_level").isNotNull()
    value = F.try_parse_json("arguments")
    checked = joined.withColumn("link", link).withColumn("parsed", F.when(is_call, value)).withColumn("problems", F.when(is_call, check_arguments(F.col("tool"), F.col("parsed"), schemas)))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    call = lambda args: F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(F.struct(args.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"))).alias("tool_calls")), WRITTEN)
    written = (
        F.when(is_call & is_object, call(F.col("parsed")))
        .when(is_call, call(F.col("arguments")))
        .when(is_result, F.to_json(F.struct(F.col("content"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")), WRITTEN))
        .otherwise(F.to_json(F.struct(F.col("content"), F.col("role")), WRITTEN))
    )
    return checked.select(
        "conv_id", "turn", "kind", "call_id", "link",
        F.when(is_call, F.col("problems") == "").alias("valid"), "problems",
        F.when(placed & is_call, F.col("c_after")).when(placed & is_result, F.greatest("c_after", "turn")).otherwise(F.col("turn")).alias("after"),
        F.when(placed & is_call, F.col("c_level")).when(placed & is_result, F.col("c_level") + 1).otherwise(F.when(F.col("link") != "cyclic", F.lit(0)).when(F.col("link").isNull(), F.lit(0))).cast("long").alias("level"),
        written.alias("json"),
    )


def _levels(calls: DataFrame, answers: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, call_id, c_after, c_level`` of calls that are on no cycle and behind none."""
    key = ["conv", "call_id"]
    known = calls.select("conv", F.col("call_id").alias("need"))
    needs = calls.select(*key, F.explode(F.array_distinct(F.coalesce("depends", F.array().cast("array<string>")))).alias("need")).join(known, ["conv", "need"], "left_semi")
    own = calls.join(answers, key, "left").select(*key, "turn", F.greatest("turn", "last_result").alias("seen"))
    # an edge leads to a need in so many steps; ``seen`` is the greatest turn of the calls and results passed, that of the need included
    edges = needs.join(own.select("conv", F.col("call_id").alias("need"), "seen"), ["conv", "need"]).withColumn("steps", F.lit(1).cast("long"))
    edges = scratch.keep(edges.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*key))), "edges")
    hops = scratch.keep(edges.where("k = 1").drop("k"), "hops0")
    singles = hops.select("conv", F.col("call_id").alias("need"))
    # a call with one need is a pointer; pointers are doubled until they lead to calls with none or several, those on a cycle never do
    for turn in range(1, max(1, hops.count()).bit_length() + 1):
        if hops.join(singles, ["conv", "need"], "left_semi").isEmpty():
            break
        hops = scratch.keep(_through(hops, hops), f"hops{turn}")
    ended = hops.join(singles, ["conv", "need"], "left_anti")
    waiting = scratch.keep(_through(edges.where("k > 1").drop("k"), ended), "waiting0")
    done = [scratch.keep(own.join(needs, key, "left_anti").select(*key, F.col("turn").alias("c_after"), F.lit(0).cast("long").alias("c_level")), "level0")]
    all_met, turn = None, 0

    def met_by(edges: DataFrame, resolved: DataFrame) -> DataFrame:
        ends = resolved.select("conv", F.col("call_id").alias("need"), F.col("c_after").alias("need_after"), F.col("c_level").alias("need_level"))
        return edges.join(ends, ["conv", "need"]).select(*key, "need", F.greatest("seen", "need_after").alias("need_after"), (F.col("need_level") + 2 * F.col("steps")).alias("need_level"))

    def resolved_by(met: DataFrame) -> DataFrame:
        sums = met.groupBy(*key).agg(F.max("need_after").alias("need_after"), F.max("need_level").alias("c_level"))
        return sums.join(own, key).select(*key, F.greatest("turn", "need_after").alias("c_after"), "c_level")

    while not done[-1].isEmpty() and not waiting.isEmpty():
        # what the last round resolved is taken off the needs; a call is resolved when its last need goes
        turn += 1
        met = scratch.keep(met_by(waiting, done[-1]), f"met{turn}")
        waiting = scratch.keep(waiting.join(done[-1].select("conv", F.col("call_id").alias("need")), ["conv", "need"], "left_anti"), f"waiting{turn}")
        all_met = met if all_met is None else all_met.unionByName(met)
        ready = met.select(*key).distinct().join(waiting, key, "left_anti")
        done.append(scratch.keep(resolved_by(all_met.join(ready, key, "left_semi")), f"level{turn}"))
    out = reduce(DataFrame.unionByName, done)
    return out.unionByName(resolved_by(met_by(ended, out)))


def _through(edges: DataFrame, hops: DataFrame) -> DataFrame:
    """``edges`` led on by ``hops`` where these begin at their need."""
    more = hops.select("conv", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("seen").alias("more_seen"), F.col("steps").alias("more_steps"))
    led = edges.join(more, ["conv", "need"], "left")
    return led.select("conv", "call_id", F.coalesce("next", "need").alias("need"), F.greatest("seen", "more_seen").alias("seen"), (F.col("steps") + F.coalesce("more_steps", F.lit(0))).alias("steps"))
