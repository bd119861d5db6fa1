"""Chat formatting: tool-call linking.

Messages carry calls as ``<tool_call>{"id":…,"name":…,"arguments":{…}}</tool_call>`` and
results as ``<tool_response>{"tool_call_id":…,"content":…}</tool_response>`` (or as the whole
text of a message of role "tool").  A call may name results it builds on in ``depends_on``.

Calls and results are joined by (conversation, identifier); results come after their calls
and calls after the results they build on, level by level (Kahn), so each event gets
``(anchor_turn, level)``: sorting a conversation by anchor_turn, level, turn, seq is a
topological order.  No window runs over a conversation, so one of any length is no hot task.
Arguments are checked against schemas compiled into one expression, and events are written
as canonical JSON: no white space, keys sorted at every depth, by the VARIANT type.

Defined results: a call whose JSON can't be read has status "malformed"; the first of calls
(or results) that repeat an identifier is linked, the others are "duplicate"; a result
without a call is "orphan", a call without a result "unanswered"; events on a cycle have status
"cycle" and no level; null texts are messages with null content; rows with a null conversation
or turn are messages like others, and their calls and results link to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

#: name -> {argument: (type, required)}; types: string, integer, number, boolean, object, array.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
    "run_code": {"code": ("string", True), "language": ("string", False), "timeout": ("number", False)},
}
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_response>(.*?)</tool_response>"
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments (VARIANT), as an array; empty: valid."""
    kind = F.coalesce(F.schema_of_variant(arguments), F.lit("VOID"))
    given = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    out = F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit(""))))
    for tool, params in tools.items():
        tests = []
        for p, (t, required) in params.items():
            value = F.schema_of_variant(F.try_variant_get(arguments, f"$['{p}']", "variant"))
            there = F.array_contains(given, p)
            tests.append(F.when(there & ~F.coalesce(value, F.lit("VOID")).rlike(f"^{KINDS[t]}\\b"), F.lit(f"{p}: not {t}")).when(~there & F.lit(required), F.lit(f"{p}: missing")))
        extra = F.transform(F.array_except(given, F.array(*map(F.lit, params))), lambda x: F.concat(x, F.lit(": not known")))
        found = F.concat(F.array_compact(F.array(*tests)), F.sort_array(extra))
        out = F.when(name == tool, found).otherwise(out)
    return F.when(~kind.startswith("OBJECT"), F.array(F.lit("arguments: not an object"))).otherwise(out)


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def events(messages: DataFrame) -> DataFrame:
    """One row for each message, call and result, in order of seq within its message."""
    text, role = F.col("text"), F.col("role")
    bodies = lambda rx: F.coalesce(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), F.array().cast("array<string>"))
    bare_result = (role == "tool") & ~F.coalesce(text.contains("<tool_response>"), F.lit(False)) & text.isNotNull()
    results = F.when(bare_result, F.array(text)).otherwise(bodies(RESULT))
    made = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw"))
    content = F.when(bare_result, F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, CALL, ""), RESULT, ""))
    one = F.array(F.struct(F.lit("message").alias("kind"), content.alias("raw")))
    every = F.concat(one, F.transform(bodies(CALL), made("call")), F.transform(results, made("result")))
    flat = messages.select("conv_id", "turn", "role", F.posexplode(every).alias("seq", "e")).select("conv_id", "turn", "role", "seq", "e.kind", "e.raw")
    v = F.when(F.col("kind") != "message", F.try_parse_json("raw"))
    got = flat.withColumn("v", v)
    body = F.col("v")
    return got.select(
        "conv_id", "turn", "role", "seq", "kind", "raw", "v",
        F.when(F.col("kind") == "call", _text(body, "id")).when(F.col("kind") == "result", _text(body, "tool_call_id")).alias("call_id"),
        F.when(F.col("kind") == "call", _text(body, "name")).alias("name"),
        F.when(F.col("kind") == "call", F.try_variant_get(body, "$.arguments", "variant")).alias("arguments"),
        F.when(F.col("kind") == "call", F.try_variant_get(body, "$.depends_on", "array<string>")).alias("depends_on"),
    )


def order_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, node, anchor_turn, level) by Kahn's algorithm; nodes on or behind a cycle are missing.

    ``nodes``: (conv_id, node, turn); ``edges``: (conv_id, src, dst), src before dst.
    """
    waiting = materialize(nodes.join(edges.select("conv_id", F.col("dst").alias("node")).distinct(), ["conv_id", "node"], "left_semi"), "waiting")
    done = materialize(nodes.join(waiting.select("conv_id", "node"), ["conv_id", "node"], "left_anti").select("conv_id", "node", F.col("turn").cast("bigint").alias("anchor_turn"), F.lit(0).alias("level")), "done")
    while waiting.limit(1).count():
        src = done.select("conv_id", F.col("node").alias("src"), "anchor_turn", "level")
        # A node is ready when all that comes before it is done.
        met = edges.join(src, ["conv_id", "src"], "left").groupBy("conv_id", F.col("dst").alias("node"))
        ready = met.agg(F.max("anchor_turn").alias("a"), F.max("level").alias("l"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
        new = materialize(waiting.join(ready, ["conv_id", "node"]).select("conv_id", "node", F.greatest("a", F.col("turn").cast("bigint")).alias("anchor_turn"), (F.col("l") + 1).alias("level")), "ready")
        if not new.limit(1).count():
            break
        done = materialize(done.unionByName(new), "done")
        waiting = materialize(waiting.join(new.select("conv_id", "node"), ["conv_id", "node"], "left_anti"), "waiting")
    return done


def link(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """Every event with its status, errors, place in topological order and canonical JSON.

    Columns: conv_id, turn, seq, role, kind, call_id, name, status, errors, anchor_turn, level, json.
    """
    base = messages.select("conv_id", "turn", "role", "text")
    rows = events(base)
    linked = rows.filter("kind != 'message' and conv_id is not null and turn is not null and call_id is not null")
    first = materialize(linked.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct("turn", "seq")).alias("at"), F.min_by("depends_on", F.struct("turn", "seq")).alias("depends_on")), "first")
    call = first.filter("kind = 'call'").select("conv_id", "call_id", F.col("at").alias("call_at"), "depends_on")
    result = first.filter("kind = 'result'").select("conv_id", "call_id", F.col("at").alias("result_at"))
    pairs = materialize(call.join(result, ["conv_id", "call_id"], "full"), "pairs")
    node = lambda kind, x: F.concat(F.lit(kind), x)
    both = pairs.filter("call_at is not null and result_at is not null")
    wants = pairs.filter("call_at is not null").select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    wants = wants.join(both.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi")
    edges = materialize(
        both.select("conv_id", node("c:", F.col("call_id")).alias("src"), node("r:", F.col("call_id")).alias("dst")).union(
            wants.select("conv_id", node("r:", F.col("on")).alias("src"), node("c:", F.col("call_id")).alias("dst"))
        ),
        "edges",
    )
    nodes = pairs.filter("call_at is not null").select("conv_id", node("c:", F.col("call_id")).alias("node"), F.col("call_at.turn").alias("turn"))
    nodes = materialize(nodes.union(pairs.filter("result_at is not null").select("conv_id", node("r:", F.col("call_id")).alias("node"), F.col("result_at.turn").alias("turn"))), "nodes")
    placed = order_events(nodes, edges)
    k = F.col("kind")
    key = F.when(k == "call", node("c:", F.col("call_id"))).when(k == "result", node("r:", F.col("call_id")))
    # Messages need neither join; only calls and results, few of the rows, are shuffled.
    special = rows.filter("kind != 'message'").withColumn("node", key)
    special = special.join(pairs.select("conv_id", "call_id", "call_at", "result_at"), ["conv_id", "call_id"], "left").join(placed, ["conv_id", "node"], "left")
    me = F.struct("turn", "seq")
    own = F.when(k == "call", F.col("call_at")).otherwise(F.col("result_at"))
    broken = F.col("v").isNull() | F.col("call_id").isNull() | ((k == "call") & F.col("name").isNull())
    status = (
        F.when(broken, "malformed")
        .when(own.isNull(), F.when(k == "call", "unanswered").otherwise("orphan"))
        .when(~((own["turn"] == F.col("turn")) & (own["seq"] == F.col("seq"))), "duplicate")
        .when((k == "call") & F.col("result_at").isNull(), "unanswered")
        .when((k == "result") & F.col("call_at").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle")
        .otherwise("linked")
    )
    errors = F.when((k == "call") & ~broken, argument_errors(F.col("name"), F.col("arguments"), tools))
    del me
    written = (
        F.when(F.col("v").isNull(), _json(F.col("raw").alias("content"), F.col("role").alias("role")))
        .when(k == "call", _json(F.col("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name")))
        .otherwise(_json(F.try_variant_get("v", "$.content", "variant").alias("content"), F.col("call_id").alias("tool_call_id")))
    )
    names = ["conv_id", "turn", "seq", "role", "kind", "call_id", "name", "status", "errors", "anchor_turn", "level", "json"]
    turn = F.col("turn").cast("bigint")
    special = special.select("conv_id", "turn", "seq", "role", "kind", "call_id", "name", status.alias("status"), errors.alias("errors"), F.coalesce("anchor_turn", turn).alias("anchor_turn"), F.when(status == "cycle", None).otherwise(F.coalesce("level", F.lit(0))).alias("level"), written.alias("json"))
    plain = rows.filter("kind = 'message'").select(
        "conv_id", "turn", "seq", "role", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit("message").alias("status"),
        F.lit(None).cast("array<string>").alias("errors"), turn.alias("anchor_turn"), F.lit(0).alias("level"), _json(F.col("raw").alias("content"), F.col("role").alias("role")).alias("json"),
    )
    return plain.unionByName(special).select(*names)


def _json(*fields: Column) -> Column:
    """Canonical JSON of fields named in order."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def formatted(messages: DataFrame) -> DataFrame:
    """link(), with the errors as JSON."""
    return link(messages).withColumn("errors", F.to_json("errors"))
