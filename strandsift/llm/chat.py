"""Chat formatting with tool-call linking, in DataFrame operations only.

A message's text is plain, or a JSON object: {"content", "tool_calls": [{"id", "name", "arguments", "depends_on"?}]} makes calls,
{"tool_call_id", "content"} is a result. Calls and results are linked by a hash join on (conversation, identifier). Messages are put in topological
order: a result after its call, a call after the results of the calls in depends_on, else by turn; a message that must wait moves to just behind
what it waits for. Arguments (an object, or a string that holds one) are validated against the tool's schema: types, also of an array's items, what is
required, what is unknown, and which values are allowed. Every message is serialised as canonical
JSON: keys in order, no blanks, absent values left out. That is the whole JSON object, with arguments parsed that are a string which holds an object;
keys of it that are named as a column (conv_id, role, turn) or `body` stand below `body`.

Scale: the join's key has the call's identifier, so a long conversation spreads. Positions within a conversation are counted in ranges of turns, so
that one is no single task either; only messages of one conversation and one range of turns (those without a turn are one range) are put in order
by one task. A conversation is not gathered in a row: one message a row. The schemas are a parameter, held in the plan.

Ties: of calls with the same identifier in a conversation the first counts (smallest turn, then place); rows that repeat a turn are kept, in order of
their texts. Null turns come last. A null conversation is one of its own. Text that isn't a JSON object, or has neither tool_calls nor
tool_call_id, is plain; null text has no content. Chains of any length are put in order. Messages that wait for themselves (a cycle in depends_on)
get the problem CYCLE; within a cycle only results wait, for their calls, and messages behind it still wait for it. Repeated rows each give a row;
long texts are whole in their JSON. An empty table gives an empty one. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.llm.common import materialise, null_key, rank_within

RANGE, LAST, CYCLE = 256, (1 << 62), "waits for itself"
#: A parameter: its JSON type, whether it is required, and, if given, its items' type (of arrays) and the values that it may have.
Parameter = tuple[str, bool] | tuple[str, bool, str | None] | tuple[str, bool, str | None, tuple]
#: Tools and their parameters.
SCHEMAS: dict[str, dict[str, Parameter]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False), "timeout": ("number", False)},
}

_KIND = (
    "case when schema_of_variant({0}) = 'BIGINT' then 'integer' when schema_of_variant({0}) = 'STRING' then 'string' when schema_of_variant({0}) = 'BOOLEAN' then 'boolean' "
    "when schema_of_variant({0}) like 'OBJECT%' then 'object' when schema_of_variant({0}) like 'ARRAY%' then 'array' when schema_of_variant({0}) = 'VOID' then 'null' else 'number' end"
)
_PARSED = "try_parse_json(case when schema_of_variant(variant_get(c, '$.arguments', 'variant')) = 'STRING' then try_variant_get(c, '$.arguments', 'string') end)"
_CALLS = f"""transform(__calls, c -> case when schema_of_variant({_PARSED}) like 'OBJECT%' then to_variant_object(map_concat(
    map_filter(try_variant_get(c, '$', 'map<string,variant>'), (k, v) -> k <> 'arguments'), map('arguments', {_PARSED}))) else c end)"""
_OWN, _BODY, _NONE = "('body', 'conv_id', 'role', 'turn')", "try_variant_get(__body, '$', 'map<string,variant>')", "cast(map() as map<string,variant>)"
#: A body's keys and the row's columns, as JSON. A variant's keys are in order.
_WHOLE = f"""to_json(to_variant_object(map_concat(
    map_filter({_BODY}, (k, v) -> k not in {_OWN} and not (k = 'tool_calls' and __calls is not null) and not (k in ('content', 'tool_call_id', 'tool_calls') and is_variant_null(v))),
    case when size(map_filter({_BODY}, (k, v) -> k in {_OWN})) > 0 then map('body', to_variant_object(map_filter({_BODY}, (k, v) -> k in {_OWN}))) else {_NONE} end,
    case when __calls is not null then map('tool_calls', to_variant_object({_CALLS})) else {_NONE} end,
    map_filter(map('conv_id', cast(conv_id as variant), 'role', cast(role as variant), 'turn', cast(turn as variant)), (k, v) -> v is not null))))"""


def _spec(schemas: dict[str, dict[str, Parameter]]) -> F.Column:
    kind = "map<string,array<struct<param:string,type:string,required:boolean,items:string,allowed:array<string>>>>"

    def told(name: str, parameter: Parameter) -> F.Column:
        type_, required, items, allowed = (*parameter, None, None)[:4]
        values = F.lit(None) if allowed is None else F.array(*[F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)) for x in allowed])
        return F.struct(F.lit(name).alias("param"), F.lit(type_).alias("type"), F.lit(required).alias("required"), F.lit(items).cast("string").alias("items"), values.cast("array<string>").alias("allowed"))

    pairs = [x for tool, params in schemas.items() for x in (F.lit(tool), F.array(*[told(p, x) for p, x in params.items()]))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast(kind)


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages and (__body variant, null if plain; __result string: the identifier it answers; __calls array<variant>)."""
    looks = F.col(text_col).rlike(r"^\s*\{")
    rows = messages.withColumn("__body", F.when(looks, F.try_parse_json(F.col(text_col))))
    rows = rows.withColumn("__result", F.try_variant_get("__body", "$.tool_call_id", "string")).withColumn("__calls", F.try_variant_get("__body", "$.tool_calls", "array<variant>"))
    return rows.withColumn("__body", F.when(F.col("__result").isNotNull() | F.col("__calls").isNotNull(), F.col("__body")))


def calls_of(rows: DataFrame, schemas: dict[str, dict[str, Parameter]] = SCHEMAS) -> DataFrame:
    """(__conv, __key, __turn, place, call_id, name, arguments, depends_on, problems) for every call; rows from parse, with __conv, __key and __turn."""
    calls = rows.where(F.size("__calls") > 0).select("__conv", "__key", "__turn", F.posexplode("__calls").alias("place", "call"))
    held = F.try_variant_get("call", "$.arguments", "string")
    arguments = F.when(F.expr("schema_of_variant(variant_get(call, '$.arguments', 'variant'))") == "STRING", F.try_parse_json(held)).otherwise(F.expr("variant_get(call, '$.arguments', 'variant')"))
    calls = calls.select(
        "__conv", "__key", "__turn", "place", F.try_variant_get("call", "$.id", "string").alias("call_id"), F.try_variant_get("call", "$.name", "string").alias("name"),
        arguments.alias("arguments"), F.try_variant_get("call", "$.depends_on", "array<string>").alias("depends_on"),
    )
    calls = calls.withColumn("given", F.when(F.expr("schema_of_variant(arguments)").startswith("OBJECT"), F.col("arguments").cast("map<string,variant>")))
    calls = calls.withColumn("spec", F.try_element_at(_spec(schemas), F.coalesce("name", F.lit(""))))
    problems = F.expr(f"""
        case when call_id is null then array('no identifier') when spec is null then array('unknown tool') when given is null then array('arguments are no object') else concat(
          transform(filter(spec, p -> p.required and not map_contains_key(given, p.param)), p -> 'missing ' || p.param),
          transform(filter(spec, p -> map_contains_key(given, p.param) and not (
            {_KIND.format("given[p.param]")} = p.type or (p.type = 'number' and {_KIND.format("given[p.param]")} = 'integer'))), p -> 'not a ' || p.type || ': ' || p.param),
          transform(filter(spec, p -> p.items is not null and exists(try_variant_get(given[p.param], '$', 'array<variant>'), e -> not (
            {_KIND.format("e")} = p.items or (p.items = 'number' and {_KIND.format("e")} = 'integer')))), p -> 'not all ' || p.items || ': ' || p.param),
          transform(filter(spec, p -> p.allowed is not null and map_contains_key(given, p.param) and not array_contains(p.allowed, to_json(given[p.param]))), p -> 'not allowed: ' || p.param),
          transform(array_sort(array_except(map_keys(given), transform(spec, p -> p.param))), k -> 'unknown ' || k)) end""")
    return calls.withColumn("problems", problems).drop("given", "spec")


def _waiting(open_edges: DataFrame) -> DataFrame:
    """(__key, n_open, up, up_hops): how many messages each still waits for, and one of them."""
    return open_edges.groupBy(F.col("after").alias("__key")).agg(F.count(F.lit(1)).alias("n_open"), F.max("before").alias("up"), F.max("hops").alias("up_hops"))


def _settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(__key, __at, __hops, n_open) for nodes in edges; and the edges (before, after) that remain if there are cycles, else None.

    In each round, edges from settled messages are dealt with, and an edge from a message that waits for one other only is moved on to that one, so
    that a chain takes as many rounds as its length has binary digits. A round without a settled message at any edge's begin means cycles.
    """
    touched = edges.select(F.col("before").alias("__key")).union(edges.select("after")).distinct()
    most = touched.count()
    still = materialise(edges.select("before", "after", F.lit(1).cast("long").alias("hops")), "chat-open")
    state = nodes.join(touched, "__key").select("__key", F.col("__turn").alias("__at"), F.lit(0).cast("long").alias("__hops")).join(_waiting(still), "__key", "left")
    state = materialise(state.withColumn("n_open", F.coalesce("n_open", F.lit(0))), "chat-order")
    while not still.isEmpty():
        step = materialise(still.join(state.withColumnRenamed("__key", "before"), "before"), "chat-step")
        if step.where("n_open = 0").isEmpty():
            return state, edges.join(state.where("n_open > 0").select(F.col("__key").alias("before")), "before").select("before", "after")
        ahead = step.groupBy(F.col("after").alias("__key")).agg(F.max(F.struct("__at", (F.col("__hops") + F.col("hops")).alias("__hops"))).alias("wait"))
        on = F.col("n_open") == 1
        moved = step.where("n_open > 0").select(F.when(on, F.col("up")).otherwise(F.col("before")).alias("before"), "after", F.when(on, F.least(F.col("hops") + F.col("up_hops"), F.lit(most))).otherwise(F.col("hops")).alias("hops"))
        still = materialise(moved.groupBy("before", "after").agg(F.max("hops").alias("hops")), "chat-open")
        place = F.greatest(F.struct("__at", "__hops"), F.col("wait"))
        state = state.select("__key", "__at", "__hops").join(ahead, "__key", "left").select("__key", place.alias("place")).select("__key", "place.*").join(_waiting(still), "__key", "left")
        state = materialise(state.withColumn("n_open", F.coalesce("n_open", F.lit(0))), "chat-order")
    return state, None


def _until_same(labels: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels (__key, label) after as many steps as change any; a step gives (__key, new) with labels that are not less."""
    while True:
        new = labels.join(step(labels).groupBy("__key").agg(F.max("new").alias("new")), "__key", "left")
        new = materialise(new.select("__key", F.greatest("label", "new").alias("label"), (F.col("new") > F.col("label")).alias("moved")), "chat-labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def _first_cycles(edges: DataFrame) -> DataFrame:
    """(__key, root): messages in cycles, at least of those that wait for no other cycle; root: the same for messages that wait for each other.

    The greatest key goes to all that wait for it, directly or not; what it reaches and is reached from waits for itself.
    """
    keys = edges.select(F.col("before").alias("__key")).union(edges.select("after")).distinct()
    roots = _until_same(keys.withColumn("label", F.col("__key")), lambda x: edges.join(x.withColumnRenamed("__key", "before"), "before").select(F.col("after").alias("__key"), F.col("label").alias("new")))
    same = edges.join(roots.select(F.col("__key").alias("before"), F.col("label").alias("root")), "before").join(roots.select(F.col("__key").alias("after"), F.col("label").alias("root")), ["after", "root"])
    same = materialise(same, "chat-same")
    back = roots.select("__key", (F.col("__key") == F.col("label")).cast("int").alias("label"))
    back = _until_same(back, lambda x: same.join(x.withColumnRenamed("__key", "after"), "after").select(F.col("before").alias("__key"), F.col("label").alias("new")))
    members = roots.withColumnRenamed("label", "root").join(back.where("label = 1").select("__key"), "__key")
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return materialise(members.join(several, "root").select("__key", "root"), "chat-cycles")


def order_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(__key, __at, __hops, cyclic) for nodes (__key, __turn) that have to wait; edges (before, after, link) between keys, link: from a call to its result.

    A message goes to the latest place of what it waits for, one hop behind it. Cycles lose the edges among their messages that are no links, or all
    if there are only links; the rest of the order holds.
    """
    cyclic = None
    while True:
        state, left = _settle(nodes, edges)
        if left is None:
            break
        found = _first_cycles(materialise(left, "chat-left"))
        cyclic = found.select("__key") if cyclic is None else materialise(cyclic.union(found.select("__key")).distinct(), "chat-cyclic")
        inside = edges.join(found.select(F.col("__key").alias("before"), "root"), "before").join(found.select(F.col("__key").alias("after"), "root"), ["after", "root"])
        mixed = inside.where("not link").select("root").distinct().withColumn("mixed", F.lit(True))
        cut = inside.join(mixed, "root", "left").where("not link or mixed is null").select("before", "after")
        edges = materialise(edges.join(cut, ["before", "after"], "left_anti"), "chat-edges")
    state = state.select("__key", "__at", "__hops")
    if cyclic is None:
        return state.withColumn("cyclic", F.lit(False))
    alone = cyclic.join(state, "__key", "left_anti").join(nodes, "__key").select("__key", F.col("__turn").alias("__at"), F.lit(0).cast("long").alias("__hops"))
    return state.unionByName(alone).join(cyclic.withColumn("cyclic", F.lit(True)), "__key", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: dict[str, dict[str, Parameter]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, role, position, n_calls, n_answered, problems, answers, linked, json) for every message.

    position: place in its conversation, from 0. n_answered: its calls that have a result. problems: of its calls' arguments, in order. answers: the
    identifier that it is a result for; linked: whether there is that call.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = parse(rows).withColumn("__conv", null_key("conv_id")).withColumn("__turn", F.coalesce("turn", F.lit(LAST)))
    rows = rows.withColumn("__key", F.sha2(F.to_json(F.array(F.col("__conv"), F.col("turn").cast("string"), F.col("role"), F.col("text"))), 256))
    special = rows.where(F.col("__body").isNotNull())
    calls = materialise(calls_of(special, schemas).withColumn("arguments", F.to_json("arguments")), "chat-calls")
    results = materialise(special.where(F.col("__result").isNotNull()).select("__conv", "__key", "__turn", F.col("__result").alias("call_id")), "chat-results")
    first = calls.where(F.col("call_id").isNotNull()).groupBy("__conv", "call_id").agg(F.min(F.struct("__turn", "place", F.col("__key").alias("key"))).alias("of"))
    links = results.join(first, ["__conv", "call_id"], "left").select("__conv", "call_id", "__key", F.col("of.key").alias("from"))
    links = materialise(links.distinct(), "chat-links")
    waits = calls.where(F.size("depends_on") > 0).select("__conv", F.col("__key").alias("after"), F.explode("depends_on").alias("call_id"))
    waits = waits.join(links.where(F.col("from").isNotNull()).select("__conv", "call_id", F.col("__key").alias("before")), ["__conv", "call_id"]).select("before", "after", F.lit(False).alias("link"))
    edges = links.where(F.col("from").isNotNull()).select(F.col("from").alias("before"), F.col("__key").alias("after"), F.lit(True).alias("link")).unionByName(waits)
    edges = edges.where("before <> after").groupBy("before", "after").agg(F.max("link").alias("link"))
    edges = materialise(edges, "chat-edges")
    answered = links.where(F.col("from").isNotNull()).select("__conv", "call_id").distinct().withColumn("answered", F.lit(1))
    by_message = calls.join(answered, ["__conv", "call_id"], "left").groupBy("__key").agg(
        F.count_distinct("place").alias("n_calls"), F.count_distinct(F.when(F.col("answered").isNotNull(), F.col("place"))).alias("n_answered"),
        F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("place", "problems"))), lambda x: x["problems"])).alias("problems"),
    )
    linked = links.groupBy("__key").agg(F.max(F.col("from").isNotNull()).alias("linked"))
    keys = special.select("__key", "__turn").distinct()
    facts = keys.select("__key").join(by_message, "__key", "left").join(linked, "__key", "left").join(order_keys(keys, edges), "__key", "left")
    plain = rows.where(F.col("__body").isNull()).withColumns({"__at": F.col("__turn"), "__hops": F.lit(0).cast("long"), "n_calls": F.lit(0).cast("long"), "n_answered": F.lit(0).cast("long"), "problems": F.array().cast("array<string>"), "linked": F.lit(None).cast("boolean")})
    calling = special.join(facts, "__key")
    calling = calling.withColumns({"__at": F.coalesce("__at", "__turn"), "__hops": F.coalesce("__hops", F.lit(0)), "n_calls": F.coalesce("n_calls", F.lit(0)), "n_answered": F.coalesce("n_answered", F.lit(0)), "problems": F.coalesce("problems", F.array().cast("array<string>"))})
    calling = calling.withColumn("problems", F.when(F.col("cyclic"), F.array_append("problems", F.lit(CYCLE))).otherwise(F.col("problems"))).drop("cyclic")
    both = plain.unionByName(calling)
    plainly = F.to_json(F.struct(F.col("text").alias("content"), F.col("conv_id"), F.col("role"), F.col("turn")))
    both = both.withColumn("json", F.when(F.col("__body").isNull(), plainly).otherwise(F.expr(_WHOLE)))
    both = both.select("__conv", "__at", "__hops", "__turn", "conv_id", "turn", "role", "n_calls", "n_answered", "problems", F.col("__result").alias("answers"), "linked", "json")
    order = [F.col(x) for x in ("__at", "__hops", "__turn", "json")]
    ranked = rank_within(both, ["__conv"], F.least(F.floor(F.col("__at") / RANGE), F.lit(LAST)), order, "position")
    return ranked.select("conv_id", "turn", "role", "position", "n_calls", "n_answered", "problems", "answers", "linked", "json")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return formatted.select("conv_id", "turn", "role", "position", "n_calls", "n_answered", F.array_join("problems", "; ").alias("problems"), "answers", "linked", "json")


#: For tables whose messages are plain texts, without calls and results; tests cover those.
OP7_SQL = r"""
SELECT conv_id, turn, role, position, n_calls, n_answered, problems, answers, linked, json
FROM (
  SELECT conv_id, turn, role,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 4611686018427387904), json) - 1 AS BIGINT) AS position,
         CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_answered, '' AS problems, CAST(NULL AS VARCHAR) AS answers, CAST(NULL AS BOOLEAN) AS linked, json
  FROM (
    SELECT *, '{' || array_to_string(list_filter([
        '"content":' || CAST(to_json(text) AS VARCHAR), '"conv_id":' || conv_id, '"role":' || CAST(to_json(role) AS VARCHAR), '"turn":' || turn
      ], lambda x: x IS NOT NULL), ',') || '}' AS json
    FROM conversations
  )
)
"""
