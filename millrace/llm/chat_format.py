"""Chat formatting with tool-call linking, with DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, messages get a place in
which every result comes after its call, arguments are validated against their tool's
schema, and each message is serialised as canonical JSON (sorted keys, no blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialize

#: A field's type by the name that Spark's variant gives it.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^(OBJECT|STRUCT).*"}

Schemas = dict[str, dict[str, dict]]


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the JSON text ``arguments`` fits the schema of tool ``name``.

    A schema has for each field its ``type`` and optionally ``required``, ``min_length`` and
    ``max_length``. Unknown tools, unknown fields and text that isn't a JSON object don't fit.
    """
    fields_of = F.from_json(arguments, T.MapType(T.StringType(), T.VariantType()))  # by name, so any name will do
    keys = F.when(F.try_parse_json(arguments).isNotNull(), F.json_object_keys(arguments))
    out = F.lit(False)
    for tool, fields in schemas.items():
        fits = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) == 0)
        for field, rule in fields.items():
            value = F.try_element_at(fields_of, F.lit(field))
            kind = F.schema_of_variant(value)
            there = F.array_contains(keys, field)
            right = kind.rlike(TYPES[rule["type"]])
            text = F.try_variant_get(value, "$", "string")
            if "min_length" in rule:
                right = right & (F.length(text) >= rule["min_length"])
            if "max_length" in rule:
                right = right & (F.length(text) <= rule["max_length"])
            fits = fits & F.when(there, F.coalesce(right, F.lit(False))).otherwise(F.lit(not rule.get("required")))
        out = F.when(name == tool, F.coalesce(fits, F.lit(False))).otherwise(out)
    return out


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def _member(key: str, value: Column) -> Column:
    """``"key":"value"`` for a string, null for a null."""
    inner = F.to_json(F.struct(value.cast("string").alias(key)))
    return F.when(value.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


def _call_places(calls: DataFrame) -> DataFrame:
    """Adds ``place_turn`` and ``place_part`` to calls ``(conv_id, link_id, call_turn, parent)``.

    A call stands at its own turn, unless the message that makes it answers another call which
    stands later: then right behind that one. A chain of such messages is followed by pointer
    doubling: each round joins a stretch of a chain with the one above it, so a chain of n calls
    takes log2(n) rounds. A stretch is (its latest turn, messages after that, messages). Messages
    that answer each other in a circle have no order and keep their own turns.
    """
    plain = calls.select("*", F.col("call_turn").alias("place_turn"), F.lit(0).cast("bigint").alias("place_part"))
    if calls.filter("parent is not null").isEmpty():
        return plain.drop("parent")
    names = calls.select(F.col("conv_id").alias("o_conv"), F.col("link_id").alias("o_id"))
    above = calls.filter("parent is not null").join(names, (F.col("conv_id") == F.col("o_conv")) & (F.col("parent") == F.col("o_id"))).drop("o_conv", "o_id")
    above = materialize(above.select("conv_id", "link_id", F.col("parent").alias("at"), F.col("call_turn").alias("latest"), F.lit(0).cast("bigint").alias("after"), F.lit(1).cast("bigint").alias("n")), "chains")
    for _ in range(max(above.count(), 1).bit_length()):
        upper = above.select(F.col("conv_id").alias("o_conv"), F.col("link_id").alias("o_id"), F.col("at").alias("o_at"), F.col("latest").alias("o_latest"), F.col("after").alias("o_after"), F.col("n").alias("o_n"))
        joined = above.join(upper, (F.col("conv_id") == F.col("o_conv")) & (F.col("at") == F.col("o_id")), "left")
        more, later = F.col("o_id").isNotNull(), F.col("o_latest") >= F.col("latest")
        above = joined.select(
            "conv_id", "link_id", F.when(more, F.col("o_at")).otherwise(F.col("at")).alias("at"),
            F.when(more & later, F.col("o_latest")).otherwise(F.col("latest")).alias("latest"),
            F.when(more & later, F.col("o_after") + F.col("n")).otherwise(F.col("after")).alias("after"),
            F.when(more, F.col("o_n") + F.col("n")).otherwise(F.col("n")).alias("n"),
        )
        above = materialize(above, "chains")
    # What a stretch has not left by now is a circle.
    heads = calls.select(F.col("conv_id").alias("o_conv"), F.col("link_id").alias("o_id"), F.col("call_turn").alias("head_turn"))
    open_ends = above.select(F.col("conv_id").alias("b_conv"), F.col("link_id").alias("b_id"))
    done = above.join(open_ends, (F.col("conv_id") == F.col("b_conv")) & (F.col("at") == F.col("b_id")), "left_anti").join(heads, (F.col("conv_id") == F.col("o_conv")) & (F.col("at") == F.col("o_id")))
    behind = F.col("head_turn") >= F.col("latest")
    done = done.select(F.col("conv_id").alias("o_conv"), F.col("link_id").alias("o_id"), F.when(behind, F.col("head_turn")).otherwise(F.col("latest")).alias("t"), F.when(behind, F.col("n")).otherwise(F.col("after")).alias("p"))
    joined = plain.join(done, (F.col("conv_id") == F.col("o_conv")) & (F.col("link_id") == F.col("o_id")), "left")
    return joined.select("conv_id", "link_id", "call_turn", F.coalesce("t", "place_turn").alias("place_turn"), F.coalesce("p", "place_part").alias("place_part"))


def format_chats(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each message: where it goes, how it is linked, and its JSON.

    ``messages`` has conv_id, turn, role, text, call_id, call_name, arguments (of a call) and
    result_of (of a result, the call's id); other columns are not read. Returned are conv_id,
    turn, role, order_turn, order_part, link, valid and json. Sorting a conversation by
    (order_turn, order_part, turn) is a topological order: messages stand by turn, and a result
    that comes before its call is put right behind it, a result of that result's own call behind
    that, and so on. ``link`` is call, open_call (without a result), result, orphan_result
    (without a call) or none; a message that answers one call and makes another has both, as
    ``result,call``. ``valid`` is null but for calls.

    If calls share an identifier, results belong to the first of them. Nulls never link: a
    message with neither id is plain. Null texts have no content member, texts of any length are
    serialised whole; arguments that aren't JSON are kept as a string. Repeated rows each give a
    row, an empty table gives an empty one. Each message is a row of its own, so a conversation
    of any length is spread over all tasks, and messages without ids aren't shuffled.
    """
    m = messages.select("conv_id", "turn", "role", "text", "call_id", "call_name", "arguments", "result_of")
    calls = m.filter("call_id is not null").groupBy("conv_id", F.col("call_id").alias("link_id")).agg(F.min(F.struct("turn", "result_of")).alias("first"))
    calls = _call_places(calls.select("conv_id", "link_id", F.col("first.turn").alias("call_turn"), F.col("first.result_of").alias("parent")))
    answers = m.filter("result_of is not null").groupBy(F.col("conv_id").alias("a_conv"), F.col("result_of").alias("a_id")).agg(F.lit(True).alias("answered"))
    links = calls.join(answers.hint("shuffle_hash"), (F.col("conv_id") == F.col("a_conv")) & (F.col("link_id") == F.col("a_id")), "left")
    links = links.select(F.col("conv_id").alias("l_conv"), "link_id", "place_turn", "place_part", F.coalesce("answered", F.lit(False)).alias("answered"))

    def linked_by(rows: DataFrame, own: Column, wanted: list[str]) -> DataFrame:
        found = links.select("l_conv", "link_id", *wanted).hint("shuffle_hash")
        return rows.join(found, (F.col("conv_id") == F.col("l_conv")) & (own == F.col("link_id")), "left").drop("l_conv", "link_id")

    own, of_call = F.coalesce("call_id", "result_of"), ["place_turn", "place_part"]
    is_call, is_result = F.col("call_id").isNotNull(), F.col("result_of").isNotNull()
    single = linked_by(m.filter(is_call != is_result), own, [*of_call, "answered"])
    double = linked_by(linked_by(m.filter(is_call & is_result), F.col("call_id"), ["answered"]), F.col("result_of"), of_call)
    plain = m.filter(own.isNull()).withColumns({"place_turn": F.lit(None).cast(m.schema["turn"].dataType), "place_part": F.lit(None).cast("bigint"), "answered": F.lit(None).cast("boolean")})
    every = single.unionByName(double).unionByName(plain)

    linked = is_result & F.col("place_turn").isNotNull()
    early = linked & (F.col("turn") <= F.col("place_turn"))
    as_result = F.when(linked, "result").when(is_result, "orphan_result")
    as_call = F.when(is_call & F.coalesce("answered", F.lit(False)), "call").when(is_call, "open_call")
    link = F.when(is_call | is_result, F.concat_ws(",", as_result, as_call)).otherwise("none")
    arguments = F.coalesce(canonical(F.col("arguments")), F.regexp_replace(_member("x", F.col("arguments")), '^"x":', ""), F.lit("null"))
    call = F.concat(F.lit('"tool_call":{"arguments":'), arguments, F.lit(","), F.concat_ws(",", _member("id", F.col("call_id")), _member("name", F.col("call_name"))), F.lit("}"))
    members = F.concat_ws(",", _member("content", F.col("text")), _member("role", F.col("role")), F.when(is_call, call), _member("tool_call_id", F.col("result_of")))
    return every.select(
        "conv_id", "turn", "role",
        F.when(early, F.col("place_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(early, F.col("place_part") + 1).otherwise(0).cast("int").alias("order_part"),
        link.alias("link"),
        F.when(is_call, valid_arguments(F.col("call_name"), F.col("arguments"), schemas)).alias("valid"),
        F.concat(F.lit("{"), members, F.lit("}")).alias("json"),
    )


#: The conversations' user turns as calls of one tool, which the assistant's next turn answers.
ASK: Schemas = {"ask": {"query": {"type": "string", "required": True, "min_length": 1, "max_length": 300}, "turn": {"type": "integer", "required": True}}}


def as_calls(conversations: DataFrame) -> DataFrame:
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(user, name(F.col("turn"))).alias("call_id"),
        F.when(user, "ask").alias("call_name"),
        F.when(user, F.to_json(F.struct("turn", F.col("text").alias("query")))).alias("arguments"),
        F.when(assistant, name(F.col("turn") - 1)).alias("result_of"),
    )


ORACLE = """
WITH m AS (
  SELECT *, role = 'user' AS is_call, role = 'assistant' AS is_result,
    'call-' || conv_id || '-' || (CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END) AS id FROM conversations),
calls AS (SELECT conv_id, id, min(turn) AS call_turn FROM m WHERE is_call GROUP BY ALL),
answers AS (SELECT DISTINCT conv_id, id, TRUE AS answered FROM m WHERE is_result)
SELECT m.conv_id, m.turn, m.role, m.turn AS order_turn, CAST(0 AS INTEGER) AS order_part,
  CASE WHEN is_call AND answered THEN 'call' WHEN is_call THEN 'open_call' WHEN is_result AND call_turn IS NOT NULL THEN 'result'
    WHEN is_result THEN 'orphan_result' ELSE 'none' END AS link,
  CASE WHEN is_call THEN length(text) BETWEEN 1 AND 300 END AS valid,
  '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"' ||
    CASE WHEN is_call THEN ',"tool_call":{"arguments":{"query":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || m.turn || '},"id":"' || m.id || '","name":"ask"}' ELSE '' END ||
    CASE WHEN is_result THEN ',"tool_call_id":"' || m.id || '"' ELSE '' END || '}' AS json
FROM m LEFT JOIN calls c ON m.conv_id = c.conv_id AND m.id = c.id AND (is_call OR is_result)
  LEFT JOIN answers a ON m.conv_id = a.conv_id AND m.id = a.id AND is_call
"""
