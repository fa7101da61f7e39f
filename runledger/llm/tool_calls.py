"""Tool calls and their results, linked, checked, ordered and written as canonical JSON, in SQL functions.

Calls and results are reduced to one row an identifier and then meet in a hash join. A call may
refer to the result of another as ``${identifier}`` in its arguments; it then comes after it. The
order is topological: a call keeps its own place unless it refers to a later one, and then moves
behind it; what refers to it moves too. Arguments are checked against the schema of their tool.
Nothing is gathered by conversation, so one conversation may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
_RESULT = "struct<tool_call_id: string, content: string>"
_CONV = ["conv_id", "call_id"]
_ACCEPTED = {"number": ["number", "integer"]}
#: Turns of a conversation in which ``dialogue_as_calls`` may draw a circle.
SHORT = 16


def calls_of(messages: DataFrame) -> DataFrame:
    """Calls in assistant texts of the form {"tool_calls": [{"id", "name", "arguments"}, ...]}.

    ``messages`` has conv_id, turn, role and text. Other texts hold no calls.
    """
    said = messages.where("role = 'assistant' and text like '%tool_calls%'").withColumn("said", F.from_json("text", _CALLS))
    return said.select("conv_id", "turn", F.posexplode("said.tool_calls").alias("place", "call")).select(
        "conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments")
    )


def results_of(messages: DataFrame) -> DataFrame:
    """Results in texts of role ``tool``: {"tool_call_id", "content"}."""
    said = messages.where("role = 'tool'").withColumn("said", F.from_json("text", _RESULT))
    return said.where("said.tool_call_id is not null").select(
        "conv_id", "turn", F.col("said.tool_call_id").alias("call_id"), F.col("said.content").alias("content")
    )


def dialogue_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogue as calls and results, by fixed rules, for tables that hold no calls.

    A user turn makes two calls. ``answer``, named like its turn, refers back to the answer two turns
    before; the assistant's next turn is its result. ``note``, with an n behind, refers forward to the
    answer two turns later and holds the length of the text, as a text where it is odd. In each
    seventh conversation it has a tool's name that no schema knows. In each tenth conversation of at
    most ``SHORT`` turns an early answer also refers to its note, by an argument that no schema knows: a
    circle, if the user speaks again. A system turn is a result for a note before it, which there is
    not. Rows without a conversation or turn are left out.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    asked = rows.where("role = 'user'").join(ends, "conv_id")
    refer = lambda turn, more="": F.concat(F.lit("${"), turn.cast("string"), F.lit(more + "}"))
    turn, size = F.col("turn"), F.length("text")
    circle = (F.pmod("conv_id", F.lit(10)) == 3) & (turn < 2) & (F.col("end") < SHORT)
    answer = F.to_json(F.struct(F.when(turn >= 2, refer(turn - 2)).alias("after"), F.when(circle, refer(turn, "n")).alias("see"), F.col("text")))
    of = refer(turn + 2).alias("of")
    note = F.when(size % 2 == 1, F.to_json(F.struct(of, size.cast("string").alias("size")))).otherwise(F.to_json(F.struct(of, size.alias("size"))))
    noted = F.when(F.pmod("conv_id", F.lit(7)) == 1, "memo").otherwise("note")
    each = F.inline(
        F.array(
            F.struct(F.lit(0).alias("place"), turn.cast("string").alias("call_id"), F.lit("answer").alias("name"), answer.alias("arguments")),
            F.struct(F.lit(1).alias("place"), F.concat(turn.cast("string"), F.lit("n")).alias("call_id"), noted.alias("name"), note.alias("arguments")),
        )
    )
    calls = asked.select("conv_id", "turn", each)
    before = (turn - 1).cast("string")
    answered = F.when(F.col("role") == "assistant", before).otherwise(F.concat(before, F.lit("n")))
    results = rows.where("role in ('assistant', 'system')").select("conv_id", "turn", answered.alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _first_of(rows: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The first row of each identifier, and how many there were."""
    first = F.min(F.struct(*columns)).alias("first")
    return rows.where("call_id is not null").groupBy(*_CONV).agg(first, F.count("*").alias(number)).select(*_CONV, "first.*", number)


def _errors(name: Column, arguments: Column, tools: Mapping[str, Mapping]) -> Column:
    """What is wrong with a call's arguments, sorted; empty if they fit the schema.

    ``tools`` maps names to {"required": [...], "properties": {property: JSON type}}.
    """
    given = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string, variant>")
    kind = F.transform_values(given, lambda _, v: _json_type(F.schema_of_variant(v)))
    checks = F.lit(None).cast("array<string>")
    for tool, schema in sorted(tools.items()):
        known = schema.get("properties", {})
        names = F.array(*map(F.lit, sorted(known))).cast("array<string>")
        parts = [
            F.filter(
                F.array(*[F.when(~F.coalesce(F.map_contains_key(kind, p), F.lit(False)), F.lit(f"missing {p}")) for p in sorted(schema.get("required", []))]).cast("array<string>"),
                lambda e: e.isNotNull(),
            ),
            F.transform(F.array_except(F.map_keys(kind), names), lambda p: F.concat(F.lit("unknown "), p)),
            F.filter(
                F.array(*[F.when(F.map_contains_key(kind, p) & ~F.element_at(kind, p).isin(_ACCEPTED.get(t, [t])), F.concat(F.lit(f"{p} is not {t} but "), F.element_at(kind, p))) for p, t in sorted(known.items())]).cast("array<string>"),
                lambda e: e.isNotNull(),
            ),
        ]
        found = F.when(kind.isNull(), F.array(F.lit("arguments are not an object"))).otherwise(F.array_sort(F.concat(*parts)))
        checks = F.when(name == tool, found).otherwise(checks)
    return F.coalesce(checks, F.array(F.lit("unknown tool")))


def _json_type(kind: Column) -> Column:
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind == "BIGINT", "integer").otherwise("number")
    )


def _ordered(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``calls`` with ``order_turn``, ``order_place``, ``order_step`` and ``cyclic``.

    Sorting by these puts every call behind those it refers to. Most calls refer back and stay; the
    others move in rounds, one for each link of the chain behind a reference forward. References to
    unknown identifiers, or to the call itself, do not count. A call that has moved more often than
    its conversation has calls is in a circle or behind one; such calls stop there and are marked.
    """
    size = calls.groupBy("conv_id").agg(F.count("*").alias("size"))
    at = F.struct("turn", "place", F.lit(0).cast("long").alias("step"))
    moved = scratch.keep(calls.join(size, "conv_id").select(*_CONV, at.alias("at"), "size"), "nodes")
    refers = calls.select(*_CONV, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^}]+)\}"), F.lit(1)))).alias("other"))
    known = moved.select("conv_id", F.col("call_id").alias("other"))
    edges = scratch.keep(refers.where("other <> call_id").join(known, ["conv_id", "other"], "left_semi"), "edges")
    while True:
        ends = edges.join(moved, _CONV).join(
            moved.select("conv_id", F.col("call_id").alias("other"), F.col("at").alias("before")), ["conv_id", "other"]
        )
        late = ends.where("at <= before and at.step <= size").groupBy(*_CONV).agg(F.max("before").alias("before"))
        late = scratch.keep(late, "late")
        if late.isEmpty():
            break
        behind = F.struct("before.turn", "before.place", (F.col("before.step") + 1).alias("step"))
        moved = moved.join(late, _CONV, "left").select(*_CONV, F.when(F.col("before").isNotNull(), behind).otherwise(F.col("at")).alias("at"), "size")
        moved = scratch.keep(moved, "moved")
    stuck = scratch.keep(moved.where("at.step > size").select(*_CONV), "stuck")
    while not stuck.isEmpty():
        refer = edges.join(stuck.withColumnRenamed("call_id", "other"), ["conv_id", "other"], "left_semi").select(*_CONV)
        wider = scratch.keep(stuck.union(refer).distinct(), "stuck")
        if wider.count() == stuck.count():
            break
        stuck = wider
    stuck = stuck.withColumn("cyclic", F.lit(True))
    return (
        calls.join(moved, _CONV).join(stuck, _CONV, "left")
        .select(
            *calls.columns, F.col("at.turn").alias("order_turn"), F.col("at.place").alias("order_place"), F.col("at.step").cast("int").alias("order_step"),
            F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        )
    )


def link_calls(calls: DataFrame, results: DataFrame, tools: Mapping[str, Mapping]) -> DataFrame:
    """One row for each identifier of a conversation that a call or result has.

    ``status`` is linked, unanswered (no result), orphan (no call) or early (a result not after its
    call); ``n_calls`` and ``n_results`` tell of repeated identifiers, of which the first by turn
    counts. ``errors`` lists what the schema finds wrong. ``json`` is the canonical record: sorted
    keys, no spaces, numbers in their shortest form. Rows without identifier or conversation link
    with nothing and are left out. Empty tables give an empty result.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    asked = _first_of(calls.where("conv_id is not null"), ["turn", "place", "name", "arguments"], "n_calls")
    asked = _ordered(scratch.keep(asked, "asked"), scratch)
    told = _first_of(results.where("conv_id is not null"), ["turn", "content"], "n_results").withColumnRenamed("turn", "result_turn")
    joined = asked.join(told.hint("shuffle_hash"), _CONV, "full_outer")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked")
    )
    errors = F.when(F.col("n_calls").isNotNull(), _errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    parsed = F.try_parse_json("arguments")
    # Keys in the order of their names; a variant writes its own keys sorted.
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), F.lit("null")),
        F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("content"), F.lit("}"),
    )
    return joined.select(
        *_CONV, "turn", "result_turn", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "order_turn", "order_place", "order_step",
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.array_join(errors, "; ").alias("errors"), record.alias("json"),
    )


def _quoted(column: str) -> Column:
    """A string as JSON, null as null."""
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
