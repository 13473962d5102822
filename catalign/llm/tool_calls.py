"""Tool calls and their results: linked by identifier, ordered, validated, written as canonical JSON.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalign.runtime import stage

# A JSON string "$id" in the arguments stands for the result of that call of the conversation.
REFERENCE = r'"\$([^"\\]+)"'
KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """A sorted array of what is wrong with the arguments of a call.

    ``schemas`` has for each tool its fields as (kind, required). Errors are ``tool`` (not in
    schemas), ``json`` (no JSON object, or a key twice), and ``missing:``, ``type:`` or
    ``unknown:`` with the field. A field whose value is JSON null has the wrong type.
    """
    value = F.try_parse_json(arguments)
    whole = F.schema_of_variant(value)
    out = F.array(F.lit("tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            quoted = field.replace("\\", "\\\\").replace("'", "\\'")
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{quoted}']", "variant"))
            absent = F.when(F.lit(required), F.lit(f"missing:{field}"))
            checks.append(F.when(found.isNull(), absent).when(~found.rlike(KINDS[kind]), F.lit(f"type:{field}")))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        other = F.transform(F.array_except(F.json_object_keys(arguments), known), lambda k: F.concat(F.lit("unknown:"), k))
        every = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), other)
        out = F.when(name == tool, every).otherwise(out)
    return F.sort_array(F.when(whole.rlike("^OBJECT"), out).otherwise(F.array(F.lit("json"))))


def call_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: 0 without references, else one more than the highest referenced call.

    ``calls(conv_id, call_id)`` are distinct, ``edges(conv_id, call_id, parent)`` lead to calls of
    the same conversation. Calls on or behind a cycle aren't returned. Each round settles one level
    and keeps only the edges of calls that are still open, so there are as many rounds as levels.
    """
    by = ["conv_id", "call_id"]
    edges = stage(edges.select(*by, "parent").distinct(), "edges")
    done = calls.select(*by).join(edges, by, "left_anti").withColumn("level", F.lit(0))
    new, left = stage(done, "level"), edges.withColumn("above", F.lit(None).cast("int"))
    found = new
    while True:
        at = new.select("conv_id", F.col("call_id").alias("parent"), F.col("level").alias("own"))
        left = left.join(at, ["conv_id", "parent"], "left").select(
            *by, "parent", F.coalesce("above", "own").alias("above")
        )
        left = stage(left, "open")
        ready = left.groupBy(*by).agg(F.max("above").alias("most"), F.count_if(F.col("above").isNull()).alias("open"))
        new = stage(ready.filter("open = 0").select(*by, (F.col("most") + 1).alias("level")), "level")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        left = left.join(new, by, "left_anti")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and for each result that answers no call.

    ``calls(conv_id, turn, call_id, name, arguments)`` and ``results(conv_id, turn, call_id,
    content)`` belong together by conversation and identifier. Returns ``conv_id, call_id, turn,
    name, level, status, errors, record``:

    * ``level`` is a topological order inside the conversation: a call comes after all whose results
      its arguments reference as ``"$id"``, and a result after its call. Null on or behind a cycle.
    * ``status`` is ``linked``, ``unanswered``, ``orphan`` (a result without call) or ``cycle``.
    * ``errors`` are those of ``argument_errors`` plus ``reference:id`` for references to no call
      of the conversation, joined by commas.
    * ``record`` is JSON without spaces and with sorted keys at every depth: arguments, id, name, result.
      Arguments that aren't valid JSON stand there as a string.

    Of calls that share conversation and identifier, and of results that do, the first by turn,
    name and arguments or content counts, and the number of the others is given as ``copies``.
    A null identifier or conversation links with nothing: such calls are unanswered, such results
    orphans, one row for each. Null arguments are invalid JSON; a null content is an answer
    (null in the record). Extra columns are ignored; empty tables give an empty result.
    """
    by = ["conv_id", "call_id"]
    named = "conv_id is not null and call_id is not null"
    kept = F.struct("turn", "name", "arguments")
    some = calls.select(*by, kept.alias("call"))
    first = some.filter(named).groupBy(*by).agg(F.min("call").alias("call"), (F.count("*") - 1).alias("copies"))
    lone = some.filter(f"not ({named})").select(*by, "call", F.lit(0).cast("bigint").alias("copies"))
    first = stage(first.select(*by, "call.*", "copies"), "calls")
    answers = results.select(*by, F.struct("turn", "content").alias("answer"))
    reply = answers.filter(named).groupBy(*by).agg(F.min("answer").alias("answer"))
    stray = answers.filter(f"not ({named})")

    asked = first.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("parent"))
    known = first.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("exists"))
    asked = stage(asked.join(known, ["conv_id", "parent"], "left"), "references")
    broken = asked.filter("exists is null").groupBy(*by)
    broken = broken.agg(F.sort_array(F.collect_list(F.concat(F.lit("reference:"), "parent"))).alias("broken"))
    levels = call_levels(first, asked.filter("exists"))

    joined = first.join(levels, by, "left").join(broken, by, "left").join(reply.select(*by, F.lit(True).alias("answered"), "answer"), by, "full")
    none = F.lit(None)
    lone = lone.select(
        *by, "call.*", "copies", none.cast("int").alias("level"), none.cast("array<string>").alias("broken"),
        none.cast("boolean").alias("answered"), none.cast(reply.schema["answer"].dataType).alias("answer"),
        F.lit(True).alias("called"),
    )
    stray = stray.select(*by, F.lit(True).alias("answered"), "answer", F.lit(False).alias("called"))
    rows = joined.withColumn("called", F.col("copies").isNotNull()).unionByName(lone).unionByName(stray, allowMissingColumns=True)
    # A call without identifier can be referenced by none and orders first.
    level = F.when(F.col("called") & F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level"))
    status = (
        F.when(~F.col("called"), "orphan")
        .when(level.isNull() & F.col("conv_id").isNotNull(), "cycle")
        .when(F.col("answered"), "linked")
        .otherwise("unanswered")
    )
    wrong = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("broken", F.array().cast("array<string>")))
    parsed = F.to_json(F.try_parse_json("arguments"))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(""))
    field = lambda key, text: F.concat(F.lit(f'"{key}":'), F.when(text == "", F.lit("null")).otherwise(text))
    content = F.when(F.col("answered"), F.col("answer.content"))
    rows = rows.withColumn("content", content)
    record = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(F.col("called"), field("arguments", F.coalesce(parsed, quoted("arguments")))),
            field("id", quoted("call_id")),
            F.when(F.col("called"), field("name", quoted("name"))),
            F.when(F.col("answered"), field("result", quoted("content"))),
        ),
        F.lit("}"),
    )
    return rows.select(
        *by,
        F.when(F.col("called"), F.col("turn")).otherwise(F.col("answer.turn")).alias("turn"),
        "name",
        level.alias("level"),
        status.alias("status"),
        F.when(F.col("called"), F.array_join(wrong, ",")).alias("errors"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        record.alias("record"),
    )
