"""Chat formatting: tool calls are linked to their results, ordered, validated and serialised.

Calls and results are hash-joined by conversation and identifier. The depth of a call in
the order its parents impose is found by pointer doubling, so a chain of n calls takes
about log2(n) joins. Arguments are validated against the tool's parameters, and every
message is canonical JSON: keys sorted, no white space, numbers in their shortest form.
Only DataFrame and SQL functions run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.llm.common import materialize

TOOLS = "name string, params array<struct<param: string, type: string, required: boolean>>"


def type_fits(found: Column, wanted: Column) -> Column:
    """Whether a variant's schema is of a JSON schema type."""
    whole = found.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    return (F.when(wanted == "string", found == "STRING").when(wanted == "integer", whole)
            .when(wanted == "number", whole | found.startswith("DECIMAL") | (found == "DOUBLE"))
            .when(wanted == "boolean", found == "BOOLEAN").when(wanted == "object", found.startswith("OBJECT"))
            .when(wanted == "array", found.startswith("ARRAY")).when(wanted == "null", found == "VOID").otherwise(F.lit(False)))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): parents on the way to a call without one; null on a cycle or below it.

    ``calls`` has one row per (conv_id, call_id) and parent_id, which is null or names a row."""
    up = materialize(calls.select("conv_id", "call_id", F.col("parent_id").alias("top"),
                                  F.col("parent_id").isNotNull().cast("long").alias("depth")), "depths")
    left = -1
    while True:
        open_ = up.where("top is not null").count()
        if open_ == 0 or open_ == left:  # only cycles do not shrink any more
            return up.select("conv_id", "call_id", F.when(F.col("top").isNull(), F.col("depth")).alias("depth"))
        left = open_
        over = up.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        moved = up.where("top is not null").alias("a").join(
            over.alias("b"), (F.col("a.top") == F.col("b.top")) & F.col("a.conv_id").eqNullSafe(F.col("b.c2")))
        moved = moved.select("a.conv_id", "a.call_id", F.col("b.next").alias("top"), (F.col("a.depth") + F.col("b.more")).alias("depth"))
        up = materialize(up.where("top is null").unionByName(moved), "depths")


def parted(rows: DataFrame, least: Column, *own: str) -> tuple[DataFrame, DataFrame]:
    """(the row of each conv_id and call_id with the least ``least``, all others): identical rows with
    an identifier are one, those without are kept as given. ``repeated`` tells whether another row has the identifier."""
    key = ["conv_id", "call_id"]
    rows = rows.select(*key, *own)
    distinct = materialize(rows.where("call_id is not null").groupBy(*key, *own).agg(F.count("*").alias("n")), "distinct")
    first = materialize(distinct.groupBy(*key).agg(F.min_by(F.struct(*own), least).alias("x"), F.sum("n").alias("n"))
                        .select(*key, "x.*", (F.col("n") > 1).alias("repeated")), "first")
    # by the whole row, so that an identifier of very many rows is dealt out
    taken = first.select(*(F.col(c).alias(f"_{c}") for c in (*key, *own)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, *own)]
    more = distinct.drop("n").join(taken, same, "left_anti").withColumn("repeated", F.lit(True))
    return first, more.unionByName(rows.where("call_id is null").withColumn("repeated", F.lit(False)))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call with the result linked to it, and one per result linked to no call.

    ``calls``: conv_id, call_id, parent_id (the call that must come before, or null), name,
    arguments (JSON). ``results``: conv_id, call_id, content. ``tools``: see TOOLS. Returned:
    conv_id, call_id, depth (calls ordered by depth and call_id follow their parents), name,
    status (ok, invalid, no_result, orphan_result), errors (sorted, joined by "; ") and message.

    Identical rows with an identifier are one. Of calls that repeat an identifier the least by
    (name, arguments, parent) is linked with the least of its results' contents (null last) and
    is the one that children follow; the other calls are rows without a result, the other
    results orphans, and the repetition is an error of all. A parent that is no call of the
    conversation, and a cycle (depth null), are errors. Rows without call_id link with nothing
    and are all kept: such calls have an error and no depth, such results are orphans. A null
    conv_id is a conversation of its own. Null arguments are no JSON. Of a tool that is listed
    more than once the least list of parameters counts. Empty tables give what the others say. Other columns are not read, whatever their names."""
    calls = calls.select("conv_id", "call_id", "name", "arguments", F.col("parent_id").alias("wanted"))
    one_call, more_calls = parted(calls, F.struct("name", "arguments", "wanted"), "name", "arguments", "wanted")
    one_result, more_results = parted(results, F.struct(F.col("content").isNull(), "content"), "content")

    parents = one_call.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("p2"))
    known = (one_call.where("wanted is not null")
             .join(parents, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("wanted") == F.col("p2")), "left")
             .select("conv_id", "call_id", F.col("p2").alias("parent_id"))
             .unionByName(one_call.where("wanted is null").select("conv_id", "call_id", F.col("wanted").alias("parent_id"))))
    order = depths(known).select(F.col("conv_id").alias("c3"), F.col("call_id").alias("parent_id"), F.col("depth").alias("above"))

    every = one_call.withColumn("first", F.lit(True)).unionByName(more_calls.withColumn("first", F.lit(False)))
    below = every.where("wanted is not null").join(
        order, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("wanted") == F.col("parent_id")), "left").drop("c3")
    placed = below.unionByName(every.where("wanted is null"), allowMissingColumns=True)
    own = F.when(F.col("parent_id").isNull(), F.lit(0).cast("long")).when(F.col("parent_id") != F.col("call_id"), F.col("above") + 1)
    placed = placed.withColumn("depth", F.when(F.col("call_id").isNotNull(), own)).drop("above")

    schema = tools.groupBy("name").agg(F.min("params").alias("params"), F.lit(True).alias("known"))
    checked = (placed.join(schema.withColumnRenamed("name", "tool"), F.col("name") == F.col("tool"), "left").drop("tool")
               .withColumn("is_call", F.lit(True)))
    res = one_result.select(F.col("conv_id").alias("c4"), F.col("call_id").alias("i4"), "content",
                            F.col("repeated").alias("result_repeated"))
    both = checked.where("first").hint("shuffle_hash").join(
        res, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("call_id") == F.col("i4")), "full_outer")
    alone = more_results.select(F.col("conv_id").alias("c4"), F.col("call_id").alias("i4"), "content",
                                F.col("repeated").alias("result_repeated"))
    both = both.unionByName(checked.where("not first"), allowMissingColumns=True).unionByName(alone, allowMissingColumns=True)

    value = F.try_parse_json("arguments")
    both = both.select(
        F.when(F.col("is_call"), F.col("conv_id")).otherwise(F.col("c4")).alias("conv_id"), F.coalesce("call_id", "i4").alias("call_id"),
        "depth", "name", "arguments", "wanted", "parent_id", "repeated", "content", "result_repeated", "known", "is_call",
        F.coalesce("params", F.expr("cast(array() as array<struct<param: string, type: string, required: boolean>>)")).alias("params"),
        value.alias("value"), F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')").alias("fields"))

    def note(test: Column, text: str) -> Column:
        return F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    call, fields = F.col("is_call").isNotNull(), F.col("fields")
    typed = F.expr("transform_values(fields, (k, v) -> schema_of_variant(v))")
    both = both.withColumn("types", typed)
    missing = F.transform(F.filter("params", lambda p: p.required & ~F.map_contains_key(fields, p.param)), lambda p: F.concat(F.lit("missing "), p.param))
    wrong = F.transform(F.filter("params", lambda p: F.map_contains_key(fields, p.param) & ~type_fits(F.element_at("types", p.param), p.type)),
                        lambda p: F.concat(F.lit("wrong type "), p.param))
    unknown = F.transform(F.filter(F.map_keys(fields), lambda k: ~F.exists("params", lambda p: p.param == k)), lambda k: F.concat(F.lit("unknown "), k))
    none = F.array().cast("array<string>")
    errors = F.concat(
        note(call & F.col("call_id").isNull(), "no identifier"), note(call & F.col("repeated"), "repeated call"),
        note(F.col("result_repeated"), "repeated result"), note(call & F.col("known").isNull(), "unknown tool"),
        note(call & F.col("value").isNull(), "arguments are not JSON"),
        note(call & F.col("value").isNotNull() & fields.isNull(), "arguments are not an object"),
        note(call & F.col("wanted").isNotNull() & F.col("parent_id").isNull(), "unknown parent"),
        note(call & F.col("call_id").isNotNull() & F.col("depth").isNull(), "cycle"),
        F.when(F.col("known") & fields.isNotNull(), F.concat(missing, wrong, unknown)).otherwise(none))
    message = F.to_json(F.struct(
        F.when(fields.isNotNull(), F.col("value")).alias("arguments"), "depth", F.col("call_id").alias("id"), "name",
        F.col("parent_id").alias("parent"), F.when(fields.isNull(), F.col("arguments")).alias("raw_arguments"),
        F.col("content").alias("result"), F.when(call, "tool_call").otherwise("tool_result").alias("type")))
    status = (F.when(~call, "orphan_result").when(F.col("errors") != "", "invalid").when(F.col("result_repeated").isNull(), "no_result").otherwise("ok"))
    return (both.withColumn("errors", F.array_join(F.sort_array(errors), "; "))
            .select("conv_id", "call_id", "depth", "name", status.alias("status"), "errors", message.alias("message")))
