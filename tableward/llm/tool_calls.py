"""Chat formatting with tool-call linking. DataFrame and SQL functions only.

Calls and results are linked by a hash join on (conversation, call id), ordered so that every message follows what it depends on, validated
against the schemas of their tools, and written as canonical JSON: keys ascending, no spaces; numbers without an exponent exactly and without
final zeros (to 38 digits), all others as doubles (1e2 is 100.0).

* Linking: a result belongs to the call with its id. A call is ``linked`` or ``pending``, a result ``linked`` or ``orphan``; of several calls
  (or results) with one id the first turn counts, the others are ``duplicate``.
* Order: a call's depth is 0 if it needs no other call, else one more than the deepest call it needs; a result has its call's depth. Each
  level is one join. Calls on a cycle or behind a missing call get no depth and are ``unresolved``. Messages are sorted by (depth, turn, call
  before result), those without depth last, and ``place`` numbers them from 0 within the conversation.
* Plain messages need nothing: kind ``message``, status ``plain``, depth 0, no call id and no errors.
* Validation: arguments against the parameters of the tool. Errors, each kind ascending: ``unknown tool``; ``missing x`` for a required one;
  ``unexpected x``; ``type x``.

A conversation may hold a third of all rows: joins are on (conversation, call id), and places come from counts per range of turns, so no task
holds a whole conversation. The tools are metadata.

Defined cases: a missing id links with nothing; missing arguments are an empty object; arguments that are not one valid JSON object give the error
``not an object`` alone; repeated rows are duplicates; rows without a conversation form one of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tableward.session import keep, new_dir

#: Turns per range in which messages are numbered.
TURNS_PER_RANGE = 1024
#: JSON types and how a variant of that type describes itself.
TYPES = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "string": "STRING", "object": "OBJECT.*", "array": "ARRAY.*"}


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call_id, depth) of the calls whose needs can be met. ``calls`` has (conv, call_id, needs), one row per id, and no missing conv.

    Each level is written as a part of one folder, so the plan is as short after a thousand levels as after one.
    """
    spark, path = calls.sparkSession, new_dir(calls.sparkSession, "calls-levels")
    needs = calls.select("conv", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    needs = keep(needs.filter("need IS NOT NULL"), "calls-needs")
    waiting = needs.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("left"))
    ready = calls.join(waiting, ["conv", "call_id"], "left_anti").select("conv", "call_id")
    kind, waiting, level = ready.schema, keep(waiting, "calls-waiting"), 0
    while True:
        ready.write.parquet(f"{path}/depth={level}")
        ready = spark.read.schema(kind).parquet(f"{path}/depth={level}")
        if ready.isEmpty():
            return spark.read.schema(StructType([*kind, StructField("depth", IntegerType())])).parquet(path)
        level += 1
        met = needs.join(ready.select("conv", F.col("call_id").alias("need")), ["conv", "need"])
        met = met.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("met"))
        now = keep(waiting.join(met, ["conv", "call_id"], "left").select("conv", "call_id", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "calls-waiting")
        ready, waiting = now.filter("left = 0").select("conv", "call_id"), now.filter("left > 0")


def errors_of(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` (with tool and arguments) plus ``json``, the canonical arguments, and ``errors``.

    ``tools`` has (tool, parameter, type, required).
    """
    known = tools.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.struct("parameter", F.struct("type", "required")))).alias("params")
    )
    text = F.coalesce("arguments", F.lit("{}"))
    parsed = calls.withColumn("v", F.try_parse_json(text)).withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    parsed = parsed.withColumn("args", F.when(F.col("is_object"), F.from_json(F.to_json("v"), "map<string,variant>")))
    joined = parsed.join(known, "tool", "left")
    fits = " OR ".join(f"(t = '{name}' AND s RLIKE '^({kind})$')" for name, kind in TYPES.items())
    fits = f"exists(array(named_struct('t', params[a].type, 's', schema_of_variant(args[a]))), x -> {fits.replace('t =', 'x.t =').replace('s RLIKE', 'x.s RLIKE')})"
    errors = f"""CASE WHEN NOT is_object THEN array('not an object')
        WHEN params IS NULL THEN array('unknown tool')
        ELSE concat(
            transform(array_sort(filter(map_keys(params), p -> params[p].required AND NOT map_contains_key(args, p))), p -> concat('missing ', p)),
            transform(array_sort(filter(map_keys(args), a -> NOT map_contains_key(params, a))), a -> concat('unexpected ', a)),
            transform(array_sort(filter(map_keys(args), a -> map_contains_key(params, a) AND NOT {fits})), a -> concat('type ', a))) END"""
    return joined.withColumn("errors", F.expr(errors)).withColumn("json", F.when(F.col("is_object"), F.to_json("v"))).drop("v", "args", "params", "is_object")


def _first_of_id(rows: DataFrame, extra: list[str]) -> DataFrame:
    """The row with the smallest turn of each id. Rows of one id are aggregated before they move."""
    return rows.filter("call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "key", *extra)).alias("first"))


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row per message: conv, place, kind, call_id, turn, depth, status, errors and json, its canonical form.

    ``calls`` has (conv, turn, call_id, tool, arguments, needs), ``results`` (conv, turn, call_id, content), ``messages``, which are neither,
    (conv, turn, role, content).
    """
    # a struct is never null, so rows without a conversation meet each other in every join
    grouped = lambda df: df.withColumn("conv", F.struct(F.col("conv").alias("id")))
    keyed = lambda df: keep(grouped(df).withColumn("key", F.monotonically_increasing_id()), "calls-input")
    calls, results = keyed(errors_of(calls, tools)), keyed(results)
    first_calls = _first_of_id(calls, ["needs"])
    first_results = _first_of_id(results, [])
    depth = depths(first_calls.select("conv", "call_id", "first.needs"))
    ids = first_calls.select("conv", "call_id", F.col("first.key").alias("call_key")).join(
        first_results.select("conv", "call_id", F.col("first.key").alias("result_key")), ["conv", "call_id"], "full"
    )
    ids = keep(ids.join(depth, ["conv", "call_id"], "left"), "calls-ids")

    def state(own: str, other: str, alone: str):
        return (
            F.when(F.col("call_id").isNull(), alone)
            .when(F.col("key") != F.col(own), "duplicate")
            .when(F.col("call_key").isNotNull() & F.col("depth").isNull(), "unresolved")
            .when(F.col(other).isNull(), alone)
            .otherwise("linked")
        )

    call_rows = calls.join(ids, ["conv", "call_id"], "left").select(
        "conv", "turn", "call_id", F.lit("call").alias("kind"), state("call_key", "result_key", "pending").alias("status"), "depth", "errors",
        F.struct(F.coalesce("json", F.to_json(F.struct("arguments"))).alias("arguments"), "tool").alias("body"), F.lit(None).cast("string").alias("content"),
    )
    result_rows = results.join(ids, ["conv", "call_id"], "left").select(
        "conv", "turn", "call_id", F.lit("result").alias("kind"), state("result_key", "call_key", "orphan").alias("status"), "depth",
        F.array().cast("array<string>").alias("errors"), F.lit(None).cast("struct<arguments:string,tool:string>").alias("body"), "content",
    )
    rows = call_rows.unionByName(result_rows)
    # to_json writes members in the order given, here ascending; arguments are canonical already
    call_json = F.concat(F.lit('{"arguments":'), F.col("body.arguments"), F.lit(","), F.substring(F.to_json(F.struct(F.col("call_id").alias("id"), F.col("body.tool").alias("name"), F.lit("call").alias("type"))), F.lit(2), F.lit(2**31 - 1)))
    result_json = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")))
    rows = rows.withColumn("json", F.when(F.col("kind") == "call", call_json).otherwise(result_json)).drop("body", "content")
    if messages is not None:
        rows = rows.unionByName(grouped(messages).select(
            "conv", "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("kind"), F.lit("plain").alias("status"), F.lit(0).alias("depth"),
            F.array().cast("array<string>").alias("errors"), F.to_json(F.struct("content", "role", F.lit("message").alias("type"))).alias("json"),
        ))
    return placed(rows).withColumn("conv", F.col("conv.id"))


def placed(rows: DataFrame) -> DataFrame:
    """``place`` of each message: counts per (depth, range of turns) are summed up, and rows numbered within their range."""
    level = F.coalesce("depth", F.lit(2**31 - 1))
    rows = rows.withColumn("_level", level).withColumn("_range", F.floor(F.coalesce("turn", F.lit(-1)) / TURNS_PER_RANGE))
    rows = keep(rows, "calls-rows")
    counts = rows.groupBy("conv", "_level", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv").orderBy("_level", "_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv").alias("_conv"), F.col("_level").alias("_l"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("conv", "_level", "_range").orderBy("turn", "kind", "call_id", "status", "json")
    numbered = rows.withColumn("_number", F.row_number().over(within))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_level") == F.col("_l")) & (F.col("_range") == F.col("_r"))
    out = numbered.join(counts, same)
    return out.select("conv", (F.col("_before") + F.col("_number") - 1).alias("place"), "kind", "call_id", "turn", "depth", "status", "errors", "json")


#: Tools of the query over the given table; see ``from_turns``.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "exact", "boolean", False),
    ("count", "text", "string", True), ("count", "unit", "string", False),
]


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and tools read from plain conversations, which have no tool calls of their own.

    An assistant's turn t is a call with id ``c<t>``; the turn after it, if it is a user's, is its result. Tool and arguments depend on the
    text only, and the arguments hold the whole of it: of texts with 3 n characters the call needs the call two turns before; the tool is search, count or (one of seven) an unknown
    one; some arguments are missing, unexpected or of another type.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))
    words = F.coalesce("text", F.lit(""))
    limit = F.when(n % 5 == 0, F.to_json(F.struct(n.cast("string").alias("limit")))).otherwise(F.to_json(F.struct(n.alias("limit"))))
    search = F.concat(F.substring(F.to_json(F.struct(words.alias("query"), (n % 2 == 0).alias("exact"))), F.lit(1), F.char_length(F.to_json(F.struct(words.alias("query"), (n % 2 == 0).alias("exact")))) - 1), F.lit(","), F.substring(limit, F.lit(2), F.lit(2**31 - 1)))
    count = F.when(n % 11 == 0, F.to_json(F.struct(words.alias("phrase"), F.lit("word").alias("unit")))).when(n % 13 == 0, F.to_json(F.struct(words.alias("text"), n.alias("size")))).otherwise(F.to_json(F.struct(words.alias("text"), F.lit("word").alias("unit"))))
    tool = F.when(n % 7 == 0, "translate").when(n % 2 == 0, "search").otherwise("count")
    own = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    calls = own.filter("role = 'assistant'").select(
        "conv", "turn", F.concat(F.lit("c"), "turn").alias("call_id"), tool.alias("tool"),
        F.when(tool == "count", count).otherwise(search).alias("arguments"),
        F.when(n % 3 == 0, F.array(F.concat(F.lit("c"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = own.filter("role = 'user' AND turn > 0").select("conv", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    tools = turns.sparkSession.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    return calls, results, tools


def plain_turns(turns: DataFrame) -> DataFrame:
    """The rows of conversations that ``from_turns`` makes neither calls nor results, such as system and opening turns, as messages."""
    used = F.coalesce(F.expr("role = 'assistant' OR (role = 'user' AND turn > 0)"), F.lit(False))
    return turns.filter(~used).select(F.col("conv_id").alias("conv"), "turn", "role", F.col("text").alias("content"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row for every row of conversations."""
    return linked(*from_turns(turns), plain_turns(turns))
