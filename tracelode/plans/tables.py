"""The engine's logical tables bound to the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..session import table

#: Priced event types of providers: input, output, cache read, 5-minute and 1-hour cache writes in dollars a million tokens; None is unknown.
PRICES = (
    ("p0", "view", 1.0, 2.0, 0.5, 1.25, 2.0),
    ("p1", "view", 2.0, 4.0, None, 1.25, 2.0),
    ("p0", "click", 3.0, 15.0, None, 3.75, 6.0),
    ("p2", "click", 0.5, 2.5, 0.125, 0.75, 1.0),
    ("p1", "purchase", 0.0, 10.0, 0.25, None, None),
    ("p2", "error", 1.0, 8.0, 0.25, 1.0, 1.5),
    ("p0", "refund", 1.0, 1.0, 1.0, 1.0, 1.0),
)
RATES = ("r_input", "r_output", "r_cache_read", "r_write_5m", "r_write_1h")
TOKENS = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("tokens_used"), F.count("*").alias("logs_count"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.col("o_custkey").cast("string").alias("cwd"),
        F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "low").alias("reasoning_effort"),
        (F.col("o_orderstatus") == "F").alias("archived"),
        F.col("o_orderstatus").alias("status"),
        epoch_seconds(F.col("o_orderdate")).alias("updated_at"),
    )
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("provider"), F.col("c_name").alias("title"))
    rows = orders.join(used, "id", "left").join(customers, "o_custkey")
    return rows.select("provider", "id", "cwd", "title", "model", "reasoning_effort", "archived", "status", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("logs_count", F.lit(0)).alias("logs_count"), F.col("updated_at").alias("created_at"), "updated_at")


SESSIONS = """sessions as (
  select c_mktsegment as provider, o_orderkey as id, cast(o_custkey as varchar) as cwd, c_name as title, o_orderpriority as model,
    case when o_orderpriority like '1%' then 'high' when o_orderpriority like '2%' then 'low' end as reasoning_effort,
    o_orderstatus = 'F' as archived, o_orderstatus as status, coalesce(tokens, 0) as tokens_used, coalesce(logs, 0) as logs_count,
    cast(floor(epoch(o_orderdate)) as bigint) as created_at, cast(floor(epoch(o_orderdate)) as bigint) as updated_at
  from orders join customer on o_custkey = c_custkey
  left join (select l_orderkey, cast(sum(l_quantity) as bigint) as tokens, count(*) as logs from lineitem group by 1) on o_orderkey = l_orderkey)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """A row for each event with token counts, some of them invalid or undated."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.floor("value").cast("long").alias("v"), k.alias("k"))
    write = F.col("k") % 20
    return e.select(
        "event_id",
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"),
        F.col("user_id").alias("session"),
        F.concat(F.lit("/w/"), F.col("user_id") % 10).alias("cwd"),
        F.col("event_type").alias("model"),
        epoch_seconds(F.col("ts")).alias("at"),
        F.when(F.col("event_id") % 50 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("v").alias("input"),
        (F.col("k") * 2).alias("output"),
        F.when(F.col("k") % 7 == 0, 0).otherwise(F.col("k")).cast("long").alias("cache_read"),
        write.alias("cache_write"),
        F.when(F.col("event_id") % 97 == 0, write + 1).otherwise(F.floor(write / 2)).cast("long").alias("cache_write_1h"),
        F.col("k").alias("reasoning"),
    )


USAGE = """usage as (
  select event_id, 'p' || (user_id % 3) as provider, user_id as session, '/w/' || (user_id % 10) as cwd, event_type as model,
    cast(floor(epoch(ts)) as bigint) as at, case when event_id % 50 <> 0 then strftime(ts, '%Y-%m-%d') end as date,
    v as input, k * 2 as output, case when k % 7 = 0 then 0 else k end as cache_read, k % 20 as cache_write,
    case when event_id % 97 = 0 then k % 20 + 1 else (k % 20) // 2 end as cache_write_1h, k as reasoning
  from (select *, cast(floor(value) as bigint) as v, cast(json_extract(props, '$.k') as bigint) as k from events))"""


def prices(spark: SparkSession) -> DataFrame:
    """A few rows from a price book."""
    return spark.createDataFrame(list(PRICES), "provider string, model string, " + ", ".join(f"{r} double" for r in RATES))


PRICE = f"""price as (select * from (values {", ".join("(" + ", ".join("null" if x is None else repr(x) for x in row) + ")" for row in PRICES)}) as t(provider, model, {", ".join(RATES)}))"""


def transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), "role", "text")


TRANSCRIPT = "transcript as (select conv_id as session, turn as idx, role, text from conversations)"
