"""Usage events, the fact table, derived from the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("key_id", T.StringType(), False),
        T.StructField("endpoint", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("connection", T.StringType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("latency_ms", T.LongType(), False),
        T.StructField("pii", T.BooleanType(), False),
        T.StructField("streamed", T.BooleanType(), False),
        T.StructField("fallback_attempts", T.IntegerType(), False),
        T.StructField("ts_unix_ms", T.LongType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

MODELS = ["alpha-large", "alpha-mini", "beta-2", "gamma-1", "alpha-large-v2"]
PRICES = [("alpha-large", 2.5, 10.0), ("alpha-*", 0.5, 1.5), ("alpha-large*", 2.0, 8.0), ("beta-*", 3.0, 15.0)]

SQL = """usage_events as (
  select 'req-' || event_id as request_id, 'vk-' || (user_id % 8) as key_id,
    case when event_type in ('view', 'click') then 'chat_completions' when event_type in ('purchase', 'error') then 'messages' else 'embeddings' end as endpoint,
    case user_id % 5 when 0 then 'alpha-large' when 1 then 'alpha-mini' when 2 then 'beta-2' when 3 then 'gamma-1' else 'alpha-large-v2' end as model,
    'conn-' || (event_id % 3) as connection,
    case when event_type = 'error' then 500 else 200 end as status,
    case when event_id % 17 <> 0 then cast(json_extract_string(props, '$.k') as bigint) * 10 end as input_tokens,
    case when event_id % 17 <> 0 then cast(json_extract_string(props, '$.k') as bigint) * 3 end as output_tokens,
    cast(floor(value * 10) as bigint) as latency_ms,
    event_id % 5 = 0 as pii, event_id % 2 = 0 as streamed, cast(event_id % 3 as integer) as fallback_attempts,
    epoch_us(ts) // 1000 as ts_unix_ms, event_id, user_id, event_type
  from events),
priced as (
  select *, case model when 'alpha-large' then 2.5 when 'alpha-mini' then 0.5 when 'beta-2' then 3.0 when 'alpha-large-v2' then 2.0 end as price_in,
    case model when 'alpha-large' then 10.0 when 'alpha-mini' then 1.5 when 'beta-2' then 15.0 when 'alpha-large-v2' then 8.0 end as price_out
  from usage_events),
costed as (
  select *, cast(input_tokens as double) / 1000000.0 * cast(price_in as double) + cast(output_tokens as double) / 1000000.0 * cast(price_out as double) as cost_usd
  from priced)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def from_events(e: DataFrame) -> DataFrame:
    """Usage events without a cost, from rows (event_id, ts, user_id, event_type, value, props)."""
    k = F.get_json_object("props", "$.k").cast("long")
    known = F.col("event_id") % 17 != 0
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 5).cast("int"))
    return e.select(
        F.concat(F.lit("req-"), "event_id").alias("request_id"),
        F.concat(F.lit("vk-"), F.col("user_id") % 8).alias("key_id"),
        F.when(F.col("event_type").isin("view", "click"), "chat_completions").when(F.col("event_type").isin("purchase", "error"), "messages").otherwise("embeddings").alias("endpoint"),
        model.alias("model"),
        F.concat(F.lit("conn-"), F.col("event_id") % 3).alias("connection"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.when(known, k * 10).alias("input_tokens"),
        F.when(known, k * 3).alias("output_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        (F.col("event_id") % 5 == 0).alias("pii"),
        (F.col("event_id") % 2 == 0).alias("streamed"),
        (F.col("event_id") % 3).cast("int").alias("fallback_attempts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_unix_ms"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metering import with_cost

    return with_cost(from_events(events(spark, sf_dir)), PRICES)
