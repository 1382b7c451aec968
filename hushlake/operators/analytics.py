"""Reports over usage events and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DURATION_BOUNDS, TOKEN_BOUNDS, TOP_CHART, TOP_DIMENSIONS

DIMENSIONS = ("model", "connection", "endpoint", "key_id")


def between(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Rows with since <= ts_unix_ms < until; the comparison reaches the scan."""
    if since is not None:
        df = df.where(F.col("ts_unix_ms") >= since)
    return df if until is None else df.where(F.col("ts_unix_ms") < until)


def _money(c: Column) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), 9)


def _sums() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        _money(F.col("cost_usd")).alias("cost_usd"),
    ]


def summary(usage: DataFrame, since: int | None = None, until: int | None = None, key_id: str | None = None) -> DataFrame:
    """One row of totals; zeros for no event. An event of status 400 or more is an error."""
    rows = between(usage, since, until)
    rows = rows if key_id is None else rows.where(F.col("key_id") == key_id)
    return rows.agg(
        *_sums(),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
        F.count_if("pii").alias("pii_requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
    )


def success_rate(totals: DataFrame) -> DataFrame:
    rate = F.when(F.col("requests") > 0, F.lit(100.0) * (F.col("requests") - F.col("errors")) / F.col("requests")).otherwise(100.0)
    return totals.select("requests", "errors", F.round(rate, 6).alias("success_rate"))


def bucket(unit: str) -> Column:
    """Start of the hour or day, UTC, in epoch milliseconds."""
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts_unix_ms"))).alias("bucket_ms")


def timeseries(usage: DataFrame, unit: str, key_id: str | None = None) -> DataFrame:
    """Totals by hour or day; empty buckets aren't filled in."""
    rows = usage if key_id is None else usage.where(F.col("key_id") == key_id)
    return rows.groupBy(bucket(unit)).agg(*_sums(), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


def series_arrays(series: DataFrame) -> DataFrame:
    """A time series as parallel arrays in order of time, for a chart: one row. Buckets are few: hours or days of a range."""
    row = F.struct("bucket_ms", "requests", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), "cost_usd", "avg_latency_ms")
    s = series.agg(F.array_sort(F.collect_list(row)).alias("s"))
    pick = lambda c: F.transform("s", lambda x: x[c])
    label = F.transform("s", lambda x: F.date_format(F.timestamp_millis(x["bucket_ms"]), "MM-dd"))
    return s.select(F.transform("s", lambda x: F.floor(x["bucket_ms"] / 1000)).alias("x"), label.alias("labels"), pick("requests").alias("requests"), pick("tokens").alias("tokens"), pick("cost_usd").alias("cost"), pick("avg_latency_ms").alias("latency"))


def by_dimension(usage: DataFrame, dimension: str, limit: int = TOP_DIMENSIONS) -> DataFrame:
    """The dimension's values with most requests, ties by label."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"not a dimension: {dimension}")
    rows = usage.groupBy(F.col(dimension).alias("label")).agg(*_sums())
    return rows.orderBy(F.desc("requests"), "label").limit(limit)


def chart_arrays(usage: DataFrame, dimension: str) -> DataFrame:
    top = by_dimension(usage, dimension, TOP_CHART)
    s = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("requests")).alias("r"), "label", "cost_usd"))).alias("s"))
    return s.select(F.transform("s", lambda x: x["label"]).alias("labels"), F.transform("s", lambda x: -x["r"]).alias("requests"), F.transform("s", lambda x: x["cost_usd"]).alias("cost"))


def recent(rows: DataFrame, limit: int, tie: str) -> DataFrame:
    """The latest rows: a top-k, never a full sort."""
    return rows.orderBy(F.desc("ts_unix_ms"), tie).limit(limit)


def pii_by_kind(detections: DataFrame) -> DataFrame:
    rows = detections.groupBy(F.col("entity_kind").alias("label"))
    return rows.agg(F.sum("count").cast("long").alias("requests"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0.0).alias("cost_usd"))


def pii_timeseries(detections: DataFrame, unit: str) -> DataFrame:
    return detections.groupBy(bucket(unit)).agg(F.sum("count").cast("long").alias("entities"))


def histogram(values: DataFrame, column: str, bounds: list[float], *keys: str) -> DataFrame:
    """(keys, le, n): values at or below each bound and above the last; "+Inf" for the rest. Empty buckets aren't filled in."""
    first = F.get(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(column) <= b), F.lit(0))
    le = F.coalesce(first.cast("string"), F.when(F.col(column).isNotNull(), "+Inf"))
    return values.where(F.col(column).isNotNull()).groupBy(*keys, le.alias("le")).agg(F.count("*").alias("n"))


def duration_histogram(usage: DataFrame) -> DataFrame:
    return histogram(usage.withColumn("s", F.col("latency_ms") / 1000.0), "s", DURATION_BOUNDS, "endpoint")


def token_histogram(usage: DataFrame) -> DataFrame:
    return histogram(usage.withColumn("t", F.col("input_tokens").cast("double")), "t", TOKEN_BOUNDS, "endpoint")


def counters(usage: DataFrame) -> DataFrame:
    """Counters by the attributes of a metric: operation, model, connection, and error type."""
    error = F.when(F.col("status") >= 400, F.col("status").cast("string"))
    rows = usage.groupBy("endpoint", "model", "connection", error.alias("error_type"))
    return rows.agg(*_sums(), F.count_if("pii").alias("redactions")).withColumn("redactions", F.when(F.col("redactions") > 0, F.col("redactions")))


def nearest_rank(usage: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n) of n in order.

    Values are counted first, so that a key's group is one row per different value and no list of all
    values is ever made.
    """
    from pyspark.sql import Window

    n = usage.groupBy(key, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy(key)))
    out = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("all")), F.col(value))).alias(name) for name, p in points.items()]
    return n.groupBy(key).agg(F.sum("c").alias("requests"), *out, F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"))


def load_stats(usage: DataFrame) -> DataFrame:
    """Requests, errors and rate per second of each endpoint over its span of time."""
    span = (F.max("ts_unix_ms") - F.min("ts_unix_ms")) / 1000.0
    rate = F.when(span > 0, F.round(F.count("*") / span, 9)).otherwise(0.0)
    return usage.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), rate.alias("rps"), F.round(F.median("latency_ms"), 6).alias("median_ms"))


def named_range(name: str, now: int) -> tuple[int, int, str]:
    """(since, until, bucket) of a range: "24h" by hour, "7d" by day, anything else 30 days by day."""
    day = 86_400_000
    length, unit = {"24h": (day, "hour"), "7d": (7 * day, "day")}.get(name, (30 * day, "day"))
    return now - length, now, unit


def list_users(users: DataFrame) -> DataFrame:
    """(id, username, password_hash) by id; a name or hash that is null is empty."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return users.select("id", text("username"), text("password_hash")).orderBy("id")
