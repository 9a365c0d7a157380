"""Metric samples: rates with counter resets, quantiles of histograms, alerts that must hold, load percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, series: list[str]) -> DataFrame:
    """Growth since the sample before, in ``increase``; a counter that fell was reset and grew from 0. The first of a series has none."""
    before = Window.partitionBy(*series).orderBy("ts")
    was = F.lag("value").over(before)
    return samples.withColumn("increase", F.when(was.isNotNull(), F.when(F.col("value") >= was, F.col("value") - was).otherwise(F.col("value"))))


def rate(samples: DataFrame, series: list[str], seconds: int = 300) -> DataFrame:
    """``rate``: growth per second over the ``seconds`` up to each sample."""
    grown = increases(samples, series).withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")))
    span = Window.partitionBy(*series).orderBy("__s").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return grown.withColumn("rate", F.coalesce(F.sum("increase").over(span), F.lit(0.0)) / seconds).drop("__s", "increase")


def rate_by_step(samples: DataFrame, series: list[str], by: list[str], seconds: int = 300) -> DataFrame:
    """Growth per second in tumbling steps, summed over series to ``by``; no sorted range is kept."""
    grown = increases(samples, series)
    step = F.window("ts", f"{seconds} seconds")["start"]
    return grown.groupBy(*by, step.alias("time")).agg((F.coalesce(F.sum("increase"), F.lit(0.0)) / seconds).alias("rate"))


def held(samples: DataFrame, firing: Column, series: list[str], seconds: int) -> DataFrame:
    """Samples at which ``firing`` has held for ``seconds`` without a break."""
    order = Window.partitionBy(*series).orderBy("ts")
    rows = samples.withColumn("__on", F.coalesce(firing, F.lit(False)))
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("__on"), F.col("ts"))).over(Window.partitionBy(*series, "__run"))
    rows = rows.withColumn("since", since)
    lasted = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return rows.where(F.col("__on") & (lasted >= seconds * 1_000_000)).drop("__on", "__run")


def histogram_quantile(q: float, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation; ``buckets``: ``by``, le (double, +Inf last) and the cumulative value."""
    order = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("__low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("__below", F.coalesce(F.lag("value").over(order), F.lit(0.0)))
    rows = rows.withColumn("__all", F.max("value").over(Window.partitionBy(*by)))
    rank = F.lit(q) * F.col("__all")
    hit = rows.where((F.col("value") >= rank) & (F.col("__all") > 0)).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    inside = F.col("__low") + (F.col("le") - F.col("__low")) * F.when(F.col("value") > F.col("__below"), (rank - F.col("__below")) / (F.col("value") - F.col("__below"))).otherwise(0.0)
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("__low")).otherwise(inside).alias("quantile"))


def _of(samples: DataFrame, name: str) -> DataFrame:
    return samples.where(F.col("name") == name)


def queue_nearly_full(samples: DataFrame, depth: str = "write_queue_depth", capacity: str = "write_queue_capacity", share: float = 0.8, seconds: int = 300) -> DataFrame:
    both = _of(samples, depth).select("ts", F.col("labels.sink").alias("sink"), "value").join(_of(samples, capacity).select("ts", F.col("labels.sink").alias("sink"), F.col("value").alias("capacity")), ["ts", "sink"])
    return held(both, (F.col("capacity") > 0) & (F.col("value") / F.col("capacity") > share), ["sink"], seconds)


def _series(samples: DataFrame) -> DataFrame:
    """``__series``: the whole label set, which tells one series of a metric from another."""
    return samples.withColumn("__series", F.array_sort(F.map_entries("labels")))


def sum_of_rates(samples: DataFrame, by: str, seconds: int = 300) -> DataFrame:
    """``by``, ts and ``rate``: at each sample's time, growth per second over the ``seconds`` up to it, of each label set for itself, summed to label ``by``."""
    grown = increases(_series(samples), ["__series"]).select(F.col("labels")[by].alias(by), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("__s"), "increase")
    at = grown.groupBy(by, "ts", "__s").agg(F.coalesce(F.sum("increase"), F.lit(0.0)).alias("increase"))
    span = Window.partitionBy(by).orderBy("__s").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return at.select(by, "ts", (F.sum("increase").over(span) / seconds).alias("rate"))


def writes_failing(samples: DataFrame, name: str = "writes_total", seconds: int = 600, window: int = 300) -> DataFrame:
    """Sinks whose failed writes, all series together, have grown for ``seconds``."""
    rows = _of(samples, name).where(F.col("labels.outcome") == "failed")
    return held(sum_of_rates(rows, "sink", window), F.col("rate") > 0, ["sink"], seconds)


def enqueue_timeouts(samples: DataFrame, name: str = "enqueue_timeouts_total", seconds: int = 300, window: int = 300) -> DataFrame:
    return held(sum_of_rates(_of(samples, name), "sink", window), F.col("rate") > 0, ["sink"], seconds)


def rules_not_ready(samples: DataFrame, name: str = "rules", seconds: int = 900) -> DataFrame:
    """Samples of a label set that has counted rules which aren't ready for ``seconds``."""
    rows = _of(samples, name).where((F.col("labels.condition") == "Ready") & (F.col("labels.status") == "false"))
    return held(_series(rows), F.col("value") > 0, ["__series"], seconds).drop("__series")


def latest_gauges(samples: DataFrame, name: str, by: str) -> DataFrame:
    """The last value of each label set of a gauge, summed to label ``by``."""
    last = _series(_of(samples, name)).groupBy("__series", F.col("labels")[by].alias(by)).agg(F.max_by("value", "ts").alias("value"))
    return last.groupBy(by).agg(F.sum("value").alias("value"))


def find(samples: DataFrame, name: str, **labels: str) -> DataFrame:
    rows = _of(samples, name)
    for k, v in labels.items():
        rows = rows.where(F.try_element_at("labels", F.lit(k)) == v)
    return rows


def total(samples: DataFrame, name: str, **labels: str) -> DataFrame:
    return find(samples, name, **labels).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def condition_counts(conditions: DataFrame) -> DataFrame:
    """condition, status, rules: how many rules have each status of each condition, zeros included."""
    counted = conditions.groupBy("condition").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("true", "false", "unknown")])
    return counted.select("condition", F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("rules")) for s in ("true", "false", "unknown")])))


def load_percentiles(samples: DataFrame, value: str = "value") -> DataFrame:
    """Exact p50 and p99."""
    return samples.agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.99).alias("p99"))
