"""Queries that join on time: as-of, ranges, and the sections of dates in a period."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import timejoin
from tessella.runtime import read_table as t

HOUR = 3_600_000_000


def _events(spark, d, kind: str, name: str):
    e = t(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))


def asof(spark, d):
    """Each purchase with the user's last click before it, none older than two days."""
    return timejoin.asof_join(_events(spark, d, "purchase", "purchase"), _events(spark, d, "click", "click"), ["user_id"], "purchase_ts", "click_ts", ["click_id"], most=48 * HOUR)


def intervals(spark, d):
    """Errors within each purchase's span, of one hour to ten days by its number, whoever made them; how many, and the first."""
    spans = _events(spark, d, "purchase", "purchase").drop("user_id").withColumn("until", F.expr("purchase_ts + make_dt_interval(0, 1 + 239 * CAST(purchase_id % 50 = 0 AS INT))"))
    met = timejoin.interval_summary(spans, _events(spark, d, "error", "error").drop("user_id"), [], ("purchase_ts", "until"), "error_ts", "error_id")
    return met.groupBy("purchase_id").agg(F.sum("n").alias("n"), F.min("least").alias("first_error"))


PERIODS = [(1, "1995-01-10", "1995-02-03"), (2, "2001-06-01", None), (3, "1998-05-05", "1998-05-05"), (4, "1990-01-01", "1990-12-31")]


def temporal_sections(spark, d):
    """Dates of orders in some periods, one without an end, with the customers (as sections) that each date leads to."""
    periods = spark.createDataFrame(PERIODS, "period int, since string, until string").select("period", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"))
    dates = t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("section")).distinct()
    met = timejoin.interval_join(periods, dates, [], ("since", "until"), ("date", "date"), 30)
    return met.groupBy("period", "date").agg(F.count("*").alias("sections"), F.min("section").alias("first_section")).withColumn("date", F.col("date").cast("string"))


def percentiles(spark, d):
    """Quantiles of values by type from a mergeable sketch, within a hundredth of the rows by rank; shown to be within it."""
    e = t(spark, d, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("q"), F.count("*").alias("n"))
    each = e.select("event_type", "n", F.posexplode("q").alias("i", "value"))
    ranks = each.join(t(spark, d, "events").select("event_type", F.col("value").alias("v")), "event_type").groupBy("event_type", "n", "i").agg(F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("below"))
    return ranks.select("event_type", ((F.col("i") + 1) / 4.0).alias("quantile"), (F.abs(F.col("below") / F.col("n") - (F.col("i") + 1) / 4.0) <= 0.01).alias("close"))


QUERIES = {
    "asof_join": (asof, """
WITH p AS (SELECT user_id, event_id AS purchase_id, ts AS purchase_ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id AS click_id, ts AS click_ts FROM events WHERE event_type = 'click'),
j AS (SELECT p.*, CASE WHEN purchase_ts - click_ts <= INTERVAL 48 HOURS THEN click_id END AS click_id, CASE WHEN purchase_ts - click_ts <= INTERVAL 48 HOURS THEN click_ts END AS click_ts FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.purchase_ts >= c.click_ts)
SELECT user_id, purchase_id, purchase_ts, click_id, click_ts FROM j"""),
    "interval_join": (intervals, """
WITH p AS (SELECT event_id AS purchase_id, ts AS a, ts + to_hours(1 + 239 * (event_id % 50 = 0)::INT) AS b FROM events WHERE event_type = 'purchase')
SELECT purchase_id, count(*) AS n, min(event_id) AS first_error FROM p JOIN events e ON e.event_type = 'error' AND e.ts BETWEEN a AND b GROUP BY 1"""),
    "temporal_sections": (temporal_sections, f"""
WITH p(period, since, until) AS (VALUES {', '.join(f"({n}, DATE '{a}', {f"DATE '{b}'" if b else 'NULL'})" for n, a, b in PERIODS)}), o AS (SELECT DISTINCT o_orderdate::DATE AS date, o_custkey AS section FROM orders)
SELECT period, date::VARCHAR AS date, count(*) AS sections, min(section) AS first_section FROM p JOIN o ON date >= since AND (until IS NULL OR date <= until) GROUP BY 1, 2"""),
    "percentile_approx": (percentiles, "SELECT event_type, (i.i / 4.0)::DOUBLE AS quantile, true AS close FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([1, 2, 3]) AS i) i"),
}
