"""Series views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import by_time
from ..schema import IDX, TS, UNIT

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SHIP = ["qty", "price", "disc", "tax"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(df: DataFrame) -> DataFrame:
    """Give a dense, 0-based t_idx per unit by time."""
    return df.withColumn(IDX, (F.row_number().over(Window.partitionBy(UNIT).orderBy(TS)) - 1).cast("long"))


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, ts, qty, price, disc, tax, n, t_idx by shipping day."""
    li = read(spark, sf_dir, "lineitem")
    day = li.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 8).alias("disc"), F.round(F.avg("l_tax"), 8).alias("tax"), F.count("*").cast("double").alias("n"),
    )
    return indexed(day.select(F.lit("all").alias(UNIT), F.col("d").cast("timestamp_ntz").alias(TS), *SHIP, "n"))


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, ts, total, n, t_idx by order day (with gaps between days)."""
    day = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").cast("double").alias("n"))
    return indexed(day.select(F.lit("all").alias(UNIT), F.col("d").cast("timestamp_ntz").alias(TS), "total", "n"))


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(UNIT), F.col("ts").cast("timestamp_ntz").alias(TS), F.col("event_type").alias("variable"), "value")


def event_wide(spark: SparkSession, sf_dir: str, bucket: str = "hour") -> DataFrame:
    """Mean value of each event type by time bucket; absent cells are null."""
    e = event_long(spark, sf_dir).withColumn(TS, F.date_trunc(bucket, TS).cast("timestamp_ntz"))
    wide = e.groupBy(TS).pivot("variable", EVENT_TYPES).agg(F.round(F.avg("value"), 6))
    return indexed(wide.withColumn(UNIT, F.lit("all")))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly sums of qty and price by the supplier's region."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    li = read(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    week = li.groupBy(F.col("n_regionkey").cast("string").alias(UNIT), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias(TS))
    return indexed(week.agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X, Z and Y = 0.7 X lagged by 2 + 0.3 Z, from the standardised shipping series."""
    w, d = Window.partitionBy(UNIT), ship_daily(spark, sf_dir)
    z = lambda c: F.round((F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w), 8)
    d = d.select(UNIT, TS, IDX, z("qty").alias("X"), z("price").alias("Z"))
    d = d.withColumn("Y", F.round(0.7 * F.lag("X", 2).over(by_time()) + 0.3 * F.col("Z"), 8)).where("Y is not null")
    return d.select(UNIT, TS, (F.col(IDX) - 2).alias(IDX), "X", "Y", "Z")


#: The same views for DuckDB.
SQL = {
    "ship_daily": """ship_daily AS (SELECT 'all' AS unit_id, d AS ts, qty, price, disc, tax, n, row_number() OVER (ORDER BY d) - 1 AS t_idx FROM (
  SELECT CAST(l_shipdate AS DATE) AS d, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 8) AS disc, round(avg(l_tax), 8) AS tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1))""",
    "order_daily": """order_daily AS (SELECT 'all' AS unit_id, d AS ts, total, n, row_number() OVER (ORDER BY d) - 1 AS t_idx FROM (
  SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1))""",
    "event_wide": """event_wide AS (SELECT 'all' AS unit_id, h AS ts, row_number() OVER (ORDER BY h) - 1 AS t_idx, click, error, purchase, signup, "view" FROM (
  SELECT date_trunc('hour', ts) AS h, """ + ", ".join(f"""round(avg(value) FILTER (event_type = '{e}'), 6) AS "{e}\"""" for e in EVENT_TYPES) + """ FROM events GROUP BY 1))""",
    "ship_panel": """ship_panel AS (SELECT u AS unit_id, w AS ts, qty, price, row_number() OVER (PARTITION BY u ORDER BY w) - 1 AS t_idx FROM (
  SELECT CAST(n_regionkey AS VARCHAR) AS u, date_trunc('week', l_shipdate) AS w, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2))""",
    "planted": """zs AS (SELECT unit_id, ts, t_idx, round((qty - avg(qty) OVER ()) / stddev_pop(qty) OVER (), 8) AS "X", round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 8) AS "Z" FROM ship_daily),
planted AS (SELECT unit_id, ts, t_idx - 2 AS t_idx, "X", round(0.7 * x2 + 0.3 * "Z", 8) AS "Y", "Z" FROM (SELECT *, lag("X", 2) OVER (ORDER BY t_idx) AS x2 FROM zs) WHERE x2 IS NOT NULL)""",
}


def sql(*names: str) -> str:
    """A WITH clause of the views."""
    need = [n for n in ("ship_daily", "order_daily", "event_wide", "ship_panel", "planted") if n in names or (n == "ship_daily" and "planted" in names)]
    return "WITH " + ",\n".join(SQL[n] for n in need)
