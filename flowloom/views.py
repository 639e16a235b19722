"""Case tables derived from the star schema, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases are seen as of this day.
AS_OF = "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case for each order; columns are typed and dates nullable."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k, days = F.col("o_orderkey"), lambda e: e.cast("int")
    d = (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, c["c_nationkey"] == n["n_nationkey"])
        .select("*", F.to_date("o_orderdate").alias("dt_received"))
        .withColumn("dt_alloc", F.when(k % 7 != 0, F.date_add("dt_received", days(k % 31))))
        .withColumn("dt_signoff", F.when(k % 5 != 0, F.date_add("dt_alloc", days(k * 13 % 97))))
        .withColumn("dt_close", F.when(k % 6 != 0, F.date_add("dt_signoff", days(k % 11))))
        .withColumn("dt_legal_req_1", F.when(k % 9 == 0, F.date_add("dt_alloc", days(k % 40))))
        .withColumn("dt_legal_approval", F.when(k % 18 == 0, F.date_add("dt_legal_req_1", 14)))
        .withColumn("dt_date_of_order", F.when(k % 50 == 0, F.date_add("dt_alloc", 60)))
    )
    return d.select(
        k.alias("case_id"),
        F.concat(F.lit("S"), F.col("o_custkey") % 40).alias("staff_id"),
        F.concat(F.lit("T"), F.col("o_custkey") % 5).alias("team"),
        (1.0 - 0.2 * (F.col("o_custkey") % 4)).alias("fte"),
        (1 + k % 5).cast("double").alias("weighting"),
        F.col("o_orderpriority").alias("case_type"),
        F.col("c_mktsegment").alias("risk"),
        F.col("n_name").alias("region"),
        F.col("o_orderstatus").alias("status"),
        *("dt_received dt_alloc dt_signoff dt_close dt_legal_req_1 dt_legal_approval dt_date_of_order".split()),
        F.col("dt_legal_req_1").isNotNull().cast("int").alias("needs_legal_review"),
    )


#: The same as a common table expression.
CASES = """cases AS (
  SELECT case_id, staff_id, team, fte, weighting, case_type, risk, region, status, dt_received, dt_alloc, dt_signoff,
    CASE WHEN case_id % 6 <> 0 THEN dt_signoff + CAST(case_id % 11 AS INT) END AS dt_close, dt_legal_req_1,
    CASE WHEN case_id % 18 = 0 THEN dt_legal_req_1 + 14 END AS dt_legal_approval, dt_date_of_order,
    CASE WHEN dt_legal_req_1 IS NOT NULL THEN 1 ELSE 0 END AS needs_legal_review
  FROM (SELECT *, CASE WHEN case_id % 5 <> 0 THEN dt_alloc + CAST(case_id * 13 % 97 AS INT) END AS dt_signoff,
      CASE WHEN case_id % 9 = 0 THEN dt_alloc + CAST(case_id % 40 AS INT) END AS dt_legal_req_1,
      CASE WHEN case_id % 50 = 0 THEN dt_alloc + 60 END AS dt_date_of_order
    FROM (SELECT o_orderkey AS case_id, 'S' || (o_custkey % 40) AS staff_id, 'T' || (o_custkey % 5) AS team,
        1.0::DOUBLE - 0.2::DOUBLE * (o_custkey % 4) AS fte, CAST(1 + o_orderkey % 5 AS DOUBLE) AS weighting,
        o_orderpriority AS case_type, c_mktsegment AS risk, n_name AS region, o_orderstatus AS status,
        CAST(o_orderdate AS DATE) AS dt_received,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 31 AS INT) END AS dt_alloc
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)))"""
