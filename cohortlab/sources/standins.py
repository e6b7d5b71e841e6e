"""Stand-in views over the driver's tables.

The reference's own raw company CSV is not available, so a company-shaped table is
derived from orders / lineitem / customer / nation / region / part (one company per
order). The rules are fixed and mirrored one to one by the DuckDB
oracle text in ``cohortlab.plans.oracle``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.sources.tables import table


def companies_raw(spark: SparkSession, sf_dir: str, first_category: bool = False) -> DataFrame:
    """Raw, all-string company records (the reference's 14-column CSV shape), one per order.

    ``first_category`` keeps only the first entry of ``category_list``, which is all that the features
    use: a partial aggregate, where the full list gathers an order's lines in one place.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # Per-order aggregate: lineitem is the big side; it is shuffled once on l_orderkey
    # and the orders join below reuses that partitioning. Groups are orders (bounded
    # by the number of lines per order).
    per_order = (
        li.join(part, li.l_partkey == part.p_partkey, "left")
        .groupBy("l_orderkey")
        .agg(
            (F.min_by("p_type", F.when(F.col("p_type").isNotNull(), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))) if first_category
             else F.expr("listagg(p_type, '|') WITHIN GROUP "
                         "(ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)")).alias("category_list"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("usd"),
            F.count(F.lit(1)).alias("n_lines"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")

    k = F.col("o_orderkey")
    positive = (
        ((F.col("o_orderstatus") == "O") & (k % 5 >= 1))
        | ((F.col("o_orderstatus") == "F") & ((k % 5 == 4) | (F.col("c_nationkey") < 5)))
    )
    status = (
        F.when(F.col("o_orderstatus") == "P", F.lit("operating"))
        .when(positive, F.when(k % 4 == 0, F.lit("ipo")).otherwise(F.lit("acquired")))
        .otherwise(F.lit("closed"))
    )
    mult = (F.when(k % 5 == 0, F.lit(0.1).cast("decimal(2,1)"))
            .when(k % 5 == 1, F.lit(1).cast("decimal(5,1)"))
            .when(k % 5 == 2, F.lit(10).cast("decimal(5,1)"))
            .when(k % 5 == 3, F.lit(100).cast("decimal(5,1)"))
            .otherwise(F.lit(1000).cast("decimal(5,1)")))
    # an order without lines is a company without a known amount, first funded on its order date
    day = lambda c: F.coalesce(F.col(c), F.col("o_orderdate")).cast("date").cast("string")
    funding = F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") | F.col("usd").isNull(), F.lit("-")).otherwise(
        (F.col("usd") * mult).cast("string"))
    founded = (
        F.when(k % 4 == 1, F.lit(None).cast("string"))
        .when(k % 97 == 0, F.lit("1015-01-30"))
        .when(k % 101 == 0, F.lit("2914-01-01"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string"))
    )
    return (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
        .join(cust, orders.o_custkey == cust.c_custkey, "left")
        .join(geo, F.col("c_nationkey") == geo.n_nationkey, "left")
        .select(
            F.concat(F.lit("/o/"), k.cast("string")).alias("permalink"),
            k.cast("string").alias("name"),
            F.lit(None).cast("string").alias("homepage_url"),
            F.col("category_list"),
            funding.alias("funding_total_usd"),
            status.alias("status"),
            F.col("n_name").alias("country_code"),
            F.lit(None).cast("string").alias("state_code"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("city"),
            F.coalesce("n_lines", F.lit(0)).cast("string").alias("funding_rounds"),
            founded.alias("founded_at"),
            day("first_ship").alias("first_funding_at"),
            day("last_ship").alias("last_funding_at"),
        )
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, score) stand-in: a fixed arithmetic score with many ties.

    label = event is a purchase or signup; score = ((event_id*7919) % 1000) / 1000.
    ``score_key`` is the integer cell key so engines agree exactly on ties.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    skey = (F.col("event_id") * 7919) % 1000
    return ev.select(
        F.col("event_id").alias("key"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
        skey.cast("int").alias("score_key"),
        (skey.cast("double") / F.lit(1000.0)).alias("score"),
    )
