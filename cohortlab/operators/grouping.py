"""Group analytics over the feature table: A1-A14, A16, A18, J1, J4, P6-P8.

All are partial (map-side) aggregates followed by one shuffle on the group key;
the few global scalars (max founded year, base rate) are one-row aggregates
joined back as broadcasts of exactly one row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import age_band, funding_band, funding_band_ord
from cohortlab.operators.dictionaries import long_values, ordered_values
from cohortlab.session import materialize


def grouped_success_rate(df: DataFrame, key: str | Column, min_n: int = C.MIN_COHORT_SIZE,
                         key_name: str | None = None) -> DataFrame:
    """A1: success rate and n per group; null keys dropped (T4); groups below min_n suppressed."""
    kcol = F.col(key) if isinstance(key, str) else key
    name = key_name or (key if isinstance(key, str) else "group_key")
    return (df.select(kcol.alias(name), F.col("label"))
              .where(F.col(name).isNotNull())
              .groupBy(name)
              .agg(F.avg(F.col("label").cast("double")).alias("success_rate"),
                   F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_n))


def top_groups(df: DataFrame, key: str, top_n: int = C.TOP_N_GROUPS,
               min_n: int = C.MIN_COHORT_SIZE) -> DataFrame:
    """A2/A3 + K1: largest groups first (n desc, key asc), head ``top_n`` (a top-k report)."""
    return grouped_success_rate(df, key, min_n).orderBy(F.col("n").desc(), F.col(key).asc()).limit(top_n)


def rate_by_funding_band(df: DataFrame, min_n: int = C.MIN_COHORT_SIZE) -> DataFrame:
    """A4 + K6: bands from the raw dollar column (T1), with the band ordinal for ordering."""
    usd = F.col("funding_total_usd")
    return (df.select(funding_band(usd).alias("funding_band"), funding_band_ord(usd).alias("band_ord"), "label")
              .where(F.col("funding_band").isNotNull())
              .groupBy("funding_band", "band_ord")
              .agg(F.avg(F.col("label").cast("double")).alias("success_rate"),
                   F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_n))


def with_age(df: DataFrame) -> DataFrame:
    """age = max(founded_year) - founded_year (scalar broadcast, J9)."""
    mx = df.agg(F.max("founded_year").alias("_max_year"))
    return (df.crossJoin(F.broadcast(mx))
              .withColumn("age_years", F.col("_max_year") - F.col("founded_year"))
              .withColumn("age_band", age_band(F.col("age_years")))
              .drop("_max_year"))


def rate_by_age_band(df: DataFrame, min_n: int = C.MIN_COHORT_SIZE) -> DataFrame:
    """A5."""
    ordv = F.array_position(F.array(*[F.lit(x) for x in C.AGE_BIN_LABELS]), F.col("age_band")) - 1
    return (with_age(df).where(F.col("age_band").isNotNull())
              .groupBy("age_band")
              .agg(F.first(ordv).cast("int").alias("band_ord"),
                   F.avg(F.col("label").cast("double")).alias("success_rate"),
                   F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_n))


def overall_rate(df: DataFrame) -> DataFrame:
    """A6 (and A14 on the train split)."""
    return df.agg(F.avg(F.col("label").cast("double")).alias("success_rate"),
                  F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Non-null count and share per column, one pass, unpivoted."""
    cols = cols or ["country_code", "primary_category", "funding_total_usd_log1p"]
    agg = df.agg(F.count(F.lit(1)).alias("n_total"), *[F.count(c).alias(c) for c in cols])
    stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (agg.selectExpr("n_total", f"stack({len(cols)}, {stacked}) AS (column_name, n_nonnull)")
               .select("column_name", "n_nonnull", "n_total",
                       (F.col("n_nonnull") / F.col("n_total")).alias("share")))


def build_report(raw: DataFrame, features: DataFrame) -> DataFrame:
    """A8 + P6: one conditional aggregate over the features, plus the raw row count."""
    lab = F.col("label")
    is_train = F.col("split") == "train"
    suspect = F.col("founded_year") < C.SUSPECT_FOUNDED_YEAR
    raw_n = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    rep = features.agg(
        F.count(F.lit(1)).alias("labelled_rows"),
        F.sum(lab).cast("bigint").alias("n_positive"),
        F.count_if(lab == 0).alias("n_negative"),
        F.avg(lab.cast("double")).alias("positive_rate"),
        F.count_if(is_train).alias("train_rows"),
        F.count_if(~is_train).alias("test_rows"),
        F.avg(F.when(is_train, lab.cast("double"))).alias("train_positive_rate"),
        F.avg(F.when(~is_train, lab.cast("double"))).alias("test_positive_rate"),
        F.count_if(suspect).alias("suspect_year_rows"),
        F.avg(suspect.cast("double")).alias("suspect_year_share"),
    )
    return raw_n.crossJoin(rep)


def shown_total(rates: DataFrame) -> DataFrame:
    """Sum of n over the groups that survived suppression."""
    return rates.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("shown_n"))


def top_values(df: DataFrame, cols: list[str], top_n: int = C.TOP_N_CATEGORIES) -> DataFrame:
    """A11 + K2: most frequent values per categorical (count desc, value asc)."""
    stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {stacked}) AS (feature, value)").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def distinct_options(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct sorted options per categorical, as rows (feature, value, ord); no task holds a feature's values."""
    return ordered_values(long_values(df, cols))


def regions_by_country(df: DataFrame) -> DataFrame:
    """Region options per country, most frequent first (n desc, region asc)."""
    counts = (df.where(F.col("country_code").isNotNull() & F.col("region").isNotNull())
                .groupBy("country_code", "region").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("country_code").orderBy(F.col("n").desc(), F.col("region").asc())
    return counts.withColumn("rank", F.row_number().over(w))


def cohort_levels(df: DataFrame) -> DataFrame:
    """Cohort n / rate at (country, category, band), (country, category), (country).

    One GROUPING SETS pass; ``level`` names the granularity.
    """
    usd = F.col("funding_total_usd")
    base = df.select("country_code", "primary_category", funding_band(usd).alias("funding_band"), "label")
    gid = F.grouping_id("country_code", "primary_category", "funding_band")
    return (base.groupingSets([["country_code", "primary_category", "funding_band"],
                               ["country_code", "primary_category"],
                               ["country_code"]],
                              "country_code", "primary_category", "funding_band")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.avg(F.col("label").cast("double")).alias("success_rate"),
                     gid.alias("_gid"))
                .withColumn("level", F.when(F.col("_gid") == 0, F.lit("country+category+funding_band"))
                            .when(F.col("_gid") == 1, F.lit("country+category"))
                            .otherwise(F.lit("country")))
                .drop("_gid"))


def cohort_lookup(requests: DataFrame, train: DataFrame, min_n: int = C.MIN_COHORT_SIZE) -> DataFrame:
    """Progressive back-off per request: first level with n >= min_n, else nulls.

    requests: (request_id, country_code, primary_category, funding_total_usd).
    Equi left joins on the three granularities; a null band never matches (T25).
    The cohort table is bounded by the number of distinct groups, and Spark
    decides broadcast vs shuffle from its size.
    """
    levels = materialize(cohort_levels(train).where(F.col("n") >= min_n), "cohorts")  # read three times
    l1 = levels.where(F.col("level") == "country+category+funding_band").select(
        "country_code", "primary_category", "funding_band",
        F.col("n").alias("n1"), F.col("success_rate").alias("r1"))
    l2 = levels.where(F.col("level") == "country+category").select(
        "country_code", "primary_category", F.col("n").alias("n2"), F.col("success_rate").alias("r2"))
    l3 = levels.where(F.col("level") == "country").select(
        "country_code", F.col("n").alias("n3"), F.col("success_rate").alias("r3"))
    req = requests.withColumn("funding_band", funding_band(F.col("funding_total_usd")))
    j = (req.join(l1, ["country_code", "primary_category", "funding_band"], "left")
            .join(l2, ["country_code", "primary_category"], "left")
            .join(l3, ["country_code"], "left"))
    level = (F.when(F.col("n1").isNotNull(), F.lit("country+category+funding_band"))
             .when(F.col("n2").isNotNull(), F.lit("country+category"))
             .when(F.col("n3").isNotNull(), F.lit("country")))
    return j.select(
        "request_id", "country_code",
        F.when(F.col("n1").isNotNull() | F.col("n2").isNotNull(), F.col("primary_category")).alias("cohort_category"),
        level.alias("level"),
        F.coalesce("n1", "n2", "n3").alias("cohort_n"),
        F.coalesce("r1", "r2", "r3").alias("cohort_success_rate"),
    )


def region_option_table(train: DataFrame) -> DataFrame:
    """A13 + J4 lists: (option_key, rank, region) with option_key = country, or '*'
    for the all-regions fallback; 'UNKNOWN' closes every list. Bounded by the
    number of (country, region) pairs."""
    by_country = regions_by_country(train).select(
        F.col("country_code").alias("option_key"), "region", "rank")
    # The fallback list is ordered alphabetically; the unpartitioned window runs over
    # distinct regions only (a categorical's cardinality, not the row count).
    all_regions = (train.where(F.col("region").isNotNull()).select("region").distinct()
                        .withColumn("rank", F.row_number().over(Window.orderBy("region")))
                        .withColumn("option_key", F.lit("*")))
    opts = by_country.unionByName(all_regions)
    tail = opts.groupBy("option_key").agg((F.max("rank") + 1).alias("rank")).withColumn(
        "region", F.lit("UNKNOWN"))
    return opts.unionByName(tail)


def region_options(requests: DataFrame, train: DataFrame) -> DataFrame:
    """Per request, its country's regions by frequency; an unknown country falls
    back to all regions. One list per option key, so requests stay one row each:
    (request_id, regions)."""
    table = region_option_table(train).groupBy("option_key").agg(F.array_sort(F.collect_list(F.struct("rank", "region"))).alias("r"))
    table = materialize(table.select("option_key", F.transform("r", lambda x: x["region"]).alias("regions")), "regions")
    known = table.select(F.col("option_key").alias("country_code"), F.col("regions").alias("own"))
    every = table.where("option_key = '*'").select(F.col("regions").alias("all"))  # at most one row
    return (requests.select("request_id", "country_code").join(known, "country_code", "left").join(F.broadcast(every), how="left")
                    .select("request_id", F.coalesce("own", "all").alias("regions")))
