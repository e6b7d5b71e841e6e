"""Named queries: sources, ETL, projections and group analytics (S*, P*, A*, J1/J4, O*)."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import funding_band, funding_band_ord
from cohortlab.operators import features as fe
from cohortlab.operators import grouping as gr
from cohortlab.plans.registry import query
from cohortlab.session import ensure_checkpoint_dir
from cohortlab.sources import tables as tb
from cohortlab.sources.standins import companies_raw


def features_of(spark, sf_dir, keep_dates=False, columns=None, whole_categories=False):
    """The feature table; ``columns`` limits it (and the scans behind it) to the named features, label and split."""
    return fe.build_features(companies_raw(spark, sf_dir, first_category=not whole_categories), keep_dates=keep_dates, columns=columns)


FEATURE_COLS_SQL = ", ".join(
    "round(funding_total_usd_log1p, 9) AS funding_total_usd_log1p" if c == "funding_total_usd_log1p" else c
    for c in fe.FEATURE_COLUMNS + ["split"])

# ---------------------------------------------------------------- sources / contracts


@query("s1_companies_raw", ["companies_raw"], "SELECT * FROM companies_raw")
def s1_companies_raw(spark, sf_dir):
    """The raw all-string company table (14 columns, contract checked)."""
    return fe.check_columns(companies_raw(spark, sf_dir))


@query("s2_funding_rounds_cast", ["companies_raw"],
       "SELECT permalink, CAST(funding_rounds AS DOUBLE) AS funding_rounds FROM companies_raw")
def s2_funding_rounds_cast(spark, sf_dir):
    """Strict numeric cast of funding_rounds (garbage fails the job)."""
    from cohortlab.functions.columns import strict_double
    raw = companies_raw(spark, sf_dir)
    return raw.select("permalink", strict_double(F.col("funding_rounds"), "funding_rounds").alias("funding_rounds"))


@query("s3_feature_table", ["features"], f"SELECT {FEATURE_COLS_SQL} FROM features")
def s3_feature_table(spark, sf_dir):
    """S3/P5: the full feature table with split (E1 end to end).

    log1p is rounded to 9 decimals for the comparison only (engines differ in the last bit).
    """
    f = features_of(spark, sf_dir, whole_categories=True)
    return f.withColumn("funding_total_usd_log1p", F.round("funding_total_usd_log1p", 9))


@query("p1_funding_usd", ["companies_raw"], """
  SELECT permalink, CASE WHEN trim(funding_total_usd) = '-' THEN NULL
                         ELSE CAST(replace(trim(funding_total_usd), ',', '') AS DOUBLE) END AS funding_total_usd
  FROM companies_raw""")
def p1_funding_usd(spark, sf_dir):
    """P1: '-' -> null, commas dropped, strict parse."""
    raw = companies_raw(spark, sf_dir)
    return raw.select("permalink", fe.funding_usd(F.col("funding_total_usd")).alias("funding_total_usd"))


@query("p1_funding_parse_report", ["companies_raw"], """
  WITH bad AS (SELECT 'n/a ' || name AS v FROM companies_raw WHERE CAST(name AS BIGINT) % 50 = 0)
  SELECT (SELECT count(*) FROM bad) AS n_bad, (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT v FROM bad ORDER BY v LIMIT 10)) AS examples""")
def p1_funding_parse_report(spark, sf_dir):
    """P1 report variant: count of unparseable funding values (every fiftieth company gets one) and up to 10 examples."""
    raw = companies_raw(spark, sf_dir)
    broken = F.when(F.col("name").cast("bigint") % 50 == 0, F.concat(F.lit("n/a "), "name")).otherwise(F.col("funding_total_usd"))
    return fe.funding_parse_report(raw.withColumn("funding_total_usd", broken))


@query("p2_label_and_filter", ["co_labelled"], """
  SELECT status, label, count(*) AS n FROM co_labelled GROUP BY status, label""")
def p2_label_and_filter(spark, sf_dir):
    """Operating dropped (null-safe), label mapped; unknown status fails the job."""
    lab = fe.label_and_filter(companies_raw(spark, sf_dir))
    return lab.groupBy("status", "label").agg(F.count(F.lit(1)).alias("n"))


@query("p3_primary_category", ["companies_raw"], """
  SELECT permalink, split_part(category_list, '|', 1) AS primary_category FROM companies_raw""")
def p3_primary_category(spark, sf_dir):
    """First '|' token of category_list."""
    raw = companies_raw(spark, sf_dir)
    return raw.select("permalink", F.split_part(F.col("category_list"), F.lit("|"), F.lit(1)).alias("primary_category"))


@query("p4_dates", ["co_eff"], """
  SELECT permalink, founded_clean, eff AS effective_date FROM co_eff""")
def p4_dates(spark, sf_dir):
    """founded_clean (range rule vs latest first funding) and effective_date."""
    d = fe.add_dates(fe.label_and_filter(companies_raw(spark, sf_dir)))
    return d.select("permalink", F.col("_founded_clean").alias("founded_clean"),
                    F.col("_effective").alias("effective_date"))


@query("p6_suspect_years", ["features"], """
  SELECT count_if(founded_year < 1980) AS suspect_year_rows,
         avg(CAST(founded_year < 1980 AS DOUBLE)) AS suspect_year_share FROM features""")
def p6_suspect_years(spark, sf_dir):
    """Processed founded_year < 1980, count and share."""
    f = features_of(spark, sf_dir)
    s = F.col("founded_year") < C.SUSPECT_FOUNDED_YEAR
    return f.agg(F.count_if(s).alias("suspect_year_rows"), F.avg(s.cast("double")).alias("suspect_year_share"))


_FB_SQL = """CASE WHEN funding_total_usd > 0 AND funding_total_usd <= 100000 THEN '<$100K'
       WHEN funding_total_usd > 100000 AND funding_total_usd <= 1000000 THEN '$100K-$1M'
       WHEN funding_total_usd > 1000000 AND funding_total_usd <= 10000000 THEN '$1M-$10M'
       WHEN funding_total_usd > 10000000 AND funding_total_usd <= 100000000 THEN '$10M-$100M'
       WHEN funding_total_usd > 100000000 THEN '$100M+' END"""
_FB_ORD_SQL = """CASE WHEN funding_total_usd > 0 AND funding_total_usd <= 100000 THEN 0
       WHEN funding_total_usd > 100000 AND funding_total_usd <= 1000000 THEN 1
       WHEN funding_total_usd > 1000000 AND funding_total_usd <= 10000000 THEN 2
       WHEN funding_total_usd > 10000000 AND funding_total_usd <= 100000000 THEN 3
       WHEN funding_total_usd > 100000000 THEN 4 END"""


@query("p7_funding_band", ["features"], f"""
  SELECT permalink, {_FB_SQL} AS funding_band, {_FB_ORD_SQL} AS band_ord FROM features""")
def p7_funding_band(spark, sf_dir):
    """Right-closed funding bands on the raw dollar value; 0/null -> no band."""
    f = features_of(spark, sf_dir)
    usd = F.col("funding_total_usd")
    return f.select("permalink", funding_band(usd).alias("funding_band"), funding_band_ord(usd).alias("band_ord"))


_AGE_SQL = """CASE WHEN age_years >= 0 AND age_years < 2 THEN '0-2y'
       WHEN age_years >= 2 AND age_years < 5 THEN '2-5y'
       WHEN age_years >= 5 AND age_years < 10 THEN '5-10y'
       WHEN age_years >= 10 AND age_years < 20 THEN '10-20y'
       WHEN age_years >= 20 THEN '20y+' END"""
_AGE_ORD_SQL = """CASE WHEN age_years >= 0 AND age_years < 2 THEN 0
       WHEN age_years >= 2 AND age_years < 5 THEN 1
       WHEN age_years >= 5 AND age_years < 10 THEN 2
       WHEN age_years >= 10 AND age_years < 20 THEN 3
       WHEN age_years >= 20 THEN 4 END"""
_AGED = "(SELECT *, (SELECT max(founded_year) FROM features) - founded_year AS age_years FROM features)"


@query("p8_age_band", ["features"], f"""
  SELECT permalink, age_years, {_AGE_SQL} AS age_band FROM {_AGED} a""")
def p8_age_band(spark, sf_dir):
    """age = max(founded_year) - founded_year, left-closed bands."""
    return gr.with_age(features_of(spark, sf_dir)).select("permalink", "age_years", "age_band")


@query("a15_split_boundary", ["features", "co_boundary"], """
  SELECT (DATE '1970-01-01' + CAST(floor(boundary_days) AS INTEGER)) AS split_boundary,
         count_if(split = 'train') AS train_rows, count_if(split = 'test') AS test_rows,
         min(CASE WHEN split = 'test' THEN effective_date END) AS first_test_date,
         max(CASE WHEN split = 'train' THEN effective_date END) AS last_train_date
  FROM features CROSS JOIN co_boundary GROUP BY boundary_days""")
def a15_split_boundary(spark, sf_dir):
    """Exact 0.8 quantile of effective_date; train dates never overlap test dates."""
    f = features_of(spark, sf_dir, keep_dates=True)
    return f.groupBy("split_boundary").agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.min(F.when(F.col("split") == "test", F.col("effective_date"))).alias("first_test_date"),
        F.max(F.when(F.col("split") == "train", F.col("effective_date"))).alias("last_train_date"))


# ---------------------------------------------------------------- group analytics

def _rate_sql(key: str, source: str = "features", min_n: int = 30) -> str:
    return f"""SELECT {key}, avg(CAST(label AS DOUBLE)) AS success_rate, count(*) AS n
  FROM {source} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) >= {min_n}"""


@query("a1_rate_by_region", ["features"], _rate_sql("region"))
def a1_rate_by_region(spark, sf_dir):
    """A1: success rate per group, null keys dropped, n >= 30."""
    return gr.grouped_success_rate(features_of(spark, sf_dir), "region")


@query("a2_top_countries", ["features"], _rate_sql("country_code") + " ORDER BY n DESC, country_code LIMIT 15")
def a2_top_countries(spark, sf_dir):
    """A2 + K1: by country, 15 largest groups."""
    return gr.top_groups(features_of(spark, sf_dir), "country_code")


@query("a3_top_categories", ["features"], _rate_sql("primary_category") + " ORDER BY n DESC, primary_category LIMIT 15")
def a3_top_categories(spark, sf_dir):
    """A3 + K1: by primary category, 15 largest groups."""
    return gr.top_groups(features_of(spark, sf_dir), "primary_category")


@query("a4_rate_by_funding_band", ["features"], f"""
  SELECT funding_band, band_ord, avg(CAST(label AS DOUBLE)) AS success_rate, count(*) AS n
  FROM (SELECT {_FB_SQL} AS funding_band, {_FB_ORD_SQL} AS band_ord, label FROM features) b
  WHERE funding_band IS NOT NULL GROUP BY funding_band, band_ord HAVING count(*) >= 30""")
def a4_rate_by_funding_band(spark, sf_dir):
    """A4 + K6 (flagship): success rate by funding band, from raw strings end to end."""
    return gr.rate_by_funding_band(features_of(spark, sf_dir))


@query("a5_rate_by_age_band", ["features"], f"""
  SELECT age_band, band_ord, avg(CAST(label AS DOUBLE)) AS success_rate, count(*) AS n
  FROM (SELECT {_AGE_SQL} AS age_band, CAST({_AGE_ORD_SQL} AS INTEGER) AS band_ord, label FROM {_AGED} a) b
  WHERE age_band IS NOT NULL GROUP BY age_band, band_ord HAVING count(*) >= 30""")
def a5_rate_by_age_band(spark, sf_dir):
    """A5: success rate by company age band."""
    return gr.rate_by_age_band(features_of(spark, sf_dir))


@query("a6_overall_rate", ["features"], "SELECT avg(CAST(label AS DOUBLE)) AS success_rate, count(*) AS n FROM features")
def a6_overall_rate(spark, sf_dir):
    """Overall success rate and n."""
    return gr.overall_rate(features_of(spark, sf_dir))


@query("a7_coverage", ["features"], """
  SELECT column_name, n_nonnull, n_total, CAST(n_nonnull AS DOUBLE) / n_total AS share FROM (
    SELECT 'country_code' AS column_name, count(country_code) AS n_nonnull, count(*) AS n_total FROM features
    UNION ALL SELECT 'primary_category', count(primary_category), count(*) FROM features
    UNION ALL SELECT 'funding_total_usd_log1p', count(funding_total_usd_log1p), count(*) FROM features) c""")
def a7_coverage(spark, sf_dir):
    """Non-null count and share for country / category / funding."""
    return gr.coverage(features_of(spark, sf_dir))


@query("a8_build_report", ["features", "companies_raw"], """
  SELECT (SELECT count(*) FROM companies_raw) AS raw_rows,
         count(*) AS labelled_rows, CAST(sum(label) AS BIGINT) AS n_positive, count_if(label = 0) AS n_negative,
         avg(CAST(label AS DOUBLE)) AS positive_rate,
         count_if(split = 'train') AS train_rows, count_if(split <> 'train') AS test_rows,
         avg(CASE WHEN split = 'train' THEN CAST(label AS DOUBLE) END) AS train_positive_rate,
         avg(CASE WHEN split <> 'train' THEN CAST(label AS DOUBLE) END) AS test_positive_rate,
         count_if(founded_year < 1980) AS suspect_year_rows,
         avg(CAST(founded_year < 1980 AS DOUBLE)) AS suspect_year_share
  FROM features""")
def a8_build_report(spark, sf_dir):
    """Raw / labelled counts, class balance, split sizes and positive rates."""
    raw = companies_raw(spark, sf_dir)
    return gr.build_report(raw, fe.build_features(raw))


@query("a9_shown_total", ["features"], f"""
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS shown_n FROM ({_rate_sql('primary_category')}) r""")
def a9_shown_total(spark, sf_dir):
    """Sum of n over surviving (n >= 30) groups of one chart."""
    return gr.shown_total(gr.grouped_success_rate(features_of(spark, sf_dir), "primary_category"))


@query("a11_top_values", ["features"], """
  SELECT feature, value, n, rank FROM (
    SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM (
      SELECT feature, value, count(*) AS n FROM (
        SELECT 'country_code' AS feature, country_code AS value FROM features WHERE split = 'train'
        UNION ALL SELECT 'region', region FROM features WHERE split = 'train'
        UNION ALL SELECT 'primary_category', primary_category FROM features WHERE split = 'train') u
      WHERE value IS NOT NULL GROUP BY feature, value) c) r
  WHERE rank <= 20""")
def a11_top_values(spark, sf_dir):
    """A11 + K2: 20 most frequent values per categorical (train split)."""
    f = features_of(spark, sf_dir).where(F.col("split") == "train")
    return gr.top_values(f, C.CLEAN_CATEGORICAL_FEATURES)


@query("a12_distinct_options", ["features"], """
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS ord FROM (
    SELECT DISTINCT feature, value FROM (
      SELECT 'country_code' AS feature, country_code AS value FROM features
      UNION ALL SELECT 'region', region FROM features
      UNION ALL SELECT 'primary_category', primary_category FROM features) u
    WHERE value IS NOT NULL) d""")
def a12_distinct_options(spark, sf_dir):
    """Distinct sorted options per categorical."""
    return gr.distinct_options(features_of(spark, sf_dir), C.CLEAN_CATEGORICAL_FEATURES)


@query("a13_regions_by_country", ["features"], """
  SELECT country_code, region, n, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, region) AS rank
  FROM (SELECT country_code, region, count(*) AS n FROM features
        WHERE country_code IS NOT NULL AND region IS NOT NULL GROUP BY country_code, region) c""")
def a13_regions_by_country(spark, sf_dir):
    """Region options per country by frequency."""
    return gr.regions_by_country(features_of(spark, sf_dir))


@query("a14_train_base_rate", ["features"], """
  SELECT avg(CAST(label AS DOUBLE)) AS success_rate, count(*) AS n FROM features WHERE split = 'train'""")
def a14_train_base_rate(spark, sf_dir):
    """Train-split base rate."""
    return gr.overall_rate(features_of(spark, sf_dir).where(F.col("split") == "train"))


_COHORT_SQL = f"""
  SELECT country_code, primary_category, funding_band,
         CASE GROUPING(country_code, primary_category, funding_band)
              WHEN 0 THEN 'country+category+funding_band' WHEN 1 THEN 'country+category'
              ELSE 'country' END AS level,
         count(*) AS n, avg(CAST(label AS DOUBLE)) AS success_rate
  FROM (SELECT country_code, primary_category, {_FB_SQL} AS funding_band, label FROM features) b
  GROUP BY GROUPING SETS ((country_code, primary_category, funding_band),
                          (country_code, primary_category), (country_code))"""


@query("a16_cohort_levels", ["features"], _COHORT_SQL)
def a16_cohort_levels(spark, sf_dir):
    """Cohort stats at three granularities in one GROUPING SETS pass."""
    return gr.cohort_levels(features_of(spark, sf_dir))


J1_SQL = f"""
  WITH lv AS ({_COHORT_SQL}),
  req AS (SELECT permalink AS request_id, country_code, primary_category, {_FB_SQL} AS funding_band
          FROM features WHERE split = 'test'),
  l1 AS (SELECT * FROM lv WHERE level = 'country+category+funding_band' AND n >= 30),
  l2 AS (SELECT * FROM lv WHERE level = 'country+category' AND n >= 30),
  l3 AS (SELECT * FROM lv WHERE level = 'country' AND n >= 30)
  SELECT r.request_id, r.country_code,
         CASE WHEN l1.n IS NOT NULL OR l2.n IS NOT NULL THEN r.primary_category END AS cohort_category,
         CASE WHEN l1.n IS NOT NULL THEN 'country+category+funding_band'
              WHEN l2.n IS NOT NULL THEN 'country+category'
              WHEN l3.n IS NOT NULL THEN 'country' END AS level,
         coalesce(l1.n, l2.n, l3.n) AS cohort_n,
         coalesce(l1.success_rate, l2.success_rate, l3.success_rate) AS cohort_success_rate
  FROM req r
  LEFT JOIN l1 ON r.country_code = l1.country_code AND r.primary_category = l1.primary_category
              AND r.funding_band = l1.funding_band
  LEFT JOIN l2 ON r.country_code = l2.country_code AND r.primary_category = l2.primary_category
  LEFT JOIN l3 ON r.country_code = l3.country_code"""


@query("j1_cohort_lookup", ["features"], J1_SQL)
def j1_cohort_lookup(spark, sf_dir):
    """Per-request cohort with progressive back-off (test rows as requests)."""
    f = features_of(spark, sf_dir, columns=["permalink", "country_code", "primary_category", "funding_total_usd"])
    req = f.where(F.col("split") == "test").select(
        F.col("permalink").alias("request_id"), "country_code", "primary_category", "funding_total_usd")
    return gr.cohort_lookup(req, f)


@query("j4_region_options", ["features"], """
  WITH rc AS (SELECT country_code AS option_key, region, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, region) AS rank
              FROM (SELECT country_code, region, count(*) AS n FROM features
                    WHERE split = 'train' AND country_code IS NOT NULL AND region IS NOT NULL
                    GROUP BY country_code, region) c),
  alln AS (SELECT '*' AS option_key, region, row_number() OVER (ORDER BY region) AS rank
           FROM (SELECT DISTINCT region FROM features WHERE split = 'train' AND region IS NOT NULL) d),
  opts AS (SELECT * FROM rc UNION ALL SELECT * FROM alln),
  tbl AS (SELECT option_key, region, rank FROM opts
          UNION ALL SELECT option_key, 'UNKNOWN', max(rank) + 1 FROM opts GROUP BY option_key),
  req AS (SELECT permalink AS request_id,
                 CASE WHEN country_code IN (SELECT option_key FROM tbl) THEN country_code ELSE '*' END AS option_key
          FROM features WHERE split = 'test')
  SELECT request_id, regions FROM req JOIN (SELECT option_key, list(region ORDER BY rank) AS regions FROM tbl GROUP BY option_key) USING (option_key)""")
def j4_region_options(spark, sf_dir):
    """Region options for each request's country, with the all-regions fallback."""
    f = features_of(spark, sf_dir, columns=["permalink", "country_code", "region"])
    req = f.where(F.col("split") == "test").select(F.col("permalink").alias("request_id"), "country_code")
    return gr.region_options(req, f.where(F.col("split") == "train"))


@query("o3_unknown_statuses", ["companies_raw"], """
  SELECT DISTINCT CASE WHEN CAST(name AS BIGINT) % 40 = 0 THEN 'closed?' || region ELSE status END AS status FROM companies_raw
  WHERE status IS NOT NULL AND CAST(name AS BIGINT) % 40 = 0""")
def o3_unknown_statuses(spark, sf_dir):
    """O3: statuses outside the vocabulary (anti join against a literal table); every fortieth company gets one."""
    raw = companies_raw(spark, sf_dir)
    odd = F.when(F.col("name").cast("bigint") % 40 == 0, F.concat(F.lit("closed?"), "region")).otherwise(F.col("status"))
    return fe.unknown_statuses(raw.withColumn("status", odd))


@query("s1_raw_csv", ["companies_raw"], "SELECT * FROM companies_raw")
def s1_raw_csv(spark, sf_dir):
    """The raw table written as CSV files with a header and read back under the header contract."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"raw-{uuid.uuid4().hex}")
    companies_raw(spark, sf_dir).write.option("header", True).csv(path)
    return tb.read_raw_csv(spark, path)


@query("o5_split_sizes", ["features"], """
  SELECT split, count(*) AS n, avg(CAST(label AS DOUBLE)) AS positive_rate FROM features GROUP BY split""")
def o5_split_sizes(spark, sf_dir):
    """Complement masks train / test, sizes and positive rates."""
    return features_of(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
