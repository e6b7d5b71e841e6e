"""ETL: raw string records -> labelled, leakage-aware feature table with a time split.

Covers S2, P1-P6, P8, O5, A15, J9. Every step is one lazy plan; the two
data-derived scalars (latest first-funding date, 0.8 quantile of the effective
date) are one-row aggregates cross-joined back (a broadcast of exactly one row).
Contract violations fail the job from inside the plan (``raise_error``), so no
extra pass is spent on checking.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import clean_funding_text, lenient_double, strict_double
from cohortlab.session import materialize

FEATURE_COLUMNS = [
    "founded_year", "time_to_first_funding_days", "country_code", "region",
    "primary_category", "category_list", "funding_total_usd_log1p", "funding_rounds",
    "funding_span_days", "label", "permalink", "name", "funding_total_usd",
]


def check_columns(df: DataFrame) -> DataFrame:
    """O3 (schema side): the 14 raw columns must be present; metadata only."""
    missing = sorted(set(C.RAW_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"raw table is missing expected columns: {missing}")
    return df


def label_expr(status: Column) -> Column:
    """acquired/ipo -> 1, closed -> 0; any other (incl. null) status fails the job."""
    return (
        F.when(status.isin(*C.POSITIVE_STATUSES), F.lit(1))
        .when(status.isin(*C.NEGATIVE_STATUSES), F.lit(0))
        .otherwise(F.raise_error(F.concat(
            F.lit("status not in the label vocabulary: "), F.coalesce(status, F.lit("<null>")))).cast("int"))
    )


def label_and_filter(raw: DataFrame) -> DataFrame:
    """Drop operating rows (null-safe, so a null status is kept and then rejected)."""
    check_columns(raw)
    return (raw.where(~F.col("status").eqNullSafe(C.STATUS_OPERATING))
            .withColumn("label", label_expr(F.col("status"))))


def unknown_statuses(raw: DataFrame) -> DataFrame:
    """O3 (value side): statuses outside the vocabulary, as an anti join to a literal table."""
    spark = raw.sparkSession
    vocab = spark.createDataFrame([(s,) for s in C.VALID_STATUSES], "status string")
    return (raw.select("status").where(F.col("status").isNotNull()).distinct()
            .join(F.broadcast(vocab), "status", "left_anti"))


def funding_parse_report(raw: DataFrame, examples: int = 10) -> DataFrame:
    """P1 report: one row (n_bad, first ``examples`` distinct bad values, sorted).

    The examples are a bounded top-k (``array_sort`` of at most ``examples`` values
    kept per partition by ``min_by``-style limiting is not available, so the
    distinct values are ordered and limited) - never an unbounded collect.
    """
    cleaned = clean_funding_text(F.col("funding_total_usd"))
    bad = raw.select(cleaned.alias("v")).where(F.col("v").isNotNull() & lenient_double(F.col("v")).isNull())
    n_bad = bad.agg(F.count(F.lit(1)).alias("n_bad"))
    ex = bad.distinct().orderBy("v").limit(examples).agg(F.collect_list("v").alias("examples"))
    return n_bad.crossJoin(ex)


def assert_funding_parseable(raw: DataFrame) -> None:
    """P1 raising variant with the reference's message shape (one small action)."""
    row = funding_parse_report(raw).first()
    if row and row["n_bad"]:
        raise ValueError(
            f"funding_total_usd has {row['n_bad']} unparseable values, e.g. {list(row['examples'])}")


def funding_usd(col: Column) -> Column:
    """P1 in-plan: cleaned text -> DOUBLE, failing the job on garbage."""
    return strict_double(clean_funding_text(col), "funding_total_usd")


def add_dates(labelled: DataFrame) -> DataFrame:
    """founded_clean / effective_date, with the upper bound = latest first funding."""
    df = (labelled
          .withColumn("_founded_raw", F.try_to_date(F.col("founded_at"), "yyyy-MM-dd"))
          .withColumn("_first", F.try_to_date(F.col("first_funding_at"), "yyyy-MM-dd")))
    if "last_funding_at" in labelled.columns:
        df = df.withColumn("_last", F.try_to_date(F.col("last_funding_at"), "yyyy-MM-dd"))
    bound = df.agg(F.max("_first").alias("_upper"))
    df = df.crossJoin(F.broadcast(bound))
    plausible = (F.col("_founded_raw").isNotNull()
                 & (F.year("_founded_raw") >= C.MIN_FOUNDED_YEAR)
                 & (F.col("_founded_raw") <= F.col("_upper")))
    return (df.withColumn("_founded_clean", F.when(plausible, F.col("_founded_raw")))
              .withColumn("_effective", F.coalesce(F.col("_founded_clean"), F.col("_first")))
              .drop("_upper"))


def add_split(df: DataFrame, test_quantile: float = C.TEST_QUANTILE) -> DataFrame:
    """A15 + O5: exact interpolated quantile of the effective date; train = at or before it.

    ``percentile`` keeps one counter per distinct day, so its state is bounded by
    the calendar, not by the row count.
    """
    days = F.unix_date(F.col("_effective"))
    boundary = df.agg(F.percentile(days, F.lit(test_quantile)).alias("_boundary_days"))
    guarded = F.when(F.col("_effective").isNull(), F.raise_error(
        F.lit("effective_date has nulls; cannot split rows with no usable date")))
    return (df.crossJoin(F.broadcast(boundary))
              .withColumn("split", F.coalesce(guarded.cast("string"), F.when(
                  days.cast("double") <= F.col("_boundary_days"), F.lit("train")).otherwise(F.lit("test"))))
              .withColumn("split_boundary", F.date_from_unix_date(F.floor(F.col("_boundary_days")).cast("int")))
              .drop("_boundary_days"))


def _feature_exprs() -> dict:
    usd = lambda: funding_usd(F.col("funding_total_usd"))
    return {
        "founded_year": lambda: F.year("_effective").cast("double"),
        "time_to_first_funding_days": lambda: F.datediff(F.col("_first"), F.col("_founded_clean")).cast("double"),
        "country_code": lambda: F.col("country_code"),
        "region": lambda: F.col("region"),
        "primary_category": lambda: F.split_part(F.col("category_list"), F.lit("|"), F.lit(1)),
        "category_list": lambda: F.col("category_list"),
        "funding_total_usd_log1p": lambda: F.log1p(usd()),
        "funding_rounds": lambda: strict_double(F.col("funding_rounds"), "funding_rounds"),
        "funding_span_days": lambda: F.datediff(F.col("_last"), F.col("_first")).cast("double"),
        "label": lambda: F.col("label").cast("int"),
        "permalink": lambda: F.col("permalink"),
        "name": lambda: F.col("name"),
        "funding_total_usd": usd,
        "split": lambda: F.col("split"),
        "effective_date": lambda: F.col("_effective"),
        "split_boundary": lambda: F.col("split_boundary"),
    }


#: Raw columns behind a feature, where they are not its namesake (the two dates are always needed for the split).
RAW_OF = {
    "founded_year": [], "time_to_first_funding_days": [], "primary_category": ["category_list"], "funding_total_usd_log1p": ["funding_total_usd"],
    "funding_span_days": ["last_funding_at"], "split": [], "effective_date": [], "split_boundary": [],
}


def engineer(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P3 + P5: the model features (plus raw USD, kept for exact banding), or the named ones of them."""
    exprs = _feature_exprs()
    return df.select(*[exprs[c]().alias(c) for c in exprs if columns is None or c in columns])


def build_features(raw: DataFrame, test_quantile: float = C.TEST_QUANTILE,
                   keep_dates: bool = False, columns: list[str] | None = None) -> DataFrame:
    """E1 end to end: label -> dates -> split -> features.

    The labelled, parsed table is scanned three times (latest first funding, split
    quantile, features), so it is written once to the shared checkpoint folder instead
    of recomputing the raw joins for every scan. ``columns`` names the features
    needed: only the raw columns behind them are computed and written.
    """
    wanted = FEATURE_COLUMNS + ["split", "effective_date", "split_boundary"] if columns is None else list(dict.fromkeys([*columns, "label", "split"]))
    if not keep_dates:
        wanted = [c for c in wanted if c not in ("effective_date", "split_boundary")]
    needed = {"founded_at", "first_funding_at", "last_funding_at", "label"}.union(*[RAW_OF.get(c, [c]) for c in wanted])
    if "funding_span_days" not in wanted:
        needed.discard("last_funding_at")
    labelled = label_and_filter(raw)
    labelled = materialize(labelled.select(*[c for c in labelled.columns if c in needed]), "labelled")
    return engineer(add_split(add_dates(labelled), test_quantile), wanted)
