"""Uncertainty: Wilson intervals, quantile band tables, band lookup, ECDF percentiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import wilson_bounds
from cohortlab.operators import ecdf
from cohortlab.operators.metrics import quantile_fracs
from cohortlab.operators.prefix import exact_quantiles


def wilson_table(counts: DataFrame, successes: str = "successes", n: str = "n",
                 confidence: float = 0.90, digits: int = 9) -> DataFrame:
    """U1 over a table of (successes, n) rows."""
    lo, hi = wilson_bounds(F.col(successes), F.col(n), confidence)
    return counts.withColumn("ci_lower", F.round(lo, digits)).withColumn("ci_upper", F.round(hi, digits))


def band_edges(scored: DataFrame, n_bins: int = C.N_CALIBRATION_BINS, score_col: str = "score") -> DataFrame:
    """Quantile edges with the ends forced to 0 and 1, duplicates collapsed: one row (edges ARRAY)."""
    q = exact_quantiles(scored, score_col, quantile_fracs(n_bins))
    forced = q.select(F.when(F.col("q_idx") == 0, F.lit(0.0))
                      .when(F.col("q_idx") == n_bins, F.lit(1.0)).otherwise(F.col("value")).alias("e"))
    return forced.agg(F.array_sort(F.array_distinct(F.collect_list("e"))).alias("edges"))


def confidence_bands(scored: DataFrame, n_bins: int = C.N_CALIBRATION_BINS, confidence: float = 0.90,
                     score_col: str = "score", label_col: str = "label", digits: int = 9) -> DataFrame:
    """Left-closed bins [lo, hi), last bin closed; empty bins kept with (0, 1)."""
    edges = band_edges(scored, n_bins, score_col)
    bins = (edges.select(F.posexplode(F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1),
                                                   F.slice("edges", 2, F.size("edges") - 1))).alias("bin", "z"),
                         (F.size("edges") - 2).alias("last_bin"))
                 .select("bin", F.col("z")["0"].alias("bin_lower"), F.col("z")["1"].alias("bin_upper"), "last_bin"))
    s = F.col(score_col).cast("double")
    e = F.col("edges")
    last = F.element_at(e, -1)
    idx = (F.when(s == last, F.size(e) - 2)
           .otherwise(F.size(F.filter(e, lambda x: x <= s)) - 1))
    assigned = (scored.crossJoin(F.broadcast(edges))
                      .select(idx.alias("bin"), F.col(label_col).cast("bigint").alias("y"),
                              ((s >= F.element_at(e, 1)) & (s <= last)).alias("inside"))
                      .where(F.col("inside") & (F.col("bin") <= F.size(e) - 2))
                      .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("successes")))
    out = (F.broadcast(bins).join(assigned, "bin", "left")
           .select("bin", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("n"),
                   F.coalesce("successes", F.lit(0)).alias("successes")))
    out = out.withColumn("phat", F.when(F.col("n") > 0, F.col("successes") / F.col("n")).otherwise(F.lit(0.0)))
    return wilson_table(out, confidence=confidence, digits=digits)


def lookup_band(requests: DataFrame, bands: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Half-open bins, the top bin (largest upper edge) closed, outside -> nearest end band.

    ``bands`` has at most n_bins rows, so it is broadcast; the range condition is
    evaluated as a broadcast nested-loop join against that constant-size side.
    """
    top = bands.agg(F.max("bin_upper").alias("_top"), F.min("bin_lower").alias("_bottom"))
    b = bands.crossJoin(top).select("bin", "bin_lower", "bin_upper", "ci_lower", "ci_upper", "_top", "_bottom")
    p = F.col(prob_col)
    bb = F.broadcast(b)
    in_bin = ((bb.bin_lower <= p) & ((p < bb.bin_upper) | ((bb.bin_upper == bb._top) & (p <= bb.bin_upper))))
    matched = requests.join(bb, in_bin, "left")
    ends = bands.agg(F.min_by("ci_lower", "bin_lower").alias("_lo_l"), F.min_by("ci_upper", "bin_lower").alias("_lo_u"),
                     F.max_by("ci_lower", "bin_upper").alias("_hi_l"), F.max_by("ci_upper", "bin_upper").alias("_hi_u"),
                     F.min("bin_lower").alias("_min_lo"))
    out = matched.drop("bin_lower", "bin_upper", "_top", "_bottom").crossJoin(F.broadcast(ends))
    below = p < F.col("_min_lo")
    return out.select(
        *requests.columns,
        F.coalesce(F.col("ci_lower"), F.when(below, F.col("_lo_l")).otherwise(F.col("_hi_l"))).alias("band_lower"),
        F.coalesce(F.col("ci_upper"), F.when(below, F.col("_lo_u")).otherwise(F.col("_hi_u"))).alias("band_upper"))


def ecdf_table(reference: DataFrame, score_col: str = "score") -> DataFrame:
    """The compressed reference distribution (score, n, cum_n, total), read back from its stored form."""
    return ecdf.store(reference, score_col).cells(reference.sparkSession).drop("blk")


def percentile_of(requests: DataFrame, reference: DataFrame | ecdf.Ecdf, req_col: str = "probability",
                  ref_col: str = "score") -> DataFrame:
    """100 * (reference values at or below the request value) / n; a reference that is no ``Ecdf`` yet is stored first."""
    stored = reference if isinstance(reference, ecdf.Ecdf) else ecdf.store(reference, ref_col)
    return stored.percentile(requests, req_col)


def collapse_on_failure(df: DataFrame, point: str = "probability", lower: str = "band_lower",
                        upper: str = "band_upper") -> DataFrame:
    """U5 flag + U6: brackets = lower <= point <= upper; otherwise the band collapses to the point."""
    br = (F.col(lower) <= F.col(point)) & (F.col(point) <= F.col(upper))
    return (df.withColumn("brackets", F.coalesce(br, F.lit(False)))
              .withColumn(lower, F.when(F.col("brackets"), F.col(lower)).otherwise(F.col(point)))
              .withColumn(upper, F.when(F.col("brackets"), F.col(upper)).otherwise(F.col(point))))


def bracket_summary(df: DataFrame, strict: bool = True, point: str = "probability", lower: str = "band_lower", upper: str = "band_upper") -> DataFrame:
    """One row (n, n_bracketing). ``strict`` fails the job on any band that misses its point."""
    br = F.coalesce((F.col(lower) <= F.col(point)) & (F.col(point) <= F.col(upper)), F.lit(False))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(br).alias("n_bracketing"))
    if not strict:
        return out
    missed = F.concat((F.col("n") - F.col("n_bracketing")).cast("string"), F.lit(" confidence bands do not bracket their point estimate"))
    return out.select("n", F.when(F.col("n") > F.col("n_bracketing"), F.raise_error(missed).cast("bigint")).otherwise(F.col("n_bracketing")).alias("n_bracketing"))
