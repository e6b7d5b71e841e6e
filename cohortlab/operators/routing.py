"""Intent routing and answer assembly over a table of questions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.text import strip_ws


def _any_rlike(q: Column, patterns: list[str]) -> Column:
    out = None
    for p in patterns:
        c = q.rlike(p)
        out = c if out is None else (out | c)
    return out


def _any_contains(q: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        c = q.contains(w)
        out = c if out is None else (out | c)
    return out


def classify_intent(question: Column) -> Column:
    """Ordered rules on lower(strip(q)); greeting is tested first."""
    q = F.lower(strip_ws(question))
    return (F.when(_any_rlike(q, C.GREETING_PATTERNS), F.lit("greeting"))
            .when(_any_rlike(q, C.ABOUT_PREDICTION_PATTERNS), F.lit("about_prediction"))
            .when(_any_contains(q, C.GENERAL_TOPIC_KEYWORDS), F.lit("general"))
            .otherwise(F.lit("out_of_scope")))


def find_named_feature(question: Column) -> Column:
    """First feature (in rule order) with a keyword that is a substring of lower(q)."""
    q = F.lower(question)
    expr = None
    for feature, kws in C.FEATURE_KEYWORDS:
        cond = _any_contains(q, kws)
        expr = F.when(cond, F.lit(feature)) if expr is None else expr.when(cond, F.lit(feature))
    return expr.otherwise(F.lit(None).cast("string"))


def route(questions: DataFrame, text_col: str = "question") -> DataFrame:
    return (questions.withColumn("intent", classify_intent(F.col(text_col)))
                     .withColumn("named_feature", find_named_feature(F.col(text_col))))


def render_retrieved(reranked: DataFrame, chunks: DataFrame, questions: DataFrame, id_col: str = "qid") -> DataFrame:
    """X19: 'Related context' text per question from its (<= 3) reranked chunks, in MMR order."""
    c = chunks.select("chunk_id", "doc_id", "heading", "text", "source_url")
    lines = (reranked.join(c, "chunk_id")
                     .select(id_col, "mmr_rank", F.format_string(
                         "- **%s** (%s): %s\n  Source: %s", F.col("heading"), F.col("doc_id"), F.col("text"),
                         F.coalesce(F.col("source_url"), F.lit("None"))).alias("line")))
    per_q = (lines.groupBy(id_col)
                  .agg(F.array_sort(F.collect_list(F.struct("mmr_rank", "line"))).alias("_l"))
                  .select(id_col, F.concat_ws("\n", F.lit(C.RELATED_HEADER),
                                              F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
                          .alias("answer")))
    return (questions.select(id_col).join(per_q, id_col, "left")
                     .select(id_col, F.coalesce(F.col("answer"), F.lit(C.NOTHING_MATCHED_TEXT)).alias("answer")))


def answer(questions: DataFrame, general_answers: DataFrame, facts_text: DataFrame | None = None,
           id_col: str = "qid", text_col: str = "question") -> DataFrame:
    """The answer by intent; each class is processed only for its own rows.

    general_answers: (qid, answer) for the general questions (X12 + X19);
    facts_text: optional (qid, answer) rendered facts for about_prediction rows;
    without it those rows get the "no prediction yet" text.
    """
    r = route(questions, text_col)
    g = general_answers.select(id_col, F.col("answer").alias("_general"))
    out = r.join(g, id_col, "left")
    if facts_text is not None:
        out = out.join(facts_text.select(id_col, F.col("answer").alias("_facts")), id_col, "left")
    facts = F.col("_facts") if facts_text is not None else F.lit(None).cast("string")
    text = (F.when(F.col("intent") == "greeting", F.lit(C.CAPABILITY_STATEMENT))
            .when(F.col("intent") == "about_prediction", F.coalesce(facts, F.lit(C.NO_PREDICTION_TEXT)))
            .when(F.col("intent") == "general", F.coalesce(F.col("_general"), F.lit(C.NOTHING_MATCHED_TEXT)))
            .otherwise(F.lit(C.OUT_OF_SCOPE_TEXT + C.CAPABILITY_STATEMENT)))
    return out.select(id_col, "intent", text.alias("answer"))
