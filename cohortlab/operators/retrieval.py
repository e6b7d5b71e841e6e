"""Sparse TF-IDF retrieval as joins.

The index is a postings table (term, chunk_id, weight) plus an idf table; a query
is scored by an equi-join on term and a grouped sum, never a dense matrix. Postings
are dealt by chunk, so where the question vectors fit Spark's broadcast threshold
the sums need no further exchange and only each partition's top k per question is
shuffled (``row_number() <= k`` becomes a partial + final WindowGroupLimit). Larger
question tables join by term, where AQE splits hot terms.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.text import tokens
from cohortlab.session import ensure_checkpoint_dir, materialize

ORD_COLS = ["doc_id", "sec_idx", "piece_idx"]
#: Bytes of question texts in one automaton, about.
SHARD_BYTES = 1 << 24
#: Terms of greatest document frequency whose idf is broadcast (some megabytes); only postings of other terms are shuffled by term.
COMMON = 1 << 16


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words=None) -> DataFrame:
    """(id, term, tf) with raw counts."""
    return (df.select(F.col(id_col).alias("_id"), F.explode(tokens(F.col(text_col), stop_words)).alias("term"))
              .groupBy("_id", "term").agg(F.count(F.lit(1)).alias("tf"))
              .withColumnRenamed("_id", id_col))


def fit_idf(tf: DataFrame, id_col: str, n_docs: DataFrame) -> DataFrame:
    """Smooth idf = ln((1 + n) / (1 + df)) + 1 per term."""
    dfs = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (dfs.crossJoin(F.broadcast(n_docs))
               .select("term", "df", (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0)
                       .alias("idf")))


def _l2(weighted: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy(id_col)
    return (weighted.withColumn("_norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(w)))
                    .select(id_col, "term", (F.col("w") / F.col("_norm")).alias("weight")))


def build_index(chunks: DataFrame, stop_words=None) -> tuple[DataFrame, DataFrame]:
    """(postings(term, chunk_id, weight), idf(term, df, idf)); weights are L2-normalised tf*idf."""
    # Texts are dealt by chunk, as they are smaller than their terms; counting per chunk then needs no exchange of its own. The counts are
    # scanned several times (document frequencies, weights): they are stored once, a row per chunk, instead of tokenising the corpus again
    counted = term_counts(chunks.select("chunk_id", "text").repartition("chunk_id"), "chunk_id", "text", stop_words)
    rows = counted.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("z"))
    stored = materialize(rows.select("chunk_id", F.col("z.term").alias("terms"), F.col("z.tf").cast("array<int>").alias("tfs")), "term-counts")
    n_docs = chunks.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = materialize(fit_idf(_terms(stored), "chunk_id", n_docs), "idf")
    return _l2(_weighted(stored, idf), "chunk_id"), idf


def _terms(stored: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of the stored rows."""
    return stored.select("chunk_id", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")).withColumn("tf", F.col("tf").cast("long"))


def _weighted(stored: DataFrame, idf: DataFrame) -> DataFrame:
    """(chunk_id, term, w = tf * idf), dealt by chunk.

    The ``COMMON`` most frequent terms, which most postings have, get their idf by a broadcast: their postings are dealt as one row per
    chunk. Only the postings of other terms are shuffled by term.
    """
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = idf.select("term", "idf", "df")
    common = F.broadcast(materialize(terms.orderBy(F.col("df").desc(), "term").limit(COMMON), "common-terms"))  # COMMON rows at most
    often = _terms(stored.repartition(parts, "chunk_id")).join(common, "term").select("chunk_id", "term", "tf", "idf")
    seldom = _terms(stored).join(common, "term", "left_anti").join(terms, "term").select("chunk_id", "term", "tf", "idf").repartition(parts, "chunk_id")
    return often.unionByName(seldom).select("chunk_id", "term", (F.col("tf") * F.col("idf")).alias("w"))


def vectorize_queries(queries: DataFrame, idf: DataFrame, id_col: str = "qid", text_col: str = "question",
                      stop_words=None) -> DataFrame:
    """Query vectors with out-of-vocabulary terms dropped (inner join with idf)."""
    tf = term_counts(queries, id_col, text_col, stop_words)
    weighted = tf.join(idf.select("term", "idf"), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return _l2(weighted, id_col)


def contributions(qvec: DataFrame, postings: DataFrame, id_col: str = "qid") -> DataFrame:
    """(qid, chunk_id, x): the products whose sum per pair is the cosine."""
    return (qvec.withColumnRenamed("weight", "wq").join(postings.withColumnRenamed("weight", "wc"), "term")
                .select(id_col, "chunk_id", (F.col("wq") * F.col("wc")).alias("x")))


def score_chunks(qvec: DataFrame, postings: DataFrame, id_col: str = "qid") -> DataFrame:
    """cosine = dot product of normalised vectors, by an equi-join on term."""
    return contributions(qvec, postings, id_col).groupBy(id_col, "chunk_id").agg(F.sum("x").alias("score"))


def retrieve(queries: DataFrame, chunks: DataFrame, postings: DataFrame, idf: DataFrame, top_k: int,
             id_col: str = "qid", text_col: str = "question", fill_zero: bool = True, digits: int = 9,
             stop_words=None) -> DataFrame:
    """X10 + K4: top-k chunks per query by cosine; ties broken by chunk order, later chunk first.

    ``fill_zero`` pads queries with fewer than k matching chunks with zero-score
    chunks (latest first), as the reference's dense scoring does: the k last chunks in
    chunk order join each query's own top k with a zero score.
    """
    order = chunks.select("chunk_id", *ORD_COLS)
    # stored: its size is known to the join, and it is read once per question table
    qv = materialize(vectorize_queries(queries, idf, id_col, text_col, stop_words), "question-vectors")
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), *[F.col(c).desc() for c in ORD_COLS])

    def best(scored):
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)

    parts = contributions(qv, postings.repartition("chunk_id"), id_col)
    top = best(parts.groupBy(id_col, "chunk_id").agg(F.round(F.sum("x"), digits).alias("score")).join(order, "chunk_id"))
    if fill_zero:
        pad = order.orderBy(*[F.col(c).desc() for c in ORD_COLS]).limit(top_k).select("chunk_id")
        zero = queries.select(id_col).distinct().crossJoin(F.broadcast(pad))  # queries x k rows, k a small constant
        # products are positive: a padded chunk that has a score among the top keeps it, one below them comes after them with 0, too
        both = top.select(id_col, "chunk_id", "score").unionByName(zero.withColumn("score", F.lit(0.0)))
        top = best(both.groupBy(id_col, "chunk_id").agg(F.max("score").alias("score")).join(order, "chunk_id"))
    return top.select(id_col, "rank", "chunk_id", "score")


def relevance_filter(retrieved: DataFrame, min_score: float = C.MIN_RETRIEVAL_SCORE) -> DataFrame:
    """Keep candidates scoring at least the floor."""
    return retrieved.where(F.col("score") >= F.lit(min_score))


def mmr_rerank(cands: DataFrame, postings: DataFrame, k: int = C.RERANK_K, lam: float = C.MMR_LAMBDA,
               id_col: str = "qid") -> DataFrame:
    """X11: greedy maximal marginal relevance over each query's (<= 8) candidates.

    cands: (qid, rank, chunk_id, score). Pairwise candidate cosines come from a
    self-join of the candidates' postings on (qid, term) - at most 8 x 8 pairs per
    query. The k greedy rounds are unrolled; in each, the first candidate (by
    retrieval rank) with the highest MMR score wins.
    """
    ensure_checkpoint_dir(cands.sparkSession)
    cands = cands.checkpoint(eager=True)
    cp = cands.select(id_col, "chunk_id").join(postings, "chunk_id")
    a, b = cp.alias("a"), cp.alias("b")
    sim = (a.join(b, [F.col(f"a.{id_col}") == F.col(f"b.{id_col}"), F.col("a.term") == F.col("b.term")])
            .groupBy(F.col(f"a.{id_col}").alias(id_col), F.col("a.chunk_id").alias("c1"), F.col("b.chunk_id").alias("c2"))
            .agg(F.round(F.sum(F.col("a.weight") * F.col("b.weight")), 9).alias("sim")))
    # candidates and their pairwise similarities are small (<= 8 and <= 64 rows per
    # query); checkpointing them cuts the lineage the unrolled rounds would repeat
    sim = sim.checkpoint(eager=True)
    remaining = cands.select(id_col, "chunk_id", "score", F.col("rank").alias("cand_pos"))
    selected = None
    w = Window.partitionBy(id_col).orderBy(F.col("mmr").desc(), F.col("cand_pos").asc())
    for r in range(1, k + 1):
        if selected is None:
            scored = remaining.withColumn("mmr", F.lit(lam) * F.col("score"))
        else:
            pen = (sim.join(selected.select(id_col, F.col("chunk_id").alias("c2")), [id_col, "c2"])
                      .groupBy(id_col, F.col("c1").alias("chunk_id")).agg(F.max("sim").alias("pen")))
            scored = (remaining.join(pen, [id_col, "chunk_id"], "left")
                               .withColumn("mmr", F.lit(lam) * F.col("score")
                                           - F.lit(1.0 - lam) * F.coalesce(F.col("pen"), F.lit(0.0)))
                               .drop("pen"))
        pick = (scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                      .select(id_col, "chunk_id", F.lit(r).alias("mmr_rank")))
        selected = pick if selected is None else selected.unionByName(pick)
        remaining = remaining.join(pick.select(id_col, "chunk_id"), [id_col, "chunk_id"], "left_anti")
    return selected


def recall_at_k(retrieved: DataFrame, expected: DataFrame, questions: DataFrame, k: int,
                id_col: str = "qid") -> DataFrame:
    """X13 + J6: share of questions with >= 1 expected chunk among the top k.

    expected: (qid, chunk_id) rows; questions without expected ids are excluded.
    """
    scored_q = expected.select(id_col).distinct()
    hits = (retrieved.where(F.col("rank") <= k).select(id_col, "chunk_id")
                     .join(expected.select(id_col, "chunk_id"), [id_col, "chunk_id"], "left_semi")
                     .select(id_col).distinct().withColumn("hit", F.lit(1.0)))
    per_q = scored_q.join(hits, id_col, "left").fillna(0.0, ["hit"])
    return per_q.agg(F.lit(k).alias("k"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"),
                     F.count(F.lit(1)).alias("n_scored"))


def score_gap(retrieved: DataFrame, expected: DataFrame, id_col: str = "qid") -> DataFrame:
    """Min top-1 score over in-corpus questions vs max top-1 over out-of-corpus ones."""
    top1 = retrieved.where(F.col("rank") == 1).select(id_col, "score")
    flag = expected.select(id_col).distinct().withColumn("in_corpus", F.lit(True))
    t = top1.join(flag, id_col, "left").fillna(False, ["in_corpus"])
    return t.agg(F.min(F.when(F.col("in_corpus"), F.col("score"))).alias("min_in_corpus_top1"),
                 F.max(F.when(~F.col("in_corpus"), F.col("score"))).alias("max_out_of_corpus_top1"))


def containing(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, _p): the patterns, by place in the list, that each document holds verbatim.

    Every task builds one failure-link automaton of the patterns and runs it once over each of its texts.
    """

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        always = [i for i, p in enumerate(patterns) if not p]
        for i, p in enumerate(patterns):
            if p:
                automaton.add_word(p, i)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    hits = {i for _, i in automaton.iter(text)} if len(automaton) else set()
                    own = sorted(hits.union(always))
                    ids += [doc] * len(own)
                    found += own
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(found, pa.int32())], ["doc_id", "_p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id string, _p int")


def expected_by_containment(questions: DataFrame, docs: DataFrame, chunks: DataFrame, id_col: str = "qid",
                            text_col: str = "question", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Eval labels: every chunk of each document that contains the question text verbatim.

    The distinct question texts are dealt by hash into shards of about ``SHARD_BYTES``; for every shard an automaton runs once over
    all documents. Short questions need no other way, and no document is expanded into its substrings.
    """
    spark = questions.sparkSession
    q = questions.select(id_col, F.col(text_col).alias("_qt")).where(F.col("_qt").isNotNull())
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    each = materialize(q.select("_qt").distinct(), "question-texts")
    shards = max(1, math.ceil((each.agg(F.sum(F.octet_length("_qt"))).first()[0] or 0) / shard_bytes))
    pairs = None
    for s in range(shards):
        own = sorted(r["_qt"] for r in each.where(F.pmod(F.xxhash64("_qt"), F.lit(shards)) == s).collect())  # about shard_bytes
        named = spark.createDataFrame(list(enumerate(own)), "_p int, _qt string")
        found = materialize(containing(texts, own), "contained").join(named, "_p").select("_qt", "doc_id").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
    hits = pairs.join(q, "_qt").select(id_col, "doc_id")
    return hits.join(chunks.select("doc_id", "chunk_id"), "doc_id").select(id_col, "chunk_id")
