"""Named queries: chunking, tokenising, TF-IDF index, retrieval, MMR, recall, routing (X*, P14, S6)."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import wilson_bounds
from cohortlab.functions.text import front_matter_field, raw_tokens, sections_array, stem, strip_front_matter
from cohortlab.operators import chunking as ch
from cohortlab.operators import grouping as gr
from cohortlab.operators import retrieval as rt
from cohortlab.operators import routing as ro
from cohortlab.operators import serving as sv
from cohortlab.operators import uncertainty as un
from cohortlab.operators.prefix import ranks
from cohortlab.plans.oracle import add_view
from cohortlab.plans.q_etl import J1_SQL, features_of
from cohortlab.plans.registry import query
from cohortlab.session import ensure_checkpoint_dir, materialize
from cohortlab.sources.tables import read_markdown_corpus, spread, table

# ------------------------------------------------------------------ inputs


def doc_chunks(spark, sf_dir):
    """Documents as single chunks (chunk_id = doc_id): the SQL-checkable retrieval corpus."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"),
                    F.col("source").alias("heading"), "text", F.col("source").alias("source_url"),
                    F.lit(0).alias("sec_idx"), F.lit(0).alias("piece_idx"))


def corpus_chunks(spark, sf_dir):
    """The chunked corpus (X5) with the document source as heading when a document has none."""
    # the chunk table is an index artifact (S6) read by indexing, ranking and rendering: store it once
    return materialize(ch.chunk_documents(spread(table(spark, sf_dir, "documents")), source_url="source",
                                          fallback_heading="source"), "chunks")


def eval_questions(spark, sf_dir):
    """Benchmark passages as questions (whole text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def user_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


_SW = ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)


def _stem_sql(x: str) -> str:
    parts = []
    for suffix, repl in C.SUFFIX_RULES:
        min_len = C.STEM_MIN_LEN + len(suffix) - len(repl)
        parts.append(f"WHEN ends_with({x}, '{suffix}') AND length({x}) >= {min_len} "
                     f"THEN substr({x}, 1, length({x}) - {len(suffix)}) || '{repl}'")
    return "CASE " + " ".join(parts) + f" ELSE {x} END"


def _terms_sql(src: str, id_expr: str, text: str) -> str:
    return f"""SELECT id, {_stem_sql('raw')} AS term FROM (
      SELECT {id_expr} AS id, unnest(regexp_extract_all(lower({text}), '[a-zA-Z]{{2,}}')) AS raw FROM {src}) t
    WHERE raw NOT IN ({_SW})"""


add_view("dchunks", [], """
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents""")
add_view("ctf", ["dchunks"], f"""
  SELECT id AS chunk_id, term, count(*) AS tf FROM ({_terms_sql('dchunks', 'chunk_id', 'text')}) x GROUP BY id, term""")
add_view("cidf", ["ctf"], """
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM dchunks)) / (1.0 + count(*))) + 1.0 AS idf
  FROM ctf GROUP BY term""")
add_view("postings", ["ctf", "cidf"], """
  SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight
  FROM (SELECT chunk_id, term, tf * idf AS w FROM ctf JOIN cidf USING (term)) x""")
add_view("questions", [], "SELECT item_id AS qid, text AS question FROM benchmark")
add_view("qvec", ["questions", "cidf"], f"""
  SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS weight
  FROM (SELECT id AS qid, term, count(*) * any_value(idf) AS w
        FROM ({_terms_sql('questions', 'qid', 'question')}) x JOIN cidf USING (term) GROUP BY id, term) y""")


def _topk_sql(k: int, qvec: str = "qvec", postings: str = "postings", chunks: str = "dchunks",
              order: str = "c.chunk_id DESC", questions: str = "questions") -> str:
    return f"""
  SELECT qid, rank, chunk_id, score FROM (
    SELECT s.qid, s.chunk_id, s.score,
           row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, {order}) AS rank
    FROM (
      SELECT qid, chunk_id, round(sum(q.weight * p.weight), 9) AS score
      FROM {qvec} q JOIN {postings} p USING (term) GROUP BY qid, chunk_id
      UNION ALL
      SELECT q.qid, z.chunk_id, 0.0 FROM (SELECT DISTINCT qid FROM {questions}) q
      CROSS JOIN (SELECT chunk_id FROM {chunks} c ORDER BY {order} LIMIT {2 * k}) z
      WHERE NOT EXISTS (SELECT 1 FROM {qvec} q2 JOIN {postings} p2 USING (term)
                        WHERE q2.qid = q.qid AND p2.chunk_id = z.chunk_id)) s
    JOIN {chunks} c ON c.chunk_id = s.chunk_id) r
  WHERE rank <= {k}"""


add_view("top8", ["qvec", "postings", "dchunks", "questions"], _topk_sql(C.RETRIEVAL_TOP_K))


def _index(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    post, idf = rt.build_index(chunks)
    return chunks, post, idf


def _retrieved(spark, sf_dir, k):
    chunks, post, idf = _index(spark, sf_dir)
    return rt.retrieve(eval_questions(spark, sf_dir), chunks, post, idf, k), chunks, post


# ------------------------------------------------------------------ chunking


# Markdown-shaped documents: front matter with the source's address (not on every seventh document), an
# introduction, and a '## ' section for every line of the text.
add_view("md_documents", [], """
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '---' || chr(10) || 'title: "Document ' || CAST(doc_id AS VARCHAR) || '"' || chr(10)
           || 'source_url: https://corpus.example/' || source || '/' || CAST(doc_id AS VARCHAR) || chr(10) || '---' || chr(10) || chr(10) END
         || 'Introduction.' || chr(10) || '## Part A' || chr(10) || replace(text, chr(10), chr(10) || '## Next Part' || chr(10)) AS text
  FROM documents""")


def markdown_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.concat(F.lit('---\ntitle: "Document '), F.col("doc_id").cast("string"), F.lit('"\nsource_url: https://corpus.example/'), F.col("source"), F.lit("/"),
                    F.col("doc_id").cast("string"), F.lit("\n---\n\n"))
    body = F.concat(F.lit("Introduction.\n## Part A\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Next Part\n")))
    return d.select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(head), body).alias("text"))


@query("x1_front_matter_strip", ["md_documents"], """
  SELECT doc_id, CASE WHEN starts_with(text, '---') AND strpos(substr(text, 4), '---') > 0
                      THEN regexp_replace(substr(text, strpos(substr(text, 4), '---') + 6), '^\n+', '')
                      ELSE text END AS body
  FROM md_documents""")
def x1_front_matter_strip(spark, sf_dir):
    """Front matter removed (only leading newlines stripped after it)."""
    return markdown_documents(spark, sf_dir).select("doc_id", strip_front_matter(F.col("text")).alias("body"))


@query("x2_source_url", ["md_documents"], """
  SELECT doc_id, CASE WHEN starts_with(text, '---') THEN split_part(split_part(text, 'source_url: ', 2), chr(10), 1) END AS source_url
  FROM md_documents""")
def x2_source_url(spark, sf_dir):
    """The source address from the front matter; null without one."""
    return markdown_documents(spark, sf_dir).select("doc_id", front_matter_field(F.col("text"), "source_url").alias("source_url"))


@query("x3_sections", ["md_documents"], """
  SELECT doc_id, sec_idx, trim(split_part(p, chr(2), 1), ' \t\n\r\f' || chr(11)) AS heading,
         trim(substr(p, strpos(p, chr(2)) + 1), ' \t\n\r\f' || chr(11)) AS body
  FROM (SELECT doc_id, unnest(parts) AS p, unnest(range(length(parts))) AS sec_idx FROM (
          SELECT doc_id, string_split(regexp_replace(text, '(?m)^##\\s+(.+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS parts
          FROM md_documents) a) b""")
def x3_sections(spark, sf_dir):
    """X3: '## ' sections per document (preamble dropped)."""
    d = markdown_documents(spark, sf_dir)
    s = d.select("doc_id", F.posexplode(sections_array(F.col("text"))).alias("sec_idx", "sec"))
    return s.select("doc_id", "sec_idx", F.col("sec.heading").alias("heading"), F.col("sec.body").alias("body"))


@query("s5_markdown_corpus", [], """
  SELECT CAST(item_id AS VARCHAR) AS doc_id, length(text) + 10 AS n_chars FROM benchmark""")
def s5_markdown_corpus(spark, sf_dir):
    """Every benchmark passage as a Markdown file of its own, read back through the corpus reader."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("## Item\n\n"), "text").alias("value"), F.col("item_id").cast("string").alias("item"))
    # one folder per item: Spark's writer names the files, the folder carries the id
    items.repartition("item").write.partitionBy("item").text(base)  # the writer ends the file with a line break
    got = read_markdown_corpus(spark, base, pattern="item=*/*.txt", by_folder=True)
    return got.select(F.replace(F.col("doc_id"), F.lit("item="), F.lit("")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"))


_WSR = "[ \\t\\n\\r\\f\\x0B]"  # same whitespace class as the Spark side
_TRIMC = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _words_duck(x: str) -> str:
    return (f"(CASE WHEN trim({x}, {_TRIMC}) = '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array(trim({x}, {_TRIMC}), '{_WSR}+') END)")


def _chunks_sql(target: int = C.CHUNK_TARGET_WORDS, overlap: int = C.CHUNK_OVERLAP_WORDS,
                limit: int = C.CHUNK_MAX_SECTION_WORDS) -> str:
    """The chunker in DuckDB SQL: same section split, sentence split, run-on windows and greedy fold."""
    stride = max(target - overlap, 1)
    sents = f"string_split(regexp_replace(body, '([.!?]){_WSR}+', '\\1' || chr(1), 'g'), chr(1))"
    runon = (f"list_transform(range(0, CAST(ceil(len({_words_duck('body')}) / {stride}.0) AS BIGINT)), "
             f"lambda i: array_to_string(list_slice({_words_duck('body')}, i * {stride} + 1, i * {stride} + {target}), ' '))")
    units = f"(CASE WHEN len({sents}) = 1 AND len({_words_duck('body')}) > {2 * target} THEN {runon} ELSE {sents} END)"
    items = f"list_transform({units}, lambda x: {{'s': x, 'ws': {_words_duck('x')}}})"
    cur2 = "(CASE WHEN acc.n = 0 THEN it.s ELSE acc.cur || ' ' || it.s END)"
    tw2 = (f"list_slice(list_concat(acc.tw, it.ws), greatest(len(acc.tw) + len(it.ws) - {overlap} + 1, 1), "
           f"len(acc.tw) + len(it.ws))")
    step = (f"CASE WHEN acc.w + len(it.ws) >= {target} "
            f"THEN {{'pieces': list_append(acc.pieces, {cur2}), 'cur': array_to_string({tw2}, ' '), 'n': 1, "
            f"'w': len({tw2}), 'tw': {tw2}}} "
            f"ELSE {{'pieces': acc.pieces, 'cur': {cur2}, 'n': acc.n + 1, 'w': acc.w + len(it.ws), 'tw': {tw2}}} END")
    init = "{'pieces': []::VARCHAR[], 'cur': '', 'n': 0, 'w': 0, 'tw': []::VARCHAR[]}"
    fold = f"list_reduce({items}, lambda acc, it: {step}, {init})"
    finish = (f"(CASE WHEN f.n > 0 AND trim(f.cur, {_TRIMC}) <> '' THEN list_append(f.pieces, f.cur) ELSE f.pieces END)")
    return f"""
  WITH d AS (
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, source,
           CASE WHEN starts_with(text, '---') AND strpos(substr(text, 4), '---') > 0
                THEN regexp_replace(substr(text, strpos(substr(text, 4), '---') + 6), '^\\n+', '') ELSE text END AS b
    FROM documents),
  m AS (SELECT doc_id, source, b, string_split(regexp_replace(b, '(?m)^##\\s+(.+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pcs FROM d),
  secs AS (SELECT doc_id, source,
                  CASE WHEN len(pcs) > 1 THEN list_transform(pcs[2:], lambda p: {{'heading': trim(split_part(p, chr(2), 1), {_TRIMC}),
                                                                       'body': trim(substr(p, strpos(p, chr(2)) + 1), {_TRIMC})}})
                       ELSE [{{'heading': trim(source, {_TRIMC}), 'body': trim(b, {_TRIMC})}}] END AS sl
           FROM m),
  s AS (SELECT doc_id, source, unnest(sl) AS sec, unnest(range(len(sl))) AS sec_idx FROM secs),
  s2 AS (SELECT doc_id, source, sec_idx, sec.heading AS heading, sec.body AS body FROM s),
  fo AS (SELECT doc_id, source, sec_idx, heading,
                CASE WHEN len({_words_duck('body')}) <= {limit} THEN [body]
                     ELSE (SELECT {finish} FROM (SELECT {fold} AS f) z) END AS pieces
         FROM s2),
  pe AS (SELECT doc_id, source, sec_idx, heading, len(pieces) AS n_pieces, unnest(pieces) AS text,
                unnest(range(len(pieces))) AS piece_idx FROM fo)
  SELECT doc_id || '::' || replace(lower(heading), ' ', '_')
           || CASE WHEN n_pieces > 1 THEN '_' || CAST(piece_idx AS VARCHAR) ELSE '' END AS chunk_id,
         doc_id, heading, text, source AS source_url, sec_idx, piece_idx
  FROM pe"""


add_view("chunks", [], _chunks_sql())
add_view("ktf", ["chunks"], f"""
  SELECT id AS chunk_id, term, count(*) AS tf FROM ({_terms_sql('chunks', 'chunk_id', 'text')}) x GROUP BY id, term""")
add_view("kidf", ["ktf"], """
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1.0 AS idf
  FROM ktf GROUP BY term""")
add_view("kpostings", ["ktf", "kidf"], """
  SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight
  FROM (SELECT chunk_id, term, tf * idf AS w FROM ktf JOIN kidf USING (term)) x""")
add_view("kqvec", ["questions", "kidf"], f"""
  SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS weight
  FROM (SELECT id AS qid, term, count(*) * any_value(idf) AS w
        FROM ({_terms_sql('questions', 'qid', 'question')}) x JOIN kidf USING (term) GROUP BY id, term) y""")
add_view("ktop8", ["kqvec", "kpostings", "chunks", "questions"],
         _topk_sql(C.RETRIEVAL_TOP_K, "kqvec", "kpostings", "chunks",
                   "c.doc_id DESC, c.sec_idx DESC, c.piece_idx DESC"))
add_view("ktop8f", ["ktop8"], "SELECT * FROM ktop8 WHERE score >= 0.15")


@query("x5_chunks", ["chunks"], "SELECT chunk_id, doc_id, heading, text, source_url FROM chunks")
def x5_chunks(spark, sf_dir):
    """The chunked corpus (greedy sentence packing with overlap); checked by brute force in tests."""
    return corpus_chunks(spark, sf_dir).select("chunk_id", "doc_id", "heading", "text", "source_url")


@query("x21_chunks_per_document", ["chunks"], "SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def x21_chunks_per_document(spark, sf_dir):
    """Chunks per document."""
    return ch.chunks_per_document(corpus_chunks(spark, sf_dir))


# ------------------------------------------------------------------ tokens and index


@query("x6_term_counts", ["ctf"], "SELECT chunk_id, term, tf FROM ctf")
def x6_term_counts(spark, sf_dir):
    """X6 + X7: stop-word-filtered, stemmed term counts per chunk."""
    return rt.term_counts(doc_chunks(spark, sf_dir), "chunk_id", "text")


@query("x7_stems", [], f"""
  SELECT DISTINCT raw, {_stem_sql('raw')} AS term FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z]{{2,}}')) AS raw FROM documents) t""")
def x7_stems(spark, sf_dir):
    """Suffix stemmer over the whole raw vocabulary."""
    d = spread(table(spark, sf_dir, "documents"))
    raw = d.select(F.explode(raw_tokens(F.col("text"))).alias("raw")).distinct()
    return raw.select("raw", stem(F.col("raw")).alias("term"))


@query("x8_idf", ["cidf"], "SELECT term, df, round(idf, 9) AS idf FROM cidf")
def x8_idf(spark, sf_dir):
    """Smooth idf table."""
    _, _, idf = _index(spark, sf_dir)
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query("x8_postings", ["postings"], "SELECT chunk_id, term, round(weight, 9) AS weight FROM postings")
def x8_postings(spark, sf_dir):
    """L2-normalised tf-idf postings (the sparse index)."""
    _, post, _ = _index(spark, sf_dir)
    return post.select("chunk_id", "term", F.round("weight", 9).alias("weight"))


@query("s6_index_roundtrip", ["postings"], "SELECT chunk_id, term, round(weight, 9) AS weight FROM postings")
def s6_index_roundtrip(spark, sf_dir):
    """Postings written as parquet to the shared checkpoint folder and read back."""
    _, post, _ = _index(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), f"index-{uuid.uuid4().hex}", "postings")
    post.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("chunk_id", "term", F.round("weight", 9).alias("weight"))


@query("x9_query_vectors", ["qvec"], "SELECT qid, term, round(weight, 9) AS weight FROM qvec")
def x9_query_vectors(spark, sf_dir):
    """Query vectors; out-of-vocabulary terms dropped."""
    _, _, idf = _index(spark, sf_dir)
    q = rt.vectorize_queries(eval_questions(spark, sf_dir), idf)
    return q.select("qid", "term", F.round("weight", 9).alias("weight"))


@query("x10_retrieve_top8", ["top8"], "SELECT * FROM top8")
def x10_retrieve_top8(spark, sf_dir):
    """X10 + J5 + K4: cosine top-8 per question, zero-score chunks fill k (latest chunk first)."""
    r, _, _ = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    return r


@query("p14_relevance_filter", ["top8"], "SELECT * FROM top8 WHERE score >= 0.15")
def p14_relevance_filter(spark, sf_dir):
    """Candidates at or above the 0.15 floor."""
    r, _, _ = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    return rt.relevance_filter(r)


def _mmr_sql(cands: str, k: int, lam: float, postings: str = "postings") -> str:
    """Greedy MMR rounds as CTEs over a candidate view (qid, rank, chunk_id, score)."""
    ctes = [f"""cp AS (SELECT c.qid, c.chunk_id, p.term, p.weight FROM {cands} c JOIN {postings} p USING (chunk_id))""",
            """sim AS (SELECT a.qid, a.chunk_id AS c1, b.chunk_id AS c2, round(sum(a.weight * b.weight), 9) AS sim
                       FROM cp a JOIN cp b ON a.qid = b.qid AND a.term = b.term GROUP BY a.qid, a.chunk_id, b.chunk_id)"""]
    sel = []
    for r in range(1, k + 1):
        prev = " UNION ALL ".join(f"SELECT qid, chunk_id FROM pick{i}" for i in range(1, r)) or None
        if prev:
            pen = (f"(SELECT max(s.sim) FROM sim s WHERE s.qid = c.qid AND s.c1 = c.chunk_id AND s.c2 IN "
                   f"(SELECT chunk_id FROM ({prev}) pv WHERE pv.qid = c.qid))")
            mmr = f"{lam!r} * c.score - {1.0 - lam!r} * coalesce({pen}, 0.0)"
            rem = f"WHERE NOT EXISTS (SELECT 1 FROM ({prev}) pv WHERE pv.qid = c.qid AND pv.chunk_id = c.chunk_id)"
        else:
            mmr, rem = f"{lam!r} * c.score", ""
        ctes.append(f"""pick{r} AS (SELECT qid, chunk_id FROM (
            SELECT c.qid, c.chunk_id, row_number() OVER (PARTITION BY c.qid ORDER BY {mmr} DESC, c.rank ASC) AS rr
            FROM {cands} c {rem}) x WHERE rr = 1)""")
        sel.append(f"SELECT qid, chunk_id, {r} AS mmr_rank FROM pick{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(sel)


@query("x11_mmr_rerank", ["top8", "postings"], _mmr_sql("top8", C.RERANK_K, C.MMR_LAMBDA))
def x11_mmr_rerank(spark, sf_dir):
    """X11: MMR (lambda 0.6, k 3) over the top-8 candidates."""
    r, _, post = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    return rt.mmr_rerank(r, post)


add_view("top8f", ["top8"], "SELECT * FROM top8 WHERE score >= 0.15")


@query("x12_retrieve_filter_rerank", ["top8f", "postings"], _mmr_sql("top8f", C.RERANK_K, C.MMR_LAMBDA))
def x12_retrieve_filter_rerank(spark, sf_dir):
    """Retrieve 8 -> drop below 0.15 -> MMR rerank to 3."""
    r, _, post = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    return rt.mmr_rerank(rt.relevance_filter(r), post)


add_view("expected", ["questions", "dchunks"], """
  SELECT q.qid, c.chunk_id FROM questions q JOIN documents d ON contains(d.text, q.question)
  JOIN dchunks c ON c.doc_id = CAST(d.doc_id AS VARCHAR)""")


def _recall_sql(k: int) -> str:
    return f"""SELECT {k} AS k, coalesce(avg(CASE WHEN h.qid IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS recall,
         count(*) AS n_scored
  FROM (SELECT DISTINCT qid FROM expected) e
  LEFT JOIN (SELECT DISTINCT t.qid FROM ({_topk_sql(k)}) t JOIN expected x ON x.qid = t.qid AND x.chunk_id = t.chunk_id) h
  ON h.qid = e.qid"""


@query("x13_recall_at_k", ["expected", "qvec", "postings", "dchunks", "questions"],
       f"{_recall_sql(3)} UNION ALL {_recall_sql(5)}")
def x13_recall_at_k(spark, sf_dir):
    """X13 + J6 + O4: recall@3 and recall@5; questions without expected chunks excluded."""
    chunks, post, idf = _index(spark, sf_dir)
    q = eval_questions(spark, sf_dir)
    exp = rt.expected_by_containment(q, spread(table(spark, sf_dir, "documents")), chunks)
    exp = materialize(exp, "expected")
    top = materialize(rt.retrieve(q, chunks, post, idf, 5), "top5")  # the top 3 are its first three ranks
    return rt.recall_at_k(top, exp, q, 3).unionByName(rt.recall_at_k(top, exp, q, 5))


@query("x14_score_gap", ["expected", "top8"], """
  SELECT min(CASE WHEN e.qid IS NOT NULL THEN t.score END) AS min_in_corpus_top1,
         max(CASE WHEN e.qid IS NULL THEN t.score END) AS max_out_of_corpus_top1
  FROM (SELECT qid, score FROM top8 WHERE rank = 1) t LEFT JOIN (SELECT DISTINCT qid FROM expected) e USING (qid)""")
def x14_score_gap(spark, sf_dir):
    """In-corpus vs out-of-corpus top-1 score gap."""
    r, chunks, _ = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    q = eval_questions(spark, sf_dir)
    exp = rt.expected_by_containment(q, spread(table(spark, sf_dir, "documents")), chunks)
    return rt.score_gap(r, exp)


# ------------------------------------------------------------------ routing and answers

def _strip_sql(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def _intent_sql(x: str) -> str:
    q = f"lower({_strip_sql(x)})"
    g = " OR ".join(f"regexp_matches({q}, '{p}')" for p in C.GREETING_PATTERNS)
    a = " OR ".join(f"regexp_matches({q}, '{p}')" for p in C.ABOUT_PREDICTION_PATTERNS)
    t = " OR ".join(f"contains({q}, '{w}')" for w in C.GENERAL_TOPIC_KEYWORDS)
    return (f"CASE WHEN {g} THEN 'greeting' WHEN {a} THEN 'about_prediction' "
            f"WHEN {t} THEN 'general' ELSE 'out_of_scope' END")


def _feature_sql(x: str) -> str:
    q = f"lower({x})"
    whens = " ".join("WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in kws) + f" THEN '{f}'"
                     for f, kws in C.FEATURE_KEYWORDS)
    return f"CASE {whens} END"


add_view("user_questions", [], "SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'")


@query("x15_intent", ["user_questions"], f"SELECT qid, {_intent_sql('question')} AS intent FROM user_questions")
def x15_intent(spark, sf_dir):
    """Ordered intent rules over every user turn."""
    return user_questions(spark, sf_dir).select("qid", ro.classify_intent(F.col("question")).alias("intent"))


@query("x16_named_feature", ["user_questions"], f"SELECT qid, {_feature_sql('question')} AS named_feature FROM user_questions")
def x16_named_feature(spark, sf_dir):
    """First feature keyword found (substring, rule order)."""
    return user_questions(spark, sf_dir).select("qid", ro.find_named_feature(F.col("question")).alias("named_feature"))


@query("x19_render_retrieved", ["top8f", "postings", "questions"], f"""
  WITH rr AS ({_mmr_sql("top8f", C.RERANK_K, C.MMR_LAMBDA)}),
  lines AS (SELECT rr.qid, rr.mmr_rank,
                   '- **' || d.source || '** (' || CAST(d.doc_id AS VARCHAR) || '): ' || d.text || chr(10)
                   || '  Source: ' || coalesce(d.source, 'None') AS line
            FROM rr JOIN documents d ON CAST(d.doc_id AS VARCHAR) = rr.chunk_id),
  per AS (SELECT qid, '## Related context' || chr(10) || string_agg(line, chr(10) ORDER BY mmr_rank) AS answer
          FROM lines GROUP BY qid)
  SELECT q.qid, coalesce(per.answer, '## Related context' || chr(10)
                         || 'Nothing in the local corpus matched this question.') AS answer
  FROM questions q LEFT JOIN per USING (qid)""")
def x19_render_retrieved(spark, sf_dir):
    """Rendered 'Related context' per question from the reranked chunks."""
    r, chunks, post = _retrieved(spark, sf_dir, C.RETRIEVAL_TOP_K)
    rr = rt.mmr_rerank(rt.relevance_filter(r), post)
    return ro.render_retrieved(rr, chunks, eval_questions(spark, sf_dir))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


add_view("ugen", ["user_questions"], f"""
  SELECT qid, question FROM user_questions WHERE ({_intent_sql('question')}) = 'general'""")
add_view("uqvec", ["ugen", "kidf"], f"""
  SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS weight
  FROM (SELECT id AS qid, term, count(*) * any_value(idf) AS w
        FROM ({_terms_sql('ugen', 'qid', 'question')}) x JOIN kidf USING (term) GROUP BY id, term) y""")
add_view("utop8f", ["uqvec", "kpostings", "chunks", "ugen"], "SELECT * FROM (" + _topk_sql(
    C.RETRIEVAL_TOP_K, "uqvec", "kpostings", "chunks", "c.doc_id DESC, c.sec_idx DESC, c.piece_idx DESC", "ugen")
    + ") t WHERE score >= 0.15")


#: What a company's scorecard adds up, in the order of the facts table.
CARD = C.CLEAN_CATEGORICAL_FEATURES


def company_facts(spark, sf_dir):
    """X17 without a fitted model: facts of every test company from a scorecard of training rates.

    A feature contributes its group's success rate above the base rate (groups below the cohort size: nothing); the raw score adds the
    contributions to the base rate, the probability their mean. Its percentile is among the training companies, its band the
    Wilson interval of its cohort, or the point itself where the two do not meet.
    """
    f = materialize(features_of(spark, sf_dir, columns=["permalink", "name", "primary_category", "country_code", "region", "funding_total_usd"]), "companies")
    train = f.where(F.col("split") == "train")
    base = train.agg(F.avg(F.col("label").cast("double")).alias("base"))  # one row
    j = f.crossJoin(F.broadcast(base))
    for c in CARD:
        rates = gr.grouped_success_rate(train, c).select(F.col(c).alias("_v"), F.col("success_rate").alias("_r"))
        j = j.join(rates, F.col(c) == F.col("_v"), "left").withColumn(f"{c}_shap", F.round(F.coalesce("_r", "base") - F.col("base"), 3)).drop("_v", "_r")
    total = F.col(f"{CARD[0]}_shap") + F.col(f"{CARD[1]}_shap") + F.col(f"{CARD[2]}_shap")
    clip = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)
    j = materialize(j.withColumn("raw_score", clip(F.col("base") + total)).withColumn("probability", clip(F.col("base") + total / 3)), "scorecards")
    test = j.where(F.col("split") == "test").withColumn("request_id", F.col("permalink"))
    cohorts = gr.cohort_lookup(test.select("request_id", "country_code", "primary_category", "funding_total_usd"), f)
    scored = un.percentile_of(test, j.where(F.col("split") == "train"), "probability", "probability").select(
        "request_id", "name", "raw_score", "probability", "percentile", F.array(*[F.struct(
            F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"{c}_shap").alias("shap_value"),
            F.when(F.col(f"{c}_shap") > 0, "increases").otherwise("decreases").alias("direction")) for c in CARD]).alias("contributions"))
    n = F.coalesce("cohort_n", F.lit(0))
    low, high = wilson_bounds(F.coalesce(F.round(F.col("cohort_success_rate") * F.col("cohort_n")), F.lit(0.0)), F.nullif(n, F.lit(0)))
    banded = scored.join(cohorts.select("request_id", "cohort_n", "cohort_success_rate"), "request_id").withColumn(
        "band_lower", F.round(F.coalesce(low, F.lit(0.0)), 6)).withColumn("band_upper", F.round(F.coalesce(high, F.lit(1.0)), 6)).drop("cohort_n", "cohort_success_rate")
    whole = un.collapse_on_failure(banded)
    return sv.facts(whole, cohorts).join(whole.select("request_id", "name"), "request_id")


def _shown(x: str, digits: int) -> str:
    """``x`` rounded half up in its shortest decimal form, as the JVM's formatter does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(28, 20)), {digits}) AS DOUBLE)"


_Z = C.WILSON_Z[0.90]
add_view("scorecards", ["features"], f"""
  SELECT f.*, b.base, {", ".join(f"round(coalesce(r{i}.rate, b.base) - b.base, 3) + 0.0 AS shap{i}" for i in range(len(CARD)))}
  FROM features f CROSS JOIN (SELECT avg(CAST(label AS DOUBLE)) AS base FROM features WHERE split = 'train') b
  """ + " ".join(f"""LEFT JOIN (SELECT {c} AS v, avg(CAST(label AS DOUBLE)) AS rate FROM features WHERE split = 'train' AND {c} IS NOT NULL
                            GROUP BY 1 HAVING count(*) >= {C.MIN_COHORT_SIZE}) r{i} ON r{i}.v = f.{c}""" for i, c in enumerate(CARD)))
add_view("scored_companies", ["scorecards"], """
  SELECT *, round(greatest(0.0, least(1.0, base + (shap0 + shap1 + shap2))), 6) AS raw_score,
         round(greatest(0.0, least(1.0, base + (shap0 + shap1 + shap2) / 3)), 6) AS probability FROM scorecards""")
add_view("company_cohorts", ["features"], J1_SQL)
add_view("company_facts", ["scored_companies", "company_cohorts"], f"""
  SELECT permalink AS request_id, name, {", ".join(CARD)}, shap0, shap1, shap2, raw_score, probability, percentile, level, h.country_code AS cohort_country, cohort_category,
         cohort_n, cohort_success_rate,
         CASE WHEN lo <= probability AND probability <= hi THEN lo ELSE probability END AS band_lower,
         CASE WHEN lo <= probability AND probability <= hi THEN hi ELSE probability END AS band_upper
  FROM (SELECT s.* EXCLUDE (country_code), s.country_code, c.percentile, k.* EXCLUDE (request_id, country_code), k.country_code AS kc,
               CASE WHEN k.cohort_n IS NULL THEN 0.0 ELSE round(greatest(0.0, (ph + z2 / (2.0 * n) - {_Z!r} * sqrt(ph * (1.0 - ph) / n + z2 / (4.0 * n * n))) / (1.0 + z2 / n)), 6) END AS lo,
               CASE WHEN k.cohort_n IS NULL THEN 1.0 ELSE round(least(1.0, (ph + z2 / (2.0 * n) + {_Z!r} * sqrt(ph * (1.0 - ph) / n + z2 / (4.0 * n * n))) / (1.0 + z2 / n)), 6) END AS hi
        FROM scored_companies s JOIN (SELECT *, CAST(cohort_n AS DOUBLE) AS n, round(cohort_success_rate * cohort_n) / CAST(cohort_n AS DOUBLE) AS ph, {_Z!r} * {_Z!r} AS z2
                                      FROM company_cohorts) k ON k.request_id = s.permalink
        JOIN (SELECT probability AS v, 100.0 * sum(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)) OVER (ORDER BY probability)
                     / (SELECT count(*) FROM features WHERE split = 'train') AS percentile FROM scored_companies GROUP BY 1) c ON c.v = s.probability
        WHERE s.split = 'test') h""".replace("h.country_code AS cohort_country", "kc AS cohort_country"))


def _facts_sql(asked: str) -> str:
    """SQL text of the facts of a ``company_facts`` row, the feature ``asked`` in front."""
    pct = lambda x: f"printf('%.1f%%', {_shown(f'100 * {x}', 1)})"
    nl = "chr(10)"
    way = [f"CASE WHEN shap{i} > 0 THEN 'increases' ELSE 'decreases' END" for i in range(len(CARD))]
    signed = [f"printf('%+.3f', shap{i})" for i in range(len(CARD))]
    value = [f"coalesce({c}, 'None')" for c in CARD]
    rows = [f"'| `{c}` | ' || {value[i]} || ' | ' || {signed[i]} || ' | ' || {way[i]} || ' |'" for i, c in enumerate(CARD)]
    named = " ".join(f"WHEN {asked} = '{c}' THEN '- You asked about `{c}`: it ' || {way[i]} || ' the score (SHAP ' || {signed[i]} || ', value = ' || {value[i]} || ').' || {nl}"
                     for i, c in enumerate(CARD))
    head = f" || {nl} || ".join([
        _lit(C.FACTS_HEADER), f"{_lit(C.FACTS_PROBABILITY)} || {pct('probability')} || {_lit(C.FACTS_BAND)} || {pct('band_lower')} || '-' || {pct('band_upper')} || ')'",
        f"{_lit(C.FACTS_RAW)} || {pct('raw_score')} || {_lit(C.FACTS_RAW_NOTE)}",
        f"{_lit(C.FACTS_PERCENTILE)} || printf('%.1f%%', {_shown('percentile', 1)}) || '**'"])
    table = f" || {nl} || ".join(["''", *[_lit(x) for x in C.FACTS_TABLE_HEAD], *rows])
    cohort = (f"CASE WHEN level IS NULL THEN {_lit(C.NO_COHORT_TEXT)} ELSE {_lit(C.FACTS_COHORT)} || replace(replace(level, '+', ' + '), '_', ' ') || ' = ' || cohort_country "
              f"|| coalesce(', ' || cohort_category, '') || ', n=' || cohort_n || {_lit(C.FACTS_COHORT_RATE)} || {pct('cohort_success_rate')} || {_lit(C.FACTS_COHORT_END)} END")
    return f"({head} || {nl} || (CASE {named} ELSE '' END) || {table} || {nl} || {cohort})"


@query("x18_facts_text", ["company_facts"], f"""
  SELECT request_id, {_facts_sql("CASE CAST(name AS BIGINT) % 3 WHEN 0 THEN 'country_code' WHEN 1 THEN 'primary_category' END")} AS answer FROM company_facts""")
def x18_facts_text(spark, sf_dir):
    """X17 + X18: facts of every test company as text, with the feature asked about (if any) in front."""
    k = F.col("name").cast("bigint") % 3
    facts = company_facts(spark, sf_dir).withColumn("asked", F.when(k == 0, "country_code").when(k == 1, "primary_category"))
    return sv.render_facts(facts, foreground=F.col("asked"))


@query("x20_answers", ["user_questions", "utop8f", "kpostings", "chunks", "company_facts"], f"""
  WITH rr AS ({_mmr_sql("utop8f", C.RERANK_K, C.MMR_LAMBDA, "kpostings")}),
  lines AS (SELECT rr.qid, rr.mmr_rank,
                   '- **' || c.heading || '** (' || c.doc_id || '): ' || c.text || chr(10)
                   || '  Source: ' || coalesce(c.source_url, 'None') AS line
            FROM rr JOIN chunks c USING (chunk_id)),
  per AS (SELECT qid, '## Related context' || chr(10) || string_agg(line, chr(10) ORDER BY mmr_rank) AS answer
          FROM lines GROUP BY qid),
  routed AS (SELECT qid, qid // 1000 AS k, {_intent_sql('question')} AS intent, {_feature_sql('question')} AS asked FROM user_questions)
  SELECT r.qid, r.intent,
         CASE WHEN r.intent = 'greeting' THEN {_lit(C.CAPABILITY_STATEMENT)}
              WHEN r.intent = 'about_prediction' THEN CASE WHEN k % 4 = 3 OR held.request_id IS NULL THEN {_lit(C.NO_PREDICTION_TEXT)} ELSE {_facts_sql("asked")} END
              WHEN r.intent = 'general' THEN coalesce(per.answer, {_lit(C.NOTHING_MATCHED_TEXT)})
              ELSE {_lit(C.OUT_OF_SCOPE_TEXT + C.CAPABILITY_STATEMENT)} END AS answer
  FROM routed r LEFT JOIN per USING (qid)
  LEFT JOIN (SELECT *, row_number() OVER (ORDER BY CAST(name AS BIGINT)) - 1 AS place FROM company_facts) held
  ON held.place = k % (SELECT count(*) FROM company_facts)""")
def x20_answers(spark, sf_dir):
    """Answer per user turn by intent: general -> retrieve/filter/rerank over the chunked corpus;
    about_prediction -> the session's facts with the question's own feature in front (every fourth
    conversation holds no prediction yet)."""
    qs = user_questions(spark, sf_dir)
    routed = ro.route(qs)
    general = routed.where(F.col("intent") == "general").select("qid", "question")
    chunks = corpus_chunks(spark, sf_dir)
    post, idf = rt.build_index(chunks)
    r = rt.retrieve(general, chunks, post, idf, C.RETRIEVAL_TOP_K)
    rr = rt.mmr_rerank(rt.relevance_filter(r), post)
    about = routed.where(F.col("intent") == "about_prediction").withColumn("k", F.floor(F.col("qid") / 1000)).where("k % 4 <> 3")
    held = materialize(company_facts(spark, sf_dir).withColumn("_name", F.col("name").cast("bigint")), "company-facts")
    n_held = held.count()
    placed = ranks(held, "_name").select((F.col("rank") - 1).alias("place"), "facts")  # the k-th conversation is about the k-th company, and round again
    facts = (about.select(F.col("qid").alias("request_id"), (F.col("k") % max(n_held, 1)).alias("place"), "named_feature")
             .join(placed, "place"))
    text = sv.render_facts(facts, foreground=F.col("named_feature")).withColumnRenamed("request_id", "qid")
    return ro.answer(qs, ro.render_retrieved(rr, chunks, general), text)


@query("x12_chunk_pipeline", ["ktop8f", "kpostings"], _mmr_sql("ktop8f", C.RERANK_K, C.MMR_LAMBDA, "kpostings"))
def x12_chunk_pipeline(spark, sf_dir):
    """X12 over the real chunked corpus: retrieve 8, filter, rerank 3 for every benchmark question."""
    chunks = corpus_chunks(spark, sf_dir)
    post, idf = rt.build_index(chunks)
    r = rt.retrieve(eval_questions(spark, sf_dir), chunks, post, idf, C.RETRIEVAL_TOP_K)
    return rt.mmr_rerank(rt.relevance_filter(r), post)
