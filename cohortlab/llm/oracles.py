"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

from cohortlab.llm import clusters as c
from cohortlab.llm import quality_rules as q
from cohortlab.llm import urls

_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    names = list(q.MEASURES)
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS bucket FROM b" for m in names)
    limit = "CASE measure " + " ".join(f"WHEN '{m}' THEN {{}}" for m in names) + " END"
    low = limit.format(*[lo if lo is not None else "NULL" for lo, _ in q.MEASURES.values()])
    high = limit.format(*[hi for _, hi in q.MEASURES.values()])

    def level(name: str, by: list[str]) -> str:
        keys = "".join(f"{k}, " for k in by)
        part = f"PARTITION BY {keys}measure"
        return (f"{name}_h AS (SELECT {keys}measure, bucket, count(*) AS n FROM long GROUP BY ALL), "
                f"{name}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS total FROM {name}_h), "
                f"{name}_q AS (SELECT {keys}measure, max(total) AS docs, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 "
                f"FROM {name}_c GROUP BY {keys}measure), "
                f"{name} AS (SELECT {keys}measure, docs, q1 - {q.FENCE} * (q3 - q1) - {low} AS lo, q3 + {q.FENCE} * (q3 - q1) + {high} AS hi FROM {name}_q)")

    fails = [f"CASE WHEN b.{m} > m_{m}.hi OR coalesce(b.{m} < m_{m}.lo, false) THEN '{m}' END" for m in names]
    joins = " ".join(f"JOIN t m_{m} ON m_{m}.measure = '{m}' AND m_{m}.lang IS NOT DISTINCT FROM b.lang AND m_{m}.source IS NOT DISTINCT FROM b.source" for m in names)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {q.NGRAM - 1}], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {q.NGRAM - 2})) AS i FROM w WHERE len(words) >= {q.NGRAM})),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {q.NGRAM})) AS p FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN v ON v.doc_id = w.doc_id),
b AS (SELECT *, CASE WHEN word_chars > 0 THEN least(1000 * n_symbols // word_chars, {q.TOP}) ELSE 0 END AS symbols,
      CASE WHEN n_lines > 0 THEN least(1000 * n_dup_lines // n_lines, {q.TOP}) ELSE 0 END AS dup_lines,
      CASE WHEN n_words > 0 THEN least(1000 * n_repeat_words // n_words, {q.TOP}) ELSE 0 END AS repeats,
      CASE WHEN word_chars > 0 THEN least(1000 * n_upper // word_chars, {q.TOP}) ELSE 0 END AS upper,
      CASE WHEN n_words > 0 THEN least(10 * word_chars // n_words, {q.TOP}) ELSE 0 END AS word_length FROM c),
long AS ({long}),
{level("own", ["lang", "source"])}, {level("wide", ["lang"])}, {level("whole", [])},
t AS (SELECT o.lang, o.source, o.measure,
      CASE WHEN o.docs >= {q.GROUP} THEN o.lo WHEN l.docs >= {q.GROUP} THEN l.lo ELSE a.lo END AS lo,
      CASE WHEN o.docs >= {q.GROUP} THEN o.hi WHEN l.docs >= {q.GROUP} THEN l.hi ELSE a.hi END AS hi
      FROM own o JOIN wide l ON l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang JOIN whole a ON a.measure = o.measure),
f AS (SELECT b.*, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed,
      concat_ws(',', {', '.join(fails)}) AS failed FROM b {joins})
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontaminate_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH i AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{word}') AS w FROM benchmark),
iw AS (SELECT item_id, span, array_to_string(w[p:p + span - 1], ' ') AS gram FROM (
         SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM (SELECT *, least(10, len(w)) AS span FROM i WHERE len(w) > 0))),
k AS (SELECT DISTINCT span, gram FROM iw),
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{word}') AS w FROM documents),
dw AS (SELECT doc_id, span, p, array_to_string(w[p:p + span - 1], ' ') AS gram FROM (
         SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM d JOIN (SELECT DISTINCT span FROM k) ON len(w) >= span)),
h AS (SELECT doc_id, span, p, gram FROM dw JOIN k USING (span, gram)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list(item ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM (SELECT DISTINCT doc_id, span, gram FROM h) JOIN iw USING (span, gram)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def near_dedup_sql() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS sig FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS both_ FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * both_ >= 75 * (p.n + q.n - both_)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept,
       CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.sig) END AS class_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


def substring_dedup_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, x FROM (SELECT g.doc_id, unnest(range(p, p + 13)) AS x FROM g JOIN m USING (gram) WHERE least < g.doc_id)),
k AS (SELECT t.doc_id, count(c.x) AS n_removed, string_agg(CASE WHEN c.x IS NULL THEN word END, ' ' ORDER BY t.x) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d) t LEFT JOIN c ON c.doc_id = t.doc_id AND c.x = t.x GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def url_filter_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""
WITH r(host, path, verdict) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
b AS (SELECT p.*, (SELECT arg_max([r.host || r.path, r.verdict], length(r.host || r.path)) FROM r
                   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM p),
l AS (SELECT host FROM b WHERE host <> '' GROUP BY host
      HAVING count(*) FILTER (best[2] = 'block') * {urls.SHARE} >= count(*) AND count(*) FILTER (best[2] = 'block') > 0 AND count(*) FILTER (best[2] = 'allow') = 0)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
       host IN (SELECT host FROM l) AS listed FROM b"""


def centroid_clusters_sql() -> str:
    """Rounds by brute force: every vector against every centroid, one row per component."""
    parts = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
     WHERE len(embedding) = {c.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.DIMENSIONS}),
e AS MATERIALIZED (SELECT id, unnest(x) AS c, unnest(range(1, {c.DIMENSIONS} + 1)) AS d FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < {c.CENTROIDS})"""]
    for i in range(c.ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT id, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
      SELECT e.id, m.k, sum((e.c - m.c) * (e.c - m.c)) AS dist FROM e JOIN (SELECT k, unnest(x) AS c, unnest(range(1, {c.DIMENSIONS} + 1)) AS d FROM c{i}) m USING (d) GROUP BY ALL) GROUP BY id)""")
        if i < c.ROUNDS:
            parts.append(f"""
s{i} AS (SELECT a.k, e.d, sum(e.c) AS s, count(*) AS n FROM a{i} a JOIN e USING (id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
      SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS x FROM s{i} GROUP BY k) n USING (k))""")
    last = c.ROUNDS
    return ",".join(parts) + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.dist AS BIGINT) AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM v JOIN a{last} a USING (id) JOIN c{last} m ON m.k = a.k"""
