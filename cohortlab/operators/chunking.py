"""Markdown chunking as a Spark job.

Documents are processed in parallel. A section's units (sentences, or windows of a run-on section)
are packed greedily, so where a chunk ends depends on where the one before it ended. Up to ``BLOCK``
units this is a fold in SQL. A section of more units is cut in blocks that run in parallel: all that a
block needs to know of the units before it is the number of words since the last cut, which is below
``target - overlap``. A table per block maps each such number to the one at the block's end and to the
cuts made in between. Tables combine like functions, group by group, which gives every block its own
number; the block then folds its own units, led by the few before it that a chunk can reach back to.
Both ways make the same cuts.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.text import (
    WS, front_matter_field, sections_array, slug, strip_front_matter, strip_ws, word_count,
)
from cohortlab.session import materialize

#: Units of one block. A block holds more units than a chunk can reach back over.
BLOCK = 4096
#: Tables that one task combines; FAN * FAN * BLOCK units do not fit the longest string.
FAN = 1024

# regex text embedded in SQL string literals: backslashes doubled for the SQL parser
WS_SQL = WS.replace("\\", "\\\\")
#: Words of each unit; units have a word and neither begin nor end with a space.
UNIT_WORDS = f"transform(units, x -> split(x, '{WS_SQL}+'))"


def _words_sql(x: str) -> str:
    s = f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '')"
    return f"(CASE WHEN {s} = '' THEN array() ELSE split({s}, '{WS_SQL}+') END)"


def _let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pack_sql(target: int, overlap: int, resume: str | None = None, last: str = "true") -> str:
    """Greedy packing of ``units``: add units until >= target words, emit, restart from the last ``overlap`` words.

    The fold only finds the cuts (unit number and words so far); pieces are then slices of the
    units, each after the first led by the ``overlap`` words before its cut. ``resume``: words of
    ``units`` up to a cut that was made before (-1: none), whose piece is not emitted again; ``last``:
    whether what follows the last cut is a piece.
    """
    items = "transform(ws, (w, i) -> named_struct('i', i, 'c', size(w)))"
    cut = "named_struct('j', it.i, 't', a.t + it.c)"
    step = (f"IF(a.w + it.c >= {target}, "
            f"named_struct('cuts', array_append(a.cuts, {cut}), 'w', least({overlap}, a.t + it.c), 't', a.t + it.c), "
            "named_struct('cuts', a.cuts, 'w', a.w + it.c, 't', a.t + it.c))")
    if resume:
        step = (f"IF(a.t + it.c <= {resume}, named_struct('cuts', IF(a.t + it.c = {resume}, array_append(a.cuts, {cut}), a.cuts), "
                f"'w', least({overlap}, a.t + it.c), 't', a.t + it.c), {step})")
    fold = (f"aggregate({items}, named_struct('cuts', CAST(array() AS ARRAY<STRUCT<j: INT, t: INT>>), 'w', 0, 't', 0), "
            f"(a, it) -> {step}, a -> a.cuts)")
    carry = lambda t: f"array_join(slice(words, greatest({t} - {overlap} + 1, 1), least({overlap}, {t})), ' ')"
    first = "IF(k = 0, 0, get(cuts, k - 1).j + 1)"
    piece = f"concat(IF(k = 0, '', concat({carry('get(cuts, k - 1).t')}, ' ')), array_join(slice(units, {first} + 1, c.j - {first} + 1), ' '))"
    done = f"transform(cuts, (c, k) -> {piece})"
    if resume:
        done = f"slice({done}, IF({resume} >= 0, 2, 1), size(cuts))"
    end = "element_at(cuts, -1)"
    rest = (f"IF(size(cuts) = 0, array_join(units, ' '), concat({carry(end + '.t')}, "
            f"IF({end}.j + 1 < size(units), concat(' ', array_join(slice(units, {end}.j + 2, size(units)), ' ')), '')))")
    pieces = f"concat({done}, " + _let(rest, "x", f"IF({last} AND regexp_replace(x, '^{WS_SQL}+|{WS_SQL}+$', '') <> '', array(x), "
                                                   "CAST(array() AS ARRAY<STRING>))") + ")"
    return _let(UNIT_WORDS, "ws", _let("flatten(ws)", "words", _let(fold, "cuts", pieces)))


def _units_sql(body: str, target: int, overlap: int) -> str:
    """SQL text of a body's units: its sentences, or, of one sentence with more than 2 * target words, windows of
    ``target`` words at a stride of target - overlap. Every unit has a word."""
    stride = max(target - overlap, 1)
    windows = _let(_words_sql(body), "w", f"transform(sequence(0, CAST(ceil(size(w) / {stride}.0) AS INT) - 1), "
                                          f"i -> array_join(slice(w, i * {stride} + 1, {target}), ' '))")
    return _let(f"split({body}, '(?<=[.!?]){WS_SQL}+')", "s",
                f"IF(size(s) = 1 AND size({_words_sql(body)}) > {2 * target}, {windows}, s)")


def split_long_section(body: str, target: int = C.CHUNK_TARGET_WORDS, overlap: int = C.CHUNK_OVERLAP_WORDS, block: int = BLOCK) -> str:
    """SQL text of the X4 pieces array for a body column named ``body``; null where it has more than ``block`` units."""
    return _let(_units_sql(body, target, overlap), "units", f"IF(size(units) > {block}, NULL, {_pack_sql(target, overlap)})")


def transition(counts: np.ndarray, states: int, opening: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words since the last cut at the end, cuts made) of a block of units, per number of words since the last cut before it.

    A cut follows the first unit by which ``states`` words or more have come since the last cut; ``opening``: the words
    up to a section's first cut, for its first block.
    """
    total = np.cumsum(counts)
    n = len(total)
    following = np.searchsorted(total, total + states)
    final, cuts = np.arange(n), np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            final[i], cuts[i] = final[following[i]], cuts[following[i]] + 1
    before = np.arange(states)
    first = np.searchsorted(total, states - before if opening is None else np.full(states, opening))
    hit, at = first < n, np.minimum(first, n - 1)
    return np.where(hit, total[-1] - total[final[at]], before + total[-1]), np.where(hit, cuts[at] + 1, 0)


def _entries(blocks: DataFrame, target: int, overlap: int) -> DataFrame:
    """(key, block, since, made, n_pieces): words since the last cut and cuts made before each block, pieces of the section."""
    states = max(target - overlap, 1)
    table_type = "since array<bigint>, cuts array<bigint>"

    @F.pandas_udf(table_type)
    def table(counts: pd.Series, block: pd.Series) -> pd.DataFrame:
        found = [transition(c, states, target if b == 0 else None) for c, b in zip(counts, block)]
        return pd.DataFrame({"since": [x for x, _ in found], "cuts": [y for _, y in found]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        since, made = np.arange(states), np.zeros(states, dtype=np.int64)
        for after, cuts in pdf.sort_values("block")[["since", "cuts"]].itertuples(index=False):
            made, since = made + cuts[since], after[since]
        return pd.DataFrame({"key": pdf["key"][:1], "group": pdf["group"][:1], "since": [since], "cuts": [made]})

    def walk(pdf: pd.DataFrame, item: str, since: int, made: int) -> tuple[list, int, int]:
        rows = []
        for i, after, cuts in pdf.sort_values(item)[[item, "since", "cuts"]].itertuples(index=False):
            rows.append((i, since, made))
            since, made = int(after[since]), made + int(cuts[since])
        return rows, since, made

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, since, made = walk(pdf, "group", 0, 0)
        out = pd.DataFrame(rows, columns=["group", "entry", "made"])
        return out.assign(key=pdf["key"].iloc[0], n_pieces=made + int(overlap > 0 or since > 0))

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _, _ = walk(pdf, "block", int(pdf["entry"].iloc[0]), int(pdf["made"].iloc[0]))
        return pd.DataFrame(rows, columns=["block", "since", "made"]).assign(key=pdf["key"].iloc[0], n_pieces=pdf["n_pieces"].iloc[0])

    # equal sections have equal tables, so repeated rows and documents share theirs
    tables = blocks.select("key", "block", "counts").dropDuplicates(["key", "block"]).select("key", "block", table("counts", "block").alias("t"))
    tables = tables.select("key", "block", F.floor(F.col("block") / FAN).alias("group"), "t.since", "t.cuts")
    combined = tables.groupBy("key", "group").applyInPandas(combine, f"key string, group bigint, {table_type}")
    starts = combined.groupBy("key").applyInPandas(groups, "key string, group bigint, entry bigint, made bigint, n_pieces bigint")
    return (tables.join(starts, ["key", "group"]).groupBy("key", "group")
            .applyInPandas(members, "key string, block int, since bigint, made bigint, n_pieces bigint"))


def split_in_blocks(sections: DataFrame, target: int, overlap: int, max_section_words: int, block: int) -> DataFrame:
    """The pieces (with ``piece_idx`` and ``n_pieces``) of the long sections that have more than ``block`` units.

    The blocks are stored, as their word counts are read before their texts.
    """
    reach = target + overlap  # units before a block that its chunks and their carried words can reach back to
    if block < reach:
        raise ValueError(f"a block must hold at least target + overlap = {reach} units")
    keep = [c for c in sections.columns if c != "body"]
    # a unit and the space after it are two characters at least, so the first test spares splitting shorter sections
    units = sections.where(F.length("body") > 2 * block).select(*keep, "body", F.expr(_units_sql("body", target, overlap)).alias("units"))
    units = units.where((F.size("units") > block) & (word_count(F.col("body")) > max_section_words))
    units = units.select(*keep, F.sha2("body", 256).alias("key"), "units")
    # one row per block: its units, led by those that it can reach back to
    cut = (f"transform(sequence(0, CAST(ceil(size(units) / {block}.0) AS INT) - 1), b -> named_struct('block', b, "
           f"'lead', IF(b = 0, 0, {reach}), 'last', (b + 1) * {block} >= size(units), "
           f"'units', slice(units, b * {block} + 1 - IF(b = 0, 0, {reach}), {block} + IF(b = 0, 0, {reach}))))")
    blocks = units.select(*keep, "key", F.explode(F.expr(cut)).alias("s")).select(*keep, "key", "s.*")
    sizes = blocks.withColumn("sizes", F.expr(f"transform({UNIT_WORDS}, w -> size(w))"))
    blocks = materialize(sizes.select(*keep, "key", "block", "last", "units", F.expr(f"slice(sizes, lead + 1, {block})").alias("counts"),
                                      F.expr("aggregate(slice(sizes, 1, lead), 0, (a, c) -> a + c)").alias("led")), "blocks")
    placed = blocks.join(_entries(blocks, target, overlap), ["key", "block"])
    placed = placed.withColumn("resume", F.expr("IF(block = 0, -1, CAST(led - since AS INT))"))
    out = placed.select(*keep, "n_pieces", "made", F.posexplode(F.expr(_pack_sql(target, overlap, "resume", "last"))).alias("at", "text"))
    return out.select(*keep, F.col("n_pieces").cast("int").alias("n_pieces"), (F.col("made") + F.col("at")).cast("int").alias("piece_idx"), "text")


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source_url: str | None = None,
                    fallback_heading: str | None = None, target: int = C.CHUNK_TARGET_WORDS,
                    overlap: int = C.CHUNK_OVERLAP_WORDS, max_section_words: int = C.CHUNK_MAX_SECTION_WORDS,
                    block: int = BLOCK) -> DataFrame:
    """(chunk_id, doc_id, heading, text, source_url, sec_idx, piece_idx, n_pieces).

    ``source_url``: a column name, or None to read it from the front matter (X2).
    ``fallback_heading``: a column used as the single heading of documents that have
    no '## ' heading at all (re-aim for corpora without Markdown headings); None
    keeps the reference behaviour (such documents give no chunks).
    ``block``: units of a section that one fold packs; longer sections are packed in parallel
    blocks, with the same chunks.
    """
    body = strip_front_matter(F.col(text))
    url = F.col(source_url).cast("string") if source_url else front_matter_field(F.col(text), "source_url")
    d = docs.select(F.col(doc_id).cast("string").alias("doc_id"), body.alias("_body"), url.alias("source_url"), F.length(text).alias("_length"),
                    *([F.col(fallback_heading).cast("string").alias("_fb")] if fallback_heading else []))
    secs = sections_array(F.col("_body"))
    if fallback_heading:
        whole = F.array(F.struct(strip_ws(F.col("_fb")).alias("heading"), strip_ws(F.col("_body")).alias("body")))
        secs = F.when(F.size(secs) == 0, whole).otherwise(secs)

    def sections(of: DataFrame) -> DataFrame:
        s = of.select("doc_id", "source_url", F.posexplode(secs).alias("sec_idx", "sec"))
        return s.select("doc_id", "source_url", "sec_idx", F.col("sec.heading").alias("heading"), F.col("sec.body").alias("body"))

    pieces = F.when(word_count(F.col("body")) <= max_section_words, F.array(F.col("body"))).otherwise(
        F.expr(split_long_section("body", target, overlap, block)))
    p = sections(d).select("doc_id", "source_url", "sec_idx", "heading", pieces.alias("_pieces"))
    p = p.select("doc_id", "source_url", "sec_idx", "heading", F.size("_pieces").alias("n_pieces"),
                 F.posexplode("_pieces").alias("piece_idx", "text"))
    p = p.unionByName(split_in_blocks(sections(d.where(F.col("_length") > 2 * block)), target, overlap, max_section_words, block))
    suffix = F.when(F.col("n_pieces") > 1, F.concat(F.lit("_"), F.col("piece_idx").cast("string"))).otherwise(F.lit(""))
    return p.select(
        F.concat(F.col("doc_id"), F.lit("::"), slug(F.col("heading")), suffix).alias("chunk_id"),
        "doc_id", "heading", "text", "source_url", "sec_idx", "piece_idx", "n_pieces")


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """Corpus summary."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))

