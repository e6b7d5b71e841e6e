"""Text column expressions: front matter, headings, sentences, word counts, tokens, stems.

Regexes are written in the subset Java and RE2 agree on. ``(?d)`` makes '\\n' the
only line terminator in Java, which is what the reference's Python regexes assume.
"""
from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab import constants as C

WS = "[ \\t\\n\\r\\f\\x0B]"


def strip_ws(col: Column) -> Column:
    """Python-style str.strip() for ASCII whitespace."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def word_count(col: Column) -> Column:
    """len(text.split())."""
    s = strip_ws(col)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, f"{WS}+")))


def words(col: Column) -> Column:
    s = strip_ws(col)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def strip_front_matter(col: Column) -> Column:
    """Drop a leading '---' block up to the next '---'; then leading newlines."""
    second = F.locate("---", col, 4)
    rest = F.substring(col, second + 3, F.length(col))
    return (F.when(col.startswith("---") & (second > 0), F.regexp_replace(rest, "^\\n+", ""))
            .otherwise(col))


def front_matter_field(col: Column, field: str) -> Column:
    """A scalar field of the front matter (e.g. source_url)."""
    v = F.regexp_extract(col, f"(?md)^{field}:[ \\t]*\"?([^\"\\n]+)", 1)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(strip_ws(v))


HEADING_RE = "(?md)^##\\s+(.+)$"
SEC_MARK = "\u0001"
HEAD_END = "\u0002"


def sections_array(body: Column) -> Column:
    """X3: '## heading' sections as array<struct<heading, body>>; text before the first heading is dropped."""
    marked = F.regexp_replace(body, HEADING_RE, f"{SEC_MARK}$1{HEAD_END}")
    pieces = F.split(marked, SEC_MARK)
    parts = F.when(F.size(pieces) > 1, F.slice(pieces, 2, F.size(pieces) - 1)).otherwise(
        F.array().cast("array<string>"))
    return F.transform(parts, lambda p: F.struct(
        strip_ws(F.substring_index(p, HEAD_END, 1)).alias("heading"),
        strip_ws(F.substring(p, F.instr(p, HEAD_END) + 1, F.length(p))).alias("body")))


def sentences(body: Column) -> Column:
    """Split after . ! ? followed by whitespace (portable form of the look-behind split)."""
    return F.split(F.regexp_replace(body, f"([.!?]){WS}+", f"$1{SEC_MARK}"), SEC_MARK)


def slug(heading: Column) -> Column:
    return F.replace(F.lower(heading), F.lit(" "), F.lit("_"))


def raw_tokens(text: Column) -> Column:
    """X6 part 1: lower-case, then every run of >= 2 ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({C.TOKEN_PATTERN})"), 1)


def stem(tok: Column) -> Column:
    """First suffix rule whose result keeps >= 3 letters; otherwise unchanged."""
    expr = None
    for suffix, repl in C.SUFFIX_RULES:
        min_len = C.STEM_MIN_LEN + len(suffix) - len(repl)
        cond = tok.endswith(suffix) & (F.length(tok) >= min_len)
        val = F.concat(F.substring(tok, F.lit(1), F.length(tok) - len(suffix)), F.lit(repl))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(tok)


def tokens(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """X6 + X7: tokens with stop words removed on the raw token, then stemmed."""
    sw = list(stop_words or C.STOP_WORDS)
    # a literal IN list becomes a hash-set lookup (InSet) inside codegen
    return F.transform(F.filter(raw_tokens(text), lambda t: ~t.isin(*sw)), stem)
