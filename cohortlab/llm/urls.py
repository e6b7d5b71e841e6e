"""URL filters by Bloom filter cascades.

A cascade decides exactly which keys of a known universe are listed, without a join and without the keys. Level 1 is
a Bloom filter of the listed keys, level 2 one of the unlisted keys that level 1 passes falsely, level 3 one of
the listed keys that level 2 passes, and so on until nothing passes falsely. A key of the universe is listed if the number of levels
that it passes before the first one it fails is odd. The universe is every key that the corpus asks about, so no key is in doubt.

Two cascades are used. The first holds the rules: a page asks, for every shape of a rule (labels of the host, length
of the path), about the tail of its host with the beginning of its path; the longest listed key is the page's
rule. The second holds listed hosts and judges the pages that no rule fits.

Everything is DataFrame functions. A filter is one array of longs that a scalar subquery hands to the tasks. Filters of one pass hold at
most about ``PASS_BITS`` a level: longer lists are dealt over several cascades by the key's hash, and the pages go through
one after the other, stored in between.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed unless a rule names the empty host;
rules and hosts that are null are ignored; of one key with both verdicts, block wins; equal lengths go to the key that sorts
last; repeated pages are judged each; empty tables give empty results; other columns of the pages are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import discard, stored

#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Bits of one level in one pass, about (4 MB).
PASS_BITS = 1 << 25
#: Bits a key and hashes of the levels after the first, about one false positive in eight.
LATER_BITS, LATER_HASHES = 4.4, 3
#: A host is listed if rules block at least one in so many of its pages, and allow none.
SHARE = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ cascade


@dataclass
class Level:
    """A Bloom filter: a one-row table with the bits, 64 to a long."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(key, F.lit(2 * self.seed)), F.lit(self.bits))
        b = F.pmod(F.xxhash64(key, F.lit(2 * self.seed + 1)), F.lit(self.bits - 1)) + 1
        return [F.pmod(a + b * i, F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words, out = self.words.scalar(), None
        for p in self.positions(key):
            bit = F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = bit if out is None else out & bit
        return out


@dataclass
class Cascade:
    """Levels by pass: keys whose hash falls to pass i are decided by levels[i]."""

    levels: list[list[Level]] = field(default_factory=list)

    def own(self, key: Column, i: int) -> Column:
        """Whether pass i decides the key."""
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.levels))) == i

    def listed(self, key: Column, i: int) -> Column:
        """The verdict of pass i: an odd number of levels passed before the first one failed."""
        out = F.lit(len(self.levels[i]) % 2 == 1)
        for at in range(len(self.levels[i]) - 1, -1, -1):
            out = F.when(self.levels[i][at].passes(key), out).otherwise(F.lit(at % 2 == 1))
        return out

    def flagged(self, df: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """df with a boolean column for each of ``keys``: whether that key of the universe is listed."""
        if len(self.levels) == 1:
            return df.select("*", *[self.listed(key, 0).alias(name) for name, key in keys.items()])
        columns, before = df.columns, None
        for i in range(len(self.levels)):
            seen = {name: F.col(name) if i else F.lit(False) for name in keys}
            df = stored(df.select(*columns, *[F.when(self.own(key, i), self.listed(key, i)).otherwise(seen[name]).alias(name) for name, key in keys.items()]), "pass")
            if before is not None:
                discard(before)
            before = df
        return df


def _first(n_listed: int, n_other: int) -> tuple[float, int]:
    """Bits a key and hashes of the first level: it should pass about as many other keys as there are listed ones."""
    rate = min(0.5, max(n_listed, 1) * math.sqrt(0.5) / max(n_other, 1))
    hashes = max(1, round(-math.log2(rate)))
    return hashes / math.log(2), hashes


def _level(keys: DataFrame, n: int, per_key: float, hashes: int, seed: int) -> Level:
    """The filter of ``keys`` (n rows): bits are set by an aggregate over the words of the filter."""
    spark = keys.sparkSession
    bits = max(64, 64 * math.ceil(n * per_key / 64))
    level = Level(keys, bits, hashes, seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    one = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bits"))
    gaps = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = one.unionByName(gaps).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "bits")))  # bits / 64 entries: bounded by PASS_BITS
    level.words = stored(whole.agg(F.transform(ordered, lambda x: x["bits"]).alias("words")), "filter")
    return level


def build(universe: DataFrame, pass_bits: int = PASS_BITS) -> Cascade:
    """universe: key (string), listed (boolean), each key once."""
    sizes = universe.groupBy("listed").count().collect()
    n = {r["listed"]: r["count"] for r in sizes}
    n_listed, n_other = n.get(True, 0), n.get(False, 0)
    per_key, hashes = _first(n_listed, n_other)
    cascade = Cascade([[] for _ in range(max(1, math.ceil(n_listed * per_key / pass_bits)))])
    for i, levels in enumerate(cascade.levels):
        mine = universe.where(cascade.own(F.col("key"), i))
        encode, against = mine.where("listed").select("key"), mine.where("NOT listed").select("key")
        size = n_listed if len(cascade.levels) == 1 else encode.count()
        old = []
        while size:
            bits = (per_key, hashes) if not levels else (LATER_BITS, LATER_HASHES)
            levels.append(_level(encode, size, *bits, seed=len(levels)))
            wrong = stored(against.where(levels[-1].passes(F.col("key"))), "wrong")
            size = wrong.count()
            encode, against = wrong, encode
            old.append(wrong)
        if old:
            discard(*old)
    return cascade


def universe_of(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """key, listed: every key of ``asked`` once, stored. One aggregate marks the listed ones."""
    both = asked.select("key", F.lit(False).alias("listed"), F.lit(True).alias("asked")).unionByName(
        listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("asked")))
    return stored(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("asked").alias("asked")).where("asked").drop("asked"), "universe")


# ------------------------------------------------------------------ urls


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    df = pages.select("page_id", rest.alias("rest")).select("page_id", "rest", F.regexp_extract("rest", "^[^/?#]*", 0).alias("raw"))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0)
    return df.select("page_id", F.translate("raw", _UPPER, _LOWER).alias("host"), path.alias("path"))


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of the rules: as many as the list has shapes, whatever its length."""
    found = rules.select(F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars")).distinct()
    return sorted((r["labels"], r["chars"]) for r in found.collect())


def _asked(labels: int, chars: int) -> Column:
    """The key of one shape: the last labels of the host and the first characters of the path; null if the path is shorter."""
    tail = F.substring_index(F.col("host"), ".", -labels)
    return F.when(F.length("path") >= chars, F.concat(tail, F.substring(F.col("path"), 1, chars)))


def ruled(parts: DataFrame, rules: DataFrame, pass_bits: int = PASS_BITS) -> DataFrame:
    """parts (page_id, host, path) with rule and the rule's verdict; both null where no rule fits.

    ``rules``: host, path, verdict (allow or block). Blocking and allowing keys are told apart by a first character.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    shapes = _shapes(rules)
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    marks = {"allow": "+", "block": "-"}
    keys = {f"_k{i}": _asked(*s) for i, s in enumerate(shapes)}
    asked = parts.select(F.explode(F.array_compact(F.array(*keys.values()))).alias("k")).distinct()
    asked = asked.select(F.explode(F.array(*[F.concat(F.lit(m), F.col("k")) for m in marks.values()])).alias("key"))
    listed = rules.select(F.concat(F.when(F.col("verdict") == "allow", marks["allow"]).otherwise(marks["block"]), "host", "path").alias("key"))
    universe = universe_of(asked, listed)
    cascade = build(universe, pass_bits)
    # a key that the page does not have is never asked: the flag is null there
    flags = {f"{name}_{v}": F.concat(F.lit(m), F.col(name)) for name in keys for v, m in marks.items()}
    df = cascade.flagged(parts.select("*", *[k.alias(name) for name, k in keys.items()]), flags)
    hits = [F.when(F.col(name).isNotNull() & F.col(f"{name}_{v}"), F.struct(F.length(name).alias("n"), F.col(name).alias("rule"), F.lit(v).alias("verdict")))
            for name in keys for v in marks]
    best = df.select(*parts.columns, F.array_max(F.array_compact(F.array(*hits))).alias("best"))
    out = stored(best.select(*parts.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "ruled")
    discard(universe, *[level.words for levels in cascade.levels for level in levels])
    return out


def blocked_hosts(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """host of every host of ``pages`` (host, verdict) that rules block often and never allow: a list drawn from the corpus itself."""
    n = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("n_block"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("n_allow"))
    return n.where((F.col("n_block") * share >= F.col("n")) & (F.col("n_block") > 0) & (F.col("n_allow") == 0)).select("host")


def judged(pages: DataFrame, rules: DataFrame, hosts: DataFrame | None = None, pass_bits: int = PASS_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page (page_id, url).

    ``rules``: host, path, verdict. ``hosts``: host, the hosts to block where no rule fits; by default ``blocked_hosts`` of the pages.
    ``listed`` tells whether the page's host is among them.
    """
    df = ruled(with_parts(pages), rules, pass_bits)
    if hosts is None:
        hosts = blocked_hosts(df)
    universe = universe_of(df.select(F.col("host").alias("key")).distinct(), hosts.where("host IS NOT NULL").select(F.col("host").alias("key")))
    df = build(universe, pass_bits).flagged(df, {"listed": F.col("host")})
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict"), "listed")
