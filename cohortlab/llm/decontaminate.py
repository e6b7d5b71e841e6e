"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive K-gram hashes the smallest are kept as fingerprints, in
documents and benchmark items alike, so a span of ``WINDOW`` words that two texts share always shares
a fingerprint. Items of fewer words get the same treatment with their own length as the span: K-grams
of ``min(K, n)`` words over windows that fit n words. Document fingerprints are first tested against a
bitmap of fixed size (1 MB, whatever the benchmark's size; a set bit keeps the row, so it only saves
work), then joined with the benchmark's. Hits are extended to whole windows of words around the
fingerprint, which are joined with the benchmark's windows on 128 bits of hash.

Defined cases: null texts have no words; items without words occur nowhere; items of equal words all
count; an empty benchmark hits nothing; other columns are ignored; rows that share a doc_id, or have none,
keep one row each, with the hits of their own text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import map_arrow, stored, with_text_key
from cohortlab.llm.words import ALNUM, GRAM, Piece, Roll, U, WORD, mix, pieces, same_row

WINDOW, K = 10, 4
#: Bits of the bitmap (a multiple of 32768, the bits of one bitmap bucket).
BITS = 1 << 23
WORD2, GRAM2 = Roll(31), Roll(47)
#: What tells documents apart: rows of one doc_id, or without one, by their texts.
KEY = "key struct<doc_id: long, tk: long>"


def grams_of(span: int) -> tuple[int, int]:
    """(words of a gram, grams of a window) that guarantee a common fingerprint for a common span."""
    k = min(K, span)
    return k, span - k + 1


def winnow(p: Piece, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the grams that are smallest in some window of ``span`` words of one text."""
    k, w = grams_of(span)
    gram = GRAM.windows(h, k)
    whole = np.flatnonzero(same_row(p.row, span))
    if not len(whole):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    least, have = gram, 1
    while have < w:  # doubling sliding minimum
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    kept = np.zeros(len(gram), dtype=bool)
    for j in range(w):
        at = whole + j
        kept[at[gram[at] == least[whole]]] = True
    at = np.flatnonzero(kept)
    return at, mix(gram[at] + U(span))


def window_hashes(h: np.ndarray, h2: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(GRAM.windows(h, span) + U(span)), GRAM2.windows(h2, span)


def item_windows(bench: DataFrame) -> DataFrame:
    """One row per window of each item: item_id, span, w1, w2."""

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(1), ALNUM, fold=True):
            h, h2 = p.hashes(WORD), p.hashes(WORD2)
            for span in np.unique(np.minimum(p.count, WINDOW)).tolist():
                if not span:
                    continue
                ok = same_row(p.row, span)
                if len(ok):
                    ok = ok & (np.minimum(p.count[p.row[: len(ok)]], WINDOW) == span)
                at = np.flatnonzero(ok)
                w1, w2 = window_hashes(h, h2, span)
                yield pa.record_batch([batch.column(0).take(pa.array(p.first + p.row[at])), pa.array(np.full(len(at), span)),
                                       pa.array(w1[at].view(np.int64)), pa.array(w2[at].view(np.int64))], ["item_id", "span", "w1", "w2"])

    kind = dict(bench.dtypes)["item_id"]
    return map_arrow(bench.select("item_id", "text"), run, f"item_id {kind}, span long, w1 long, w2 long")


def item_fingerprints(bench: DataFrame) -> DataFrame:
    """Distinct (span, fp) of all items."""

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(1), ALNUM, fold=True):
            h = p.hashes()
            for span in np.unique(np.minimum(p.count, WINDOW)).tolist():
                if span:
                    at, fp = winnow(p, h, span)
                    mine = np.minimum(p.count[p.row[at]], WINDOW) == span
                    yield pa.record_batch([pa.array(np.full(int(mine.sum()), span)), pa.array(fp[mine].view(np.int64))], ["span", "fp"])

    return map_arrow(bench.select(F.lit(0).alias("no"), "text"), run, "span long, fp long").distinct()


def _bitmap(fps: DataFrame) -> np.ndarray:
    """BITS booleans; at most BITS / 32768 rows of 4 KB come to the driver."""
    slot = F.pmod("fp", F.lit(BITS))
    rows = fps.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(BITS + 32768, dtype=bool)
    for r in rows:  # bucket 1 holds slots 1 to 32768, bucket 0 slots up to 0
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
        first = (r["bucket"] - 1) * 32768 + 1 if r["bucket"] > 0 else 0
        out[first : first + len(bits)] |= bits.astype(bool)
    return np.packbits(out[:BITS], bitorder="little")


def _counted_and_hit(docs: DataFrame, spans: list[int], bitmap: np.ndarray) -> DataFrame:
    """One row per document: key, n_words, and the (span, place, fp) of fingerprints whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batch: pa.RecordBatch):
        bits = shared.value
        for p in pieces(batch.column(1), ALNUM, fold=True):
            h = p.hashes()
            found = []
            for span in spans:
                at, fp = winnow(p, h, span)
                slot = (fp.view(np.int64) % BITS).astype(np.int64)
                hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                found.append((p.row[at[hit]], np.full(int(hit.sum()), span), at[hit] - p.begin[p.row[at[hit]]], fp[hit].view(np.int64)))
            row, span_, place, fp_ = (np.concatenate(x) if found else np.empty(0, dtype=np.int64) for x in (zip(*found) if found else [[]] * 4))
            order = np.argsort(row, kind="stable")
            per = np.bincount(row.astype(np.int64), minlength=p.rows)
            flat = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int64)) for x in (span_, place, fp_)], ["span", "place", "fp"])
            off = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
            yield pa.record_batch([batch.column(0).slice(p.first, p.rows), pa.array(p.count.astype(np.int64)), pa.ListArray.from_arrays(off, flat)],
                                  ["key", "n_words", "hits"])

    return map_arrow(docs, run, f"{KEY}, n_words long, hits array<struct<span:long,place:long,fp:long>>")


def _extended(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Windows of words around the hits of each document: key, span, place, w1, w2."""
    chosen = docs.join(hits, "key")

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(1), ALNUM, fold=True):
            h, h2 = p.hashes(WORD), p.hashes(WORD2)
            spots = batch.column(2).slice(p.first, p.rows)
            row = np.repeat(np.arange(p.rows), np.diff(spots.offsets.to_numpy()))
            flat = spots.flatten()
            span_, place = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for span in np.unique(span_).tolist():
                mine = span_ == span
                k, _ = grams_of(span)
                at = p.begin[row[mine]] + place[mine]
                if not len(h) or span > len(h):
                    continue
                near = np.zeros(len(h), dtype=bool)
                for j in range(span - k + 1):
                    near[np.maximum(at - j, 0)] = True
                start = np.flatnonzero(near[: len(h) - span + 1] & same_row(p.row, span))
                w1, w2 = window_hashes(h, h2, span)
                yield pa.record_batch([batch.column(0).take(pa.array(p.first + p.row[start])), pa.array(np.full(len(start), span)), pa.array(start - p.begin[p.row[start]]),
                                       pa.array(w1[start].view(np.int64)), pa.array(w2[start].view(np.int64))], ["key", "span", "place", "w1", "w2"])

    return map_arrow(chosen, run, f"{KEY}, span long, place long, w1 long, w2 long")


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (sorted as strings)."""
    docs = with_text_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    docs = docs.select(F.struct("doc_id", "tk").alias("key"), "text")
    windows = stored(item_windows(bench), "windows")
    fps = stored(item_fingerprints(bench), "fingerprints")
    spans = [r["span"] for r in fps.select("span").distinct().collect()]  # at most WINDOW values
    drawn = stored(_counted_and_hit(docs, sorted(spans), _bitmap(fps)), "drawn")
    hits = drawn.where(F.size("hits") > 0).select("key", F.explode("hits").alias("h")).select("key", "h.span", "h.place", "h.fp")
    hits = hits.join(fps, ["span", "fp"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("span", "place")).alias("spots"))
    known = stored(windows.select("span", "w1", "w2").distinct(), "known")  # stored: the join can split hot keys
    found = _extended(docs, hits).join(known, ["span", "w1", "w2"])
    found = stored(found, "found")
    words = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("place", "span"))).alias("at"))
    end = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["place"] + x["span"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["place"] + x["span"] - F.greatest(s["end"], x["place"]))).alias("n")))
    words = words.select("key", end["n"].alias("n_hit"))
    items = (found.select("key", "span", "w1", "w2").distinct().join(windows.distinct(), ["span", "w1", "w2"])
             .select("key", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    out = (drawn.select("key", "n_words").join(words.join(items, "key"), "key", "left")
           .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none)}))
    return out.select("key.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
