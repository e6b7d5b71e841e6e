"""Substring dedup by recompression.

Every text is a sequence of word names. A round first merges runs of equal symbols, then pairs
``ab`` whose first symbol falls in the left and second in the right half of the round's random split
of the alphabet. A new symbol's name is a 64-bit hash of what it was made from and of the round, so
all tasks give equal runs and pairs the same name without exchanging dictionaries. Whether two
symbols merge depends on those two alone, so an occurrence of a symbol is settled by its *context*:
its words plus the neighbouring symbols' contexts. Wherever the same words cover that context, the same
symbol appears.

The starts of the symbols of round ``BLOCK_ROUNDS`` cut a text into blocks (about 24 words). A block, with the words
that its last windows need, that a smaller document also has settles all its windows at once; the rest goes on.
A window's first occurrence in the corpus never lies in such a block, so nothing is lost.

Each remaining window of ``WINDOW`` words picks one symbol whose context lies inside it: of the highest round that
has one, the symbol with the smallest hash; a window without one (inside a run) stands for itself. Equal
windows pick the same symbol at the same place. Spark then counts in how many documents each picked symbol
(named with its whole context) occurs; windows with an unshared symbol can't repeat. The windows of
shared symbols are verified by 128 bits of hash: their smallest document is found by one aggregate.

Defined cases: null or word-free texts have no words and keep nothing; texts shorter than a window lose
nothing; a window repeated in one document only stays; rows that share a doc_id are one document for the
comparison and keep one row each, with their own text; rows without a doc_id lose nothing; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import discard, map_arrow, release, stored, with_text_key
from cohortlab.llm.words import GRAM, Piece, Roll, SPACED, U, WORD, covered, mix, pieces, same_row

WINDOW, ROUNDS, BLOCK_ROUNDS = 13, 2, 11
WORD2, GRAM2 = Roll(31), Roll(47)


def symbols(names: np.ndarray, row: np.ndarray, rounds: int):
    """Symbols of every round: yields (names, starts, context starts, context ends), in words, as arrays.

    Contexts reach one place beyond the text's end (or before it) for symbols whose neighbour is missing.
    """
    n = len(names)
    name, start = names.copy(), np.arange(n)
    end, text = start + 1, row
    change = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else start
    size = np.diff(np.r_[change, n])
    before_text, after_text = np.repeat(change, size) - 1, np.repeat(change + size, size) + 1
    lo, hi = start.copy(), end.copy()
    for r in range(rounds):
        if not len(name):
            return
        salt = U((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        left = mix(name ^ salt) & U(1) == 0
        joined = np.zeros(len(name), dtype=bool)  # with the symbol before
        joined[1:] = (text[1:] == text[:-1]) & ((name[1:] == name[:-1]) | (left[:-1] & ~left[1:]))
        head = np.flatnonzero(~joined)
        tail = np.r_[head[1:], len(name)] - 1
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
        new_lo = np.where((head > 0) & (text[before] == text[head]), lo[before], before_text[start[head]])
        new_hi = np.where((tail < len(name) - 1) & (text[after] == text[tail]), hi[after], after_text[start[head]])
        fresh = GRAM.slices(name, head, tail + 1)
        name = np.where(head == tail, name[head], mix(fresh ^ salt))
        end, start, text = end[tail], start[head], text[head]
        lo, hi = new_lo, new_hi
        yield name, start, lo, hi


def range_least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest value in each non-empty [lo, hi), the first of equals."""
    out = np.zeros(len(lo), dtype=np.int64)
    width = hi - lo
    level, best = 1, np.arange(len(x))
    while True:
        mine = (width >= level) & (width < 2 * level)
        if mine.any():
            a, b = best[lo[mine]], best[hi[mine] - level]
            out[mine] = np.where(x[b] < x[a], b, a)
        if not (width >= 2 * level).any():
            return out
        a, b = best[: len(best) - level], best[level:]
        best = np.where(x[b] < x[a], b, a)
        level *= 2


@dataclass
class Blocks:
    """Blocks that start windows: first word, end of their window starts, end of their words."""

    start: np.ndarray
    stop: np.ndarray
    end: np.ndarray


def blocks_of(p: Piece, h: np.ndarray) -> Blocks:
    none = np.empty(0, dtype=np.int64)
    start = none
    for _, start, _, _ in symbols(h, p.row, BLOCK_ROUNDS):
        pass
    if not len(start):
        return Blocks(none, none, none)
    text_end = p.begin[p.row[start] + 1]
    stop = np.minimum(np.r_[start[1:], len(h)], text_end - WINDOW + 1)
    ok = stop > start
    return Blocks(start[ok], stop[ok], stop[ok] + WINDOW - 1)


def spans_mask(p: Piece, spans: pa.Array, beyond: int = 0) -> np.ndarray:
    """Which words lie in the listed (place, stop) ranges of their texts, made ``beyond`` words longer."""
    row = np.repeat(np.arange(p.rows), np.diff(spans.offsets.to_numpy()))
    flat = spans.flatten()
    step = np.zeros(len(p.starts) + 1, dtype=np.int64)
    np.add.at(step, p.begin[row] + flat.field(0).to_numpy(), 1)
    np.add.at(step, p.begin[row] + flat.field(1).to_numpy() + beyond, -1)
    return np.cumsum(step[:-1]) > 0


def picked(p: Piece, h: np.ndarray, k: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words, and the name of the symbol (with its context) that each picks."""
    start = np.flatnonzero(same_row(p.row, k))
    if not len(start):
        return start, np.empty(0, dtype=U)
    out = mix(GRAM.windows(h, k) ^ U(k))[start]
    open_ = np.ones(len(start), dtype=bool)
    for name, _, lo, hi in reversed(list(symbols(h, p.row, rounds))):
        first = np.searchsorted(lo, start[open_], side="left")
        last = np.searchsorted(hi, start[open_] + k, side="right")
        has = last > first
        which = np.flatnonzero(open_)[has]
        if len(which):
            best = range_least(mix(name), first[has], last[has])
            out[which] = GRAM.slices(h, lo[best], hi[best]) ^ (name[best] * U(3))
            open_[which] = False
    return start, out


def window_names(p: Piece, h: np.ndarray, start: np.ndarray, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    h2 = p.hashes(WORD2)
    return GRAM.windows(h, k)[start], GRAM2.windows(h2, k)[start]


def first_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, tk, settled: (place, stop) of the window starts of blocks that a smaller document also has.

    Documents without any are left out.
    """

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(2)):
            h = p.hashes()
            b, h2 = blocks_of(p, h), p.hashes(WORD2)
            b1, b2 = GRAM.slices(h, b.start, b.end), GRAM2.slices(h2, b.start, b.end)
            own = pa.array(p.first + p.row[b.start])
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array((b.start - p.begin[p.row[b.start]]).astype(np.int32)),
                                   pa.array((b.stop - p.begin[p.row[b.start]]).astype(np.int32)), pa.array(b1.view(np.int64)), pa.array(b2.view(np.int64))], ["doc_id", "tk", "place", "stop", "b1", "b2"])

    blocks = stored(map_arrow(docs, run, "doc_id long, tk long, place int, stop int, b1 long, b2 long"), "blocks")
    least = _least(blocks, "b1", "b2")
    again = blocks.join(least, ["b1", "b2"]).where("least < doc_id")
    out = stored(again.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("place", "stop")).alias("settled")), "settled")
    discard(blocks, least)
    return out


def _least(rows: DataFrame, *key: str) -> DataFrame:
    """The smallest document of each key that two have; stored, so that a join with it can split hot keys."""
    return stored(rows.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "least")


def _with(docs: DataFrame, *sides: DataFrame) -> DataFrame:
    """docs with the sides' list columns, empty where a side lacks the document."""
    lists_ = sides[0]
    for side in sides[1:]:
        lists_ = lists_.join(side, ["doc_id", "tk"], "full")
    names = [(c, t) for c, t in lists_.dtypes if c not in ("doc_id", "tk")]
    return docs.join(lists_, ["doc_id", "tk"], "left").select("doc_id", "tk", "text", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in names])


def picked_symbols(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Distinct (doc_id, tk, symbol) that some open window of the document picks."""

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(2)):
            h = p.hashes()
            start, name = picked(p, h)
            some = ~spans_mask(p, batch.column(3).slice(p.first, p.rows))[start]
            row, name = p.row[start[some]], name[some]
            for _ in range(2):  # neighbours first, then all
                fresh = np.ones(len(name), dtype=bool)
                fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
                row, name = row[fresh], name[fresh]
                order = np.lexsort((name, row))
                row, name = row[order], name[order]
            own = pa.array(p.first + row)
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(name.view(np.int64))], ["doc_id", "tk", "symbol"])

    return map_arrow(_with(docs, first), run, "doc_id long, tk long, symbol long")


def _candidate_windows(docs: DataFrame, first: DataFrame, shared: DataFrame) -> DataFrame:
    """Open windows whose picked symbol is shared: doc_id, tk, place, w1, w2."""

    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(2)):
            h = p.hashes()
            start, name = picked(p, h)
            some = ~spans_mask(p, batch.column(3).slice(p.first, p.rows))[start]
            start, name = start[some], name[some]
            mine = batch.column(4).slice(p.first, p.rows)
            row = np.repeat(np.arange(p.rows), np.diff(mine.offsets.to_numpy())).astype(U)
            # (row, symbol) pairs as one sorted key
            known = np.sort(mix(mine.flatten().to_numpy().view(U) ^ mix(row + U(1))))
            key = mix(name ^ mix(p.row[start].astype(U) + U(1)))
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            start = start[known[at] == key] if len(known) else start[:0]
            w1, w2 = window_names(p, h, start)
            own = pa.array(p.first + p.row[start])
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array((start - p.begin[p.row[start]]).astype(np.int32)),
                                   pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["doc_id", "tk", "place", "w1", "w2"])

    told = shared.join(first, ["doc_id", "tk"], "left").select("doc_id", "tk", F.coalesce("settled", F.array().cast(first.schema["settled"].dataType)).alias("settled"), "symbols")
    return map_arrow(docs.join(told, ["doc_id", "tk"]).select("doc_id", "tk", "text", "settled", "symbols"), run, "doc_id long, tk long, place int, w1 long, w2 long")


def _kept(docs: DataFrame, first: DataFrame, repeats: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        for p in pieces(batch.column(2)):
            places, done = batch.column(4).slice(p.first, p.rows), batch.column(3).slice(p.first, p.rows)
            row = np.repeat(np.arange(p.rows), np.diff(places.offsets.to_numpy()))
            gone = covered(p.begin[row] + places.flatten().to_numpy(), WINDOW, len(p.starts))
            gone |= spans_mask(p, done, WINDOW - 1)
            removed = np.bincount(p.row[gone], minlength=p.rows) if len(p.row) else np.zeros(p.rows, dtype=np.int64)
            raw, texts = p.data.tobytes(), []
            for r in range(p.rows):
                a, b_ = int(p.begin[r]), int(p.begin[r + 1])
                if removed[r]:
                    stay = a + np.flatnonzero(~gone[a:b_])
                    texts.append(b" ".join([raw[s:e] for s, e in zip(p.starts[stay].tolist(), p.ends[stay].tolist())]))
                else:
                    texts.append(b" ".join(raw[p.offsets[r] : p.offsets[r + 1]].split()))
            yield pa.record_batch(
                [batch.column(0).slice(p.first, p.rows), pa.array(p.count.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.array(texts, type=pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return map_arrow(_with(docs, first, repeats), run, "doc_id long, n_words long, n_removed long, kept_text string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    docs = with_text_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "tk", "text")
    first = first_blocks(docs)
    release(spark)
    drawn = stored(picked_symbols(docs, first), "symbols")
    release(spark)
    twice = stored(drawn.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1").select("symbol"), "twice")
    shared = stored(drawn.join(twice, "symbol").groupBy("doc_id", "tk").agg(F.collect_set("symbol").alias("symbols")), "shared")
    discard(drawn, twice)
    release(spark)
    windows = stored(_candidate_windows(docs, first, shared), "windows")
    discard(shared)
    release(spark)
    least = _least(windows, "w1", "w2")
    repeats = stored(windows.join(least, ["w1", "w2"]).where("least < doc_id").groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("place")).alias("places")), "repeats")
    discard(windows, least)
    release(spark)
    return _kept(docs, first, repeats)
