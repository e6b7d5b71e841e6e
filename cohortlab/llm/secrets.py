"""Secret scan by grammar inference.

Base patterns find credentials that are labelled by their surroundings (an assignment to a telling name)
or by a fixed shape. Their values, as strings of character classes, form one prefix tree per kind; states
whose symbol and end frequencies are statistically compatible (Hoeffding bound, checked down the tree) are
merged into a probabilistic automaton. Candidates are what the base spans leave of the runs of credential
characters, words included, from the base patterns' least length on; they are merged into a background
automaton the same way. As that is fitted on a sample, the background is an even mixture of it and a chain of
second order over character classes, counted on all candidates. Every candidate is then scored by the log
likelihood ratio of the best kind's automaton against the background; those above ``EVIDENCE`` become spans of kind ``format``.

The automata are fitted on at most ``SAMPLE`` distinct values of each kind, those of smallest hash, of at
most ``LONGEST`` characters; scoring covers every candidate of every whole text.

Defined cases: null text is empty and has no spans; without labelled values no automaton is learned and
only base spans remain; equal values in many documents count once for learning; matches never cross
documents; offsets are code points with exclusive ends; repeated doc_ids give one row each; other columns
are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortlab.llm.common import map_arrow, stored
from cohortlab.llm.words import bounds, cuts, text_buffers

#: The base patterns of the contract, as bytes, with their least lengths; kinds in listing order.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

SAMPLE, LONGEST = 2000, 128
#: Least length of a candidate: that of the base values.
CANDIDATE = min(LEAST.values())
#: Parts of the hash range that are sampled apart.
SLOTS = 16
EVIDENCE = 8.0
#: Confidence of the compatibility test.
ALPHA = 0.05

_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True
_CREDENTIAL = np.zeros(256, dtype=bool)
_CREDENTIAL[48:58] = _CREDENTIAL[65:91] = _CREDENTIAL[97:123] = True
_CREDENTIAL[[43, 45, 46, 47, 61, 95]] = True
#: digit, a-f, g-z, A-F, G-Z, then each sign by itself; 11 stands for any other byte
_CLASS = np.full(256, 11, dtype=np.int64)
_CLASS[48:58] = 0
_CLASS[97:103], _CLASS[103:123] = 1, 2
_CLASS[65:71], _CLASS[71:91] = 3, 4
for _i, _c in enumerate(b"+-./=_"):
    _CLASS[_c] = 5 + _i
SYMBOLS = 12


def base_matches(text: bytes, low: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, start, end, value) of the assign and access patterns, in bytes."""
    out = []
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out


def scanned(texts: pa.Array):
    """Pieces: rows i to j, their bytes and offsets, the base spans of each row, starts and ends of the candidates and of what is scored of them."""
    whole, offsets = text_buffers(texts)
    for i, j in cuts(offsets):
        data, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        raw = data.tobytes()
        found: list[list[tuple[str, int, int, bytes]]] = [[] for _ in range(j - i)]
        low = raw.lower()
        hinted = any(h in low for h in HINTS) or b"AKIA" in raw
        if hinted:
            for r in range(j - i):
                found[r] += base_matches(raw[off[r] : off[r + 1]], low[off[r] : off[r + 1]])
        starts, ends = bounds(_HEX[data], off)
        long = ends - starts >= LEAST["hex"]
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            r = int(np.searchsorted(off, s, side="right")) - 1
            found[r].append(("hex", s - int(off[r]), e - int(off[r]), raw[s:e]))
        free = _CREDENTIAL[data]
        for r, spans in enumerate(found):
            for _, a, b, _ in spans:
                free[off[r] + a : off[r] + b] = False
        starts, ends = bounds(free, off)
        some = ends - starts >= CANDIDATE
        starts, ends = starts[some], ends[some]
        first, last = starts.copy(), ends.copy()
        credential, border = _CREDENTIAL[data], np.zeros(len(data) + 1, dtype=bool)
        border[off] = True
        # signs next to a base span join it to the rest and are not scored
        for k in np.flatnonzero(~border[starts] & credential[starts - 1]):
            while first[k] < last[k] and _CLASS[data[first[k]]] >= 5:
                first[k] += 1
        for k in np.flatnonzero(~border[ends] & credential[np.minimum(ends, len(data) - 1)]):
            while first[k] < last[k] and _CLASS[data[last[k] - 1]] >= 5:
                last[k] -= 1
        some = last - first >= CANDIDATE
        yield i, j, data, off, found, starts[some], ends[some], first[some], last[some]


def hashed(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "big", signed=True)


def least(values: set[bytes]) -> list[tuple[int, bytes]]:
    """The ``SAMPLE`` values of smallest hash."""
    return heapq.nsmallest(SAMPLE, ((hashed(v), v) for v in values))


def triples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of three classes in a row of the candidates, with two marks (class 11) before each, and where each one's begin."""
    size = ends - starts
    begin = np.cumsum(size + 2) - size - 2
    flat = np.full(int(size.sum()) + 2 * len(size) + 1, SYMBOLS - 1, dtype=np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin + 2, size) + inner] = _CLASS[data[np.repeat(starts, size) + inner]]
    return (flat[:-2] * SYMBOLS + flat[1:-1]) * SYMBOLS + flat[2:], begin


def samples(docs: DataFrame) -> DataFrame:
    """kind, h, value, n: of each kind, and of the candidates, the distinct values of smallest hash of every batch; counts n of triples h."""

    def run(batch: pa.RecordBatch):
        seen: dict[str, set[bytes]] = {}
        chain = np.zeros(SYMBOLS**3, dtype=np.int64)
        for _, _, data, _, found, _, _, starts, ends in scanned(batch.column(0)):
            raw = data.tobytes()
            for spans in found:
                for k, _, _, v in spans:
                    if len(v) <= LONGEST:
                        seen.setdefault(k, set()).add(v)
            if len(starts):
                chain += np.bincount(triples(data, starts, ends)[0], minlength=SYMBOLS**3)
            short = ends - starts <= LONGEST
            seen.setdefault("candidate", set()).update([raw[s:e] for s, e in zip(starts[short].tolist(), ends[short].tolist())])
            for k, values in seen.items():
                if len(values) > 32 * SAMPLE:
                    seen[k] = {v for _, v in least(values)}
        rows = [(k, h, v, 0) for k, values in seen.items() for h, v in least(values)]
        rows += [("triple", int(i), b"", int(chain[i])) for i in np.flatnonzero(chain)]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
        yield pa.record_batch([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], ["kind", "h", "value", "n"])

    return map_arrow(docs.select("text"), run, "kind string, h long, value binary, n long")


class State:
    __slots__ = ("n", "end", "to")

    def __init__(self):
        self.n, self.end, self.to = 0, 0, {}  # to: symbol -> [count, State]


def prefix_tree(values: list[bytes]) -> State:
    root = State()
    for v in values:
        at = root
        at.n += 1
        for c in _CLASS[np.frombuffer(v, dtype=np.uint8)].tolist():
            edge = at.to.setdefault(c, [0, None])
            if edge[1] is None:
                edge[1] = State()
            edge[0] += 1
            at = edge[1]
            at.n += 1
        at.end += 1
    return root


def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


def compatible(a: State, b: State) -> bool:
    """May the states be one? b heads a tree."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if y.n < 2 or x.n < 2:
            continue
        if _differ(x.end, x.n, y.end, y.n):
            return False
        for s in set(x.to) | set(y.to):
            p, q = x.to.get(s), y.to.get(s)
            if _differ(p[0] if p else 0, x.n, q[0] if q else 0, y.n):
                return False
            if p and q:
                todo.append((p[1], q[1]))
    return True


def fold(a: State, b: State) -> None:
    """Add the tree below b to a."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.n += y.n
        x.end += y.end
        for s, (count, child) in y.to.items():
            if s in x.to:
                x.to[s][0] += count
                todo.append((x.to[s][1], child))
            else:
                x.to[s] = [count, child]


def merged(root: State) -> list[State]:
    """States of the automaton: kept ones grow from the root; others merge into the first compatible one."""
    kept, seen = [root], {id(root)}
    while True:
        edges = [(e, x) for x in kept for e in x.to.values() if id(e[1]) not in seen]
        if not edges:
            return kept
        edge = max(edges, key=lambda e: e[0][1].n)[0]
        for state in kept:
            if compatible(state, edge[1]):
                tree, edge[1] = edge[1], state
                fold(state, tree)
                break
        else:
            kept.append(edge[1])
            seen.add(id(edge[1]))


class Automaton:
    """Transition table with log probabilities; the last state is a sink for what was never seen."""

    def __init__(self, values: list[bytes]):
        states = merged(prefix_tree(values))
        index = {id(s): i for i, s in enumerate(states)}
        sink = len(states)
        self.next = np.full((sink + 1, SYMBOLS), sink, dtype=np.int64)
        self.log = np.full((sink + 1, SYMBOLS + 1), math.log(1 / (SYMBOLS + 1)))
        for i, s in enumerate(states):
            total = s.n + 0.5 * (SYMBOLS + 1)
            self.log[i] = math.log(0.5 / total)
            self.log[i, SYMBOLS] = math.log((s.end + 0.5) / total)
            for c, (count, child) in s.to.items():
                self.next[i, c] = index[id(child)]
                self.log[i, c] = math.log((count + 0.5) / total)

    def score(self, classes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log likelihood of each string (strings sorted by falling size)."""
        state, total = np.zeros(len(size), dtype=np.int64), np.zeros(len(size))
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, side="left"))  # strings with more than k symbols
            c = classes[begin[:n] + k]
            total[:n] += self.log[state[:n], c]
            state[:n] = self.next[state[:n], c]
        return total + self.log[state, SYMBOLS]


def ratios(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: list[Automaton], background: Automaton, chain: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of the best kind against the background, of each candidate."""
    order = np.argsort(starts - ends, kind="stable")
    begin, size, classes = starts[order], (ends - starts)[order], _CLASS[data]
    best = np.max([a.score(classes, begin, size) for a in kinds], axis=0)
    codes, at = triples(data, starts, ends)
    sums = np.r_[0.0, np.cumsum(chain[codes])]
    chained = sums[at + (ends - starts) + 1] - sums[at]  # each symbol and the end
    out = np.empty(len(size))
    out[order] = best - np.logaddexp(background.score(classes, begin, size), chained[order]) + math.log(2)
    return out


def learn(docs: DataFrame) -> tuple[list[Automaton], Automaton, np.ndarray] | None:
    drawn = stored(samples(docs), "samples")
    counts = np.zeros(SYMBOLS**3)
    for r in drawn.where("kind = 'triple'").groupBy("h").agg(F.sum("n").alias("n")).collect():  # SYMBOLS ** 3 rows at most
        counts[r["h"]] = r["n"]
    counts = counts.reshape(-1, SYMBOLS) + 0.5
    chain = np.log(counts / counts.sum(axis=1, keepdims=True)).ravel()
    slot = F.pmod("h", F.lit(SLOTS))
    first = Window.partitionBy("kind", "slot").orderBy("h", "value")
    values = drawn.where("kind <> 'triple'").distinct().withColumn("slot", slot)
    rows = values.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).select("kind", "h", "value").collect()  # 4 x SLOTS x SAMPLE x LONGEST bytes at most
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows:
        by.setdefault(r["kind"], []).append((r["h"], bytes(r["value"])))
    chosen = {k: [v for _, v in heapq.nsmallest(SAMPLE, x)] for k, x in by.items()}
    other = chosen.pop("candidate", [])
    return ([Automaton(chosen[k]) for k in sorted(chosen)], Automaton(other), chain) if chosen else None


def scored(docs: DataFrame, model: tuple[list[Automaton], Automaton, np.ndarray] | None) -> DataFrame:
    """doc_id, spans (kind, start, end) in order: base spans and the candidates whose likelihood ratio is high."""
    rank = {k: i for i, k in enumerate(KINDS)}
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch):
        for i, j, data, off, found, starts, ends, first, last in scanned(batch.column(1)):
            spans = [[(k, a, b) for k, a, b, _ in x] for x in found]
            if len(starts) and model is not None:
                good = ratios(data, first, last, *model) >= EVIDENCE
                for s, e in zip(starts[good].tolist(), ends[good].tolist()):
                    r = int(np.searchsorted(off, s, side="right")) - 1
                    spans[r].append(("format", s - int(off[r]), e - int(off[r])))
            out = []
            for r, x in enumerate(spans):
                if x:  # code points before each byte
                    points = np.r_[0, np.cumsum((data[off[r] : off[r + 1]] & 0xC0) != 0x80)]
                    x = [{"kind": k, "start": int(points[a]), "end": int(points[b])} for k, a, b in sorted(x, key=lambda s: (s[1], rank[s[0]]))]
                out.append(x)
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(out, type=pa.list_(kind))], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end) of every row."""
    return scored(docs, learn(docs))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_of(spans: Column, kind: str | None = None) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "format") if kind is None else F.filter(spans, lambda s: s["kind"] == kind)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of each text replaced by ``mark``; overlapping or touching spans become one mark.

    Rows are joined by doc_id; texts that share an id must be equal. A column ``n_chars`` follows the text.
    """
    hit = find_secrets(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_id"), "spans")
    out = docs.join(hit, docs["doc_id"].cast("long") == hit["_id"], "left")
    text, spans = docs["text"], hit["spans"]
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit("").alias("text"))
    walked = F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] <= acc["at"], acc["text"]).otherwise(F.concat(acc["text"], piece(F.greatest(acc["at"], F.lit(0)), s["start"]), F.lit(mark))).alias("text")))
    clean = F.concat(walked["text"], piece(walked["at"], F.length(text).cast("long")))
    new = {"text": F.when(spans.isNull(), text).otherwise(clean)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(spans.isNull(), docs["n_chars"]).otherwise(F.length(clean)).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
