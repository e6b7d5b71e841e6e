"""Language ID with error-correcting output codes.

Each learned language gets a codeword; for each bit a binary naive Bayes classifier over hashed byte
2- to 4-grams of the folded text (letters only, everything else one blank) says on which side of the
bit's split of the languages a text lies. Decoding adds, per language, the weighted logistic losses of
the bits' margins against the language's codeword; a bit weighs more the less it errs on the labelled
rows that its counts left out. The language of least loss wins; the score is the softmax of the negative
losses, and a text is ambiguous if the two nearest codewords lie closer than ``AMBIGUOUS``.

The classifiers are fitted on a bounded sample of the labelled rows: about ``SAMPLE`` documents of each
language, those of smallest hash of the id; languages with fewer give all. The languages are the distinct
labels; their number bounds the model's size (languages x buckets).

Defined cases: null text or text without a letter is ``und`` with score 0; no labelled row at all: every
text is ``und``; one language: it wins everywhere; rows without label are never learned from; repeated
ids give one row each; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import held_out, map_arrow, stored
from cohortlab.llm.words import cuts, text_buffers

#: Documents of each language that the classifiers and the bit weights are fitted on, about.
SAMPLE = 2000
ORDERS, BUCKETS = (2, 3, 4), 1 << 12
#: Least distance, in mean loss per bit, between the two nearest codewords.
AMBIGUOUS = 0.02
#: Bytes and rows whose counts are held at once.
PIECE, PIECE_ROWS = 1 << 18, 128

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(texts: pa.Array):
    """Yields (first row, rows x features counts) of whole texts."""
    whole, offsets = text_buffers(texts)
    width = BUCKETS * len(ORDERS)
    for i, j in cuts(offsets, PIECE, PIECE_ROWS):
        off = offsets[i : j + 1] - offsets[i]
        data = _FOLD[whole[offsets[i] : offsets[j]]].astype(np.uint32)
        row = np.repeat(np.arange(j - i), np.diff(off))
        counts = np.zeros((j - i) * width, dtype=np.int64)
        for o, k in enumerate(ORDERS):
            n = len(data) - k + 1
            if n <= 0:
                continue
            key = data[:n].copy()
            for d in range(1, k):
                key = (key << np.uint32(8)) | data[d : d + n]
            key = (key * np.uint32(0x9E3779B1)) >> np.uint32(20)
            ok = (row[:n] == row[k - 1 :]) & ((data[:n] != 32) | (data[1 : n + 1] != 32))
            counts += np.bincount((row[:n] * width + o * BUCKETS + key)[ok], minlength=len(counts))
        yield i, counts.reshape(j - i, width)


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: all splits for up to 5 languages, else seeded random splits of large least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n - 1)] + [[-1] * len(splits)], dtype=float)
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, far = np.random.default_rng(3), None, -1
    for _ in range(50):
        code = np.sign(rng.random((n, bits)) - 0.5)
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


def _sampled(labelled: DataFrame) -> DataFrame:
    """About SAMPLE rows of each language, by the hash of the id."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.join(F.broadcast(sizes), "lang").where(u * F.col("n") < SAMPLE).select("doc_id", "lang", "text")


def _class_counts(sample: DataFrame) -> DataFrame:
    """lang, fold (0 learns, 1 weighs), bucket, count: summed in each batch, then by Spark."""

    def run(batch: pa.RecordBatch):
        langs = batch.column(1).to_pylist()
        for first, counts in gram_counts(batch.column(2)):
            names = np.array(langs[first : first + len(counts)], dtype=object)
            for lang in sorted(set(names)):
                total = counts[names == lang].sum(axis=0)
                at = np.flatnonzero(total)
                yield pa.record_batch([pa.array([lang] * len(at), type=pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    out = map_arrow(sample, run, "lang string, bucket long, n long")
    return out.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Model:
    """Codewords, bit weights and one weight per feature and bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        width = BUCKETS * len(ORDERS)
        prob = counts.reshape(len(langs), len(ORDERS), BUCKETS) + 0.5
        prob = (prob / prob.sum(axis=2, keepdims=True)).reshape(len(langs), width)  # each language counts alike
        self.weights = np.zeros((width, self.code.shape[1]), dtype=np.float32)
        for b in range(self.code.shape[1]):
            yes, no = prob[self.code[:, b] > 0], prob[self.code[:, b] < 0]
            if len(yes) and len(no):
                self.weights[:, b] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
        self.trust = np.ones(self.code.shape[1])

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Log odds of each bit: per-gram means, as overlapping grams repeat each other's evidence."""
        n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return (counts.astype(np.float32) @ self.weights) / n * np.minimum(np.sqrt(n), 60.0)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """rows x languages: weighted mean loss of the bits against each codeword."""
        loss = _softplus(-margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(axis=2) / self.trust.sum()

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, ambiguous) of each row."""
        loss = self.losses(self.margins(counts))
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        fit = np.exp((loss.min(axis=1, keepdims=True) - loss) * self.code.shape[1])
        score = 1 / fit.sum(axis=1)
        gap = loss[np.arange(len(loss)), order[:, 1]] - loss[np.arange(len(loss)), best] if loss.shape[1] > 1 else np.ones(len(loss))
        return best, score, gap < AMBIGUOUS


def fit(labelled: DataFrame) -> Model | None:
    """labelled: doc_id, lang, text. None if no row has a label."""
    sample = stored(_sampled(labelled.where("lang IS NOT NULL AND text IS NOT NULL")), "sample")
    weigh = F.crc32(F.concat(F.lit("w"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    table = _class_counts(sample.where(~weigh)).collect()  # languages x features at most
    langs = sorted({r["lang"] for r in table})
    if not langs:
        table = _class_counts(sample).collect()
        langs = sorted({r["lang"] for r in table})
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS * len(ORDERS)))
    place = {x: i for i, x in enumerate(langs)}
    for r in table:
        counts[place[r["lang"]], r["bucket"]] = r["n"]
    model = Model(langs, counts)

    def errors(batch: pa.RecordBatch):
        names = batch.column(1).to_pylist()
        code = {x: model.code[i] for i, x in enumerate(model.langs)}
        for first, counts in gram_counts(batch.column(2)):
            margins = model.margins(counts)
            for i, m in enumerate(margins):
                if (own := code.get(names[first + i])) is not None:
                    yield pa.record_batch([pa.array(np.arange(len(m))), pa.array((m * own <= 0).astype(np.int64))], ["bit", "wrong"])

    rows = (map_arrow(sample.where(weigh), errors, "bit long, wrong long").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.count("*").alias("n")).collect())
    for r in rows:  # half the log odds of the bit's accuracy, as in boosting
        rate = (r["wrong"] + 1) / (r["n"] + 2)
        model.trust[r["bit"]] = max(0.05, 0.5 * np.log((1 - rate) / rate))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs (doc_id, text)."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batch: pa.RecordBatch):
        for first, counts in gram_counts(batch.column(1)):
            n = len(counts)
            letter = batch.column(2).slice(first, n).to_numpy(zero_copy_only=False)
            if model is None:
                lang, score, vague = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
            else:
                best, score, vague = model.decode(counts)
                lang = np.where(letter, np.array(model.langs, dtype=object)[best], "und")
                score, vague = np.where(letter, score, 0.0), vague | ~letter
            yield pa.record_batch([batch.column(0).slice(first, n), pa.array(lang, type=pa.string()), pa.array(score), pa.array(vague)],
                                  ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(chosen, run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold of ``docs`` and predict all its rows."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    return predict(docs, model)
