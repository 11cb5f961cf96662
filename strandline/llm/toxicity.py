"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.learning import fold, sample, whole_texts
from strandline.llm.storage import saved

#: Bytes in an n-gram; n-grams are hashed into 2**BITS features.
SIZES = (4, 5, 6)
BITS = 20
#: Labelled documents that the weights are fitted on; the log-count ratios are of all labelled documents.
FIT_ROWS = 6000
#: A feature is used if it occurs in so many documents and its log-count ratio is so many standard errors from 0.
LEAST_DOCUMENTS, LEAST_ERRORS = 2, 3.0
#: Labels that are broadcast to the texts; more are joined by a shuffle of both.
MOST_BROADCAST = 2_000_000
#: Bytes whose n-grams are made at once; a longer text is walked in windows that overlap by an n-gram.
WINDOW = 4 << 20
#: Pairs that a step of the fit looks at together, which bounds its memory.
BLOCK = 1 << 20
_CODE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[65:91] = _CODE[97:123]  # A-Z as a-z
_CODE[[9, 10, 11, 12, 13]] = _CODE[32]


def features(t: textbatch.Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, by text; of ``wanted`` features only, if given.

    A text has 2**BITS features at most, so what is kept of a long one's windows is bounded, and so is the memory for each window.
    """
    if len(t.data) > WINDOW:
        seen = np.zeros(0, np.int64)
        for lo in range(0, len(t.data), WINDOW):
            hi = min(len(t.data), lo + WINDOW + max(SIZES) - 1)
            text, feature = _features(textbatch.Texts(t.data[lo:hi], np.clip(t.offsets - lo, 0, hi - lo)), wanted)
            own = np.sort(np.concatenate([seen, (text << BITS) | feature]))
            seen = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        return seen >> BITS, seen & ((1 << BITS) - 1)
    return _features(t, wanted)


def _features(t: textbatch.Texts, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    code = _CODE[t.data]
    text_of = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(t.offsets))
    kind = np.uint32 if len(t) < 1 << (32 - BITS) else np.int64  # short keys are sorted faster
    found = []
    for size in SIZES:
        n = len(code) - size + 1
        if n <= 0:
            continue
        h = code[:n].copy()
        for j in range(1, size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[j : j + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
        h >>= np.uint64(64 - BITS)
        inside = text_of[:n] == text_of[size - 1 :]
        if wanted is not None:
            inside &= wanted[h]
        at = np.flatnonzero(inside)
        found.append((text_of[at].astype(kind) << kind(BITS)) | h[at].astype(kind))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.sort(np.concatenate(found))  # np.unique hashes integers, far slower on millions
    first = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
    pairs = pairs[first]
    return (pairs >> kind(BITS)).astype(np.int64), (pairs & kind((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, t: textbatch.Texts, wanted: np.ndarray) -> np.ndarray:
        text, feature = features(t, wanted)
        total = self.bias + np.bincount(text, self.weights[feature], len(t))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, the toxic and the other documents that have it; -1 counts the documents."""
    total = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for lo, t in textbatch.texts(batch.column("text")):
            own = toxic[lo : lo + len(t)]
            text, feature = features(t)
            for k in (0, 1):
                total[k] += np.bincount(feature[own[text] == k], minlength=1 << BITS)
                rows[k] += (own == k).sum()
    some = np.flatnonzero(total.any(0))
    columns = [np.append(some, -1), np.append(total[1][some], rows[1]), np.append(total[0][some], rows[0])]
    yield pa.record_batch([pa.array(c) for c in columns], ["feature", "toxic", "other"])


def _fit(rows: pa.Table, ratio: np.ndarray, epochs: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Logistic regression on presence times ratio, by full-batch Adagrad.

    A pair of a text and a feature takes eight bytes: the ratios multiply weights and gradients, not pairs.
    """
    kept = np.flatnonzero(ratio)
    place = np.zeros(len(ratio), np.int32)
    place[kept] = np.arange(len(kept))
    pairs = []
    for lo, t in textbatch.texts(rows.column("text").combine_chunks()):
        own, f = features(t, ratio != 0)
        own, f = (own + lo).astype(np.int32), place[f]
        pairs += [(own[k : k + BLOCK], f[k : k + BLOCK]) for k in range(0, len(own), BLOCK)]
    toxic = rows.column("toxic").to_numpy().astype(float)
    scale, n = ratio[kept], len(toxic)
    share = min(max(toxic.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(len(kept)), float(np.log(share / (1 - share)))
    seen_w, seen_b = np.full(len(kept), 1e-8), 1e-8
    for _ in range(epochs):
        total, v = np.full(n, b), w * scale
        for text, at in pairs:
            total += np.bincount(text, v[at], n)
        g = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - toxic) / n
        gw = np.zeros(len(kept))
        for text, at in pairs:
            gw += np.bincount(at, g[text], len(kept))
        gw = gw * scale + decay * w
        seen_w += gw * gw
        seen_b += g.sum() ** 2
        w -= rate * gw / np.sqrt(seen_w)
        b -= rate * g.sum() / np.sqrt(seen_b)
    weights = np.zeros(1 << BITS)
    weights[kept] = w * scale
    return Model(weights, b)


def train(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, toxic). Without documents of both kinds every score is the toxic share, or 0."""
    rows = labelled.select("text", F.col("toxic").cast("boolean").alias("toxic"))
    found = rows.mapInArrow(_counts, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = saved(found, "counts")
    # 2**BITS + 1 rows at most
    count = found.where(F.col("feature") < 0).first()
    n = (count.toxic or 0, count.other or 0) if count else (0, 0)
    if not all(n):
        return Model(np.zeros(1 << BITS), 30.0 if n[0] else -30.0)
    table = found.where((F.col("feature") >= 0) & (F.col("toxic") + F.col("other") >= LEAST_DOCUMENTS)).toArrow()
    feature, toxic, other = (table.column(c).to_numpy() for c in ("feature", "toxic", "other"))
    ratios = np.log((toxic + 1) / (n[0] + 2)) - np.log((other + 1) / (n[1] + 2))
    ratio = np.zeros(1 << BITS)
    strong = np.abs(ratios) >= LEAST_ERRORS * np.sqrt(1 / (toxic + 1) + 1 / (other + 1))
    ratio[feature[strong]] = ratios[strong]
    fit = sample(labelled, FIT_ROWS, 3).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).toArrow()
    return _fit(fit, ratio)


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    Learns from labels (doc_id, toxic) of documents whose fold isn't ``held``. The naive Bayes log-count ratios are of all of
    them, counted on the executors; the weights are fitted on ``FIT_ROWS`` of them.
    What is broadcast is one weight for each of 2**BITS features, whatever the data. A score depends on the text alone.

    A null or empty text gets the score of having no feature; labels that are null or without a document are left out;
    a document with several labels counts once for each; a null id is in fold 0; repeated rows give repeated rows;
    an empty table gives an empty one; other columns are not looked at.
    """
    texts = whole_texts(docs, id_col, text_col)
    marks = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    if marks.count() <= MOST_BROADCAST:
        marks = F.broadcast(marks)
    model = train(texts.where(fold(F.col("doc_id"), folds) != held).join(marks, "doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        wanted = own.weights != 0
        for batch in batches:
            scores = [own.score(t, wanted) for _, t in textbatch.texts(batch.column("text"))]
            if scores:
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
