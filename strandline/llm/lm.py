"""Language-model scores: a log-bilinear neural model over a smoothed unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.learning import fold, whole_texts
from strandline.llm.storage import saved

#: Words with vectors of their own: the most frequent, ``GROWTH`` times the root of the counted tokens, but ``VOCABULARY`` at least.
#: All others share vectors, and the text's end has its own.
VOCABULARY, GROWTH = 1022, 4
#: Words whose counts are broadcast, the most frequent (at least those with vectors); the rest are joined.
HEAD = 1 << 17
#: Length of a vector, noise words for each batch, batch size, learning rate.
SIZE, NOISE, BATCH, RATE = 16, 64, 4096, 0.05
#: Numbers of a table that are multiplied at once, few enough for a processor's cache.
FITS = 1 << 16
#: Normalisers after two of the ``NEAR`` most frequent words (or a text's end, another word, a text's beginning) are kept by a worker: those of classes, and of the words of the ``KEPT`` first classes.
NEAR, KEPT = 1024, 8
#: Tokens from which a class's normalisers are kept, or exponentials are made for each different context that so many of them share; a table of these has so many numbers at most.
MANY, COMMON, HELD = 4096, 4, 1 << 22
#: Bytes of text that are scored at once: the more, the more contexts are shared.
AT_ONCE = 4 << 20
#: A frequent context and word is trained on in several rows of so many occurrences at most.
TIMES = 8
#: Tokens that a task holds before it trains on them; where the sums of squared gradients begin.
LEARN, START = 1_000_000, 1e-8
#: Parts of the training texts that are trained on apart: the root of the counted tokens over this, so that all parts' vectors together grow as the tokens do.
APART = 560
ALPHA = 0.1
_END = textbatch.mixed(np.array([2**62 + 12345], np.uint64))[0]


def sequences(t: textbatch.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text's tokens begin."""
    w = textbatch.words(t)
    first = w.first + np.arange(len(w.first))
    out = np.full(len(w.hashes) + len(t), _END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = w.hashes
    return out, first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        tokens, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return tokens, np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)

    def out() -> pa.RecordBatch:
        tokens, n = merged()
        return pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    for batch in batches:
        for _, t in textbatch.texts(batch.column("text")):
            held.append(np.unique(sequences(t)[0], return_counts=True))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_500_000:
                    yield out()
                    held.clear()
    if held:
        yield out()


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their counts, ``most`` at most, down to a count that a histogram gives.

    So all tasks together send no more than that, where a sort with a limit would send as much from each.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 512 rows at most
    cut, total = None, 0
    for r in histogram:
        total += r["count"]
        if total > most:
            break
        cut = r["level"]
    found = counts.where(level >= cut if cut is not None else F.lit(False)).toArrow()
    return found.column("token").to_numpy(), found.column("n").to_numpy()


class Words:
    """Look-up of token hashes in a sorted table."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.order = np.argsort(tokens)
        self.sorted = tokens[self.order]

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place in the table, or -1."""
        if not len(self.sorted):
            return np.full(len(tokens), -1, np.int64)
        distinct, of = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.sorted, distinct), len(self.sorted) - 1)
        return np.where(self.sorted[at] == distinct, self.order[at], -1)[of]


@dataclass
class LogBilinear:
    """Next-word scores: bias plus the product of a word's vector with the sum of two mapped context vectors.

    ``context`` holds, for each of the two places before a word, the mapped vector of each word. There may be more
    contexts than targets, or fewer.
    """

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, unigram: np.ndarray, contexts: int | None = None) -> LogBilinear:
        made = np.random.default_rng(41)
        m = len(unigram)
        context, target = ((made.standard_normal(x, np.float32) * np.float32(0.05)) for x in ((2, contexts or m + 1, SIZE), (m, SIZE)))
        return cls(context, target, np.log(unigram).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(word | nearest context word, and the one before), in two parts: scores of (place, context, word), and normalisers of (1st, 2nd).

        Matrix products over batches of contexts, with the sum over the whole vocabulary.
        """
        scores = self.context @ self.target.T
        m = scores.shape[1]
        norm = np.empty((m, m), np.float32)
        right = np.exp(scores[1])  # exp of a sum is a product, so the sum over words is a matrix product
        for lo in range(0, m, 256):
            norm[lo : lo + 256] = np.log(np.exp(scores[0, lo : lo + 256] + self.bias) @ right.T)
        return (scores / np.log(10)).astype(np.float32), norm / np.float32(np.log(10))

    def train(self, ids: np.ndarray, unigram: np.ndarray, made: np.random.Generator, order: np.ndarray | None = None) -> None:
        """One pass of noise-contrastive estimation over rows (1st context, 2nd context, target, times), in an order that may repeat them.

        Each batch shares ``NOISE`` noise targets drawn from the unigram distribution; a sample is told from
        noise by its score less log(k q), with the normaliser taken as 1. A batch touches the vectors of its own rows only.
        """
        log_kq = np.log(unigram * NOISE).astype(np.float32)
        upto = np.cumsum(unigram)
        order = np.arange(len(ids)) if order is None else order
        weight = np.float32(len(order) / ids[:, 3].take(order).sum() / BATCH) if len(order) else 0
        places = (self.context[0], self.context[1], self.target, self.bias)
        seen = [np.full_like(x, START) for x in places]
        for lo in range(0, len(order), BATCH):
            a, b, word, times = np.ascontiguousarray(ids.take(order[lo : lo + BATCH], 0).T)
            noise = np.minimum(np.searchsorted(upto, made.random(NOISE) * upto[-1], "right"), len(upto) - 1)
            v = self.context[0].take(a, 0)
            v += self.context[1].take(b, 0)
            own, other = self.target.take(word, 0), self.target.take(noise, 0)
            good = np.einsum("ij,ij->i", v, own) + self.bias.take(word) - log_kq.take(word)
            g = times.astype(np.float32) * weight
            g_good = g / (1 + np.exp(np.clip(good, -30, 30)))
            g_bad = v @ -other.T  # in place from here on: the score against noise, its odds, the gradient
            less = self.bias[noise] - log_kq[noise]
            for at in range(0, len(v), FITS // NOISE):
                part = g_bad[at : at + FITS // NOISE]
                part -= less
                np.clip(part, -30, 30, out=part)
                np.exp(part, out=part)
                part += 1
                np.divide(-g[at : at + FITS // NOISE, None], part, out=part)
            own *= g_good[:, None]
            own += g_bad @ other
            to_target = np.concatenate([g_good[:, None] * v, g_bad.T @ v])
            to_bias = np.concatenate([g_good, np.ones(len(v), np.float32) @ g_bad])
            targets = Runs.of(np.append(word, noise))
            for x, s, runs, grad in zip(places, seen, (Runs.of(a), Runs.of(b), targets, targets), (own, own, to_target, to_bias), strict=True):
                grad = runs.sums(grad)
                squares = s.take(runs.at, 0)
                squares += grad * grad
                _put(s, runs.at, squares)
                grad *= np.float32(RATE)
                grad /= np.sqrt(squares, out=squares)
                grad += x.take(runs.at, 0)
                _put(x, runs.at, grad)


class Runs:
    """The different places ``at`` of a batch's rows, sorted, and how rows of one place are added up."""

    def __init__(self, at: np.ndarray, lead: np.ndarray, shared: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> None:
        self.at, self.lead, self.shared, self.rows, self.begin = at, lead, shared, rows, begin

    @classmethod
    def of(cls, at: np.ndarray) -> Runs:
        bits = len(at).bit_length()
        key = np.sort(at.astype(np.int64) << bits | np.arange(len(at)))  # faster than a stable argsort, in the same order
        by, at = key & (1 << bits) - 1, key >> bits
        new = np.ones(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=new[1:-1])
        first = np.flatnonzero(new[:-1])
        many = ~(new[:-1] & new[1:])
        return cls(at[first], by[first], np.flatnonzero(many[first]), by[many], np.flatnonzero(new[:-1][many]))

    def sums(self, grad: np.ndarray) -> np.ndarray:
        """The sum of rows for each place; most places have one row only."""
        out = grad.take(self.lead, 0)
        if len(self.shared):
            out[self.shared] = np.add.reduceat(grad.take(self.rows, 0), self.begin)
        return out


def _put(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Set rows of ``x``, each as one piece of memory."""
    if x.ndim == 1:
        x[at] = rows
    else:
        whole = np.dtype((np.void, x[0].nbytes))
        x.view(whole)[:, 0][at] = rows.view(whole)[:, 0]


@dataclass
class Factored:
    """log10 p(word | contexts) as p(class) p(word | class): a log-bilinear model whose targets are the own words and then the classes.

    Class k has the own words ``begin[k]:begin[k + 1]``; the last two classes are the end and any other word, each alone in its own.
    With about as many classes as words in one, both normalisers are sums over the root of the vocabulary.
    """

    model: LogBilinear
    begin: np.ndarray
    kept: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def classes(own: int) -> np.ndarray:
        size = max(1, int(np.ceil(np.sqrt(own))))
        return np.append(np.arange(0, own, size), [own, own + 1, own + 2])

    def scores(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
        model, own = self.model, int(self.begin[-3])
        classes = len(self.begin) - 1
        cls = np.repeat(np.arange(classes, dtype=np.int16 if classes < 1 << 15 else np.int64), np.diff(self.begin)).take(ids)
        order = np.argsort(cls, kind="stable")  # a radix sort where there are few classes
        cls, one, two, ids = cls.take(order), one.take(order), two.take(order), ids.take(order)
        v = model.context[0].take(one, 0)
        v += model.context[1].take(two, 0)
        found = self._log_softmax(-1, slice(own, None), v, one, two, cls.astype(np.int32) + own)
        ends = np.searchsorted(cls, np.arange(classes - 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            rows = slice(ends[k], ends[k + 1])
            found[rows] += self._log_softmax(k, slice(self.begin[k], self.begin[k + 1]), v[rows], one[rows], two[rows], ids[rows])
        out = np.empty(len(found))
        out[order] = found
        return out / np.log(10)

    def _log_softmax(self, k: int, targets: slice, v: np.ndarray, one: np.ndarray, two: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """log of the share of target ``pick`` among ``targets``, the words of class ``k`` or (-1) the classes, after the contexts, whose vectors' sum is ``v``."""
        model = self.model
        out = np.empty(len(v))
        for lo in range(0, len(v), FITS // SIZE):
            part = slice(lo, lo + FITS // SIZE)
            out[part] = np.einsum("ij,ij->i", v[part], model.target.take(pick[part], 0)) + model.bias.take(pick[part])
        if len(v) < MANY:
            return out - self._log_norm(targets, v)
        if k >= KEPT:
            return out - self._log_norms(targets, v, one, two)
        kept, own = self._near(k, targets), int(self.begin[-3])
        n = len(kept) - 3
        i, j = (np.where(x < n, x, x - (own - n)) for x in (one, two))
        near = ((one < n) | (one >= own)) & ((two < n) | (two >= own))
        norm = kept.ravel().take(np.where(near, i * len(kept) + j, 0))
        rest = np.flatnonzero(~near | np.isnan(norm))
        norm[rest] = self._log_norms(targets, v.take(rest, 0), one.take(rest), two.take(rest))
        return out - norm

    def _near(self, k: int, targets: slice) -> np.ndarray:
        """``_log_norms`` for any two of the most frequent words and the last three contexts, by one matrix product; NaN where that is too small."""
        if k not in self.kept:
            own = int(self.begin[-3])
            at = np.append(np.arange(min(NEAR, own)), own + np.arange(3))
            (e1, top1), (e2, top2) = (self._odds(place, at, targets) for place in (0, 1))
            norm = e1 @ e2.T
            norm[norm < 1e-20] = np.nan
            np.log(norm, out=norm)
            norm += top1[:, None]
            norm += top2
            self.kept[k] = norm
        return self.kept[k]

    def _odds(self, place: int, at: np.ndarray, targets: slice) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the targets' scores after contexts ``at`` of a place, over the greatest of each, and the log of that; biases count in the second place."""
        x = self.model.context[place].take(at, 0) @ self.model.target[targets].T
        if place:
            x += self.model.bias[targets]
        top = x.max(1)
        x -= top[:, None]
        return np.exp(x, out=x), top

    def _log_norms(self, targets: slice, v: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log of the sum over the targets of the exponentials of their scores.

        The exponential of a sum is a product, so where tokens have contexts in common, exponentials are made for each different context
        of a place, not for each token; the normaliser is the product sum of two rows.
        """
        if len(v) < MANY:
            return self._log_norm(targets, v)
        contexts, width = self.model.context.shape[1], len(self.model.bias[targets])
        places = []
        for x in (one, two):
            times = np.bincount(x, minlength=contexts)
            common = np.flatnonzero(times >= COMMON)
            if len(common) > (most := HELD // width):
                common = common[np.argsort(-times[common], kind="stable")[:most]]
            number = np.full(contexts, -1, np.int32)
            number[common] = np.arange(len(common))
            places.append((common, number.take(x)))
        (at1, i), (at2, j) = places
        both = (i >= 0) & (j >= 0)
        pairs, rest = np.flatnonzero(both), np.flatnonzero(~both)
        if COMMON * (len(at1) + len(at2)) > 2 * len(pairs):
            return self._log_norm(targets, v)
        (e1, top1), (e2, top2) = self._odds(0, at1, targets), self._odds(1, at2, targets)
        i, j = i.take(pairs), j.take(pairs)
        norm = np.empty(len(pairs), np.float32)
        step = max(16, FITS // e1.shape[1])
        for lo in range(0, len(pairs), step):
            part = slice(lo, lo + step)
            norm[part] = np.einsum("ij,ij->i", e1.take(i[part], 0), e2.take(j[part], 0))
        out = np.empty(len(v), np.float32)
        out[pairs] = np.log(np.maximum(norm, 1e-37)) + top1.take(i) + top2.take(j)
        rest = np.append(rest, pairs[norm < 1e-20])  # the two places' scores are so far apart that products vanish
        out[rest] = self._log_norm(targets, v.take(rest, 0))
        return out

    def _log_norm(self, targets: slice, v: np.ndarray) -> np.ndarray:
        """The same, by exponentials for each row of ``v``."""
        target, bias = self.model.target[targets], self.model.bias[targets]
        out = np.empty(len(v), np.float32)
        step = max(16, FITS // len(target))
        odds = np.exp(bias)
        # no score, bias or odds can pass what a float holds, so none is taken from another
        near = len(v) and np.abs(bias).max() < 30 and np.einsum("ij,ij->i", v, v).max() * np.einsum("ij,ij->i", target, target).max() < 40**2
        for lo in range(0, len(v), step):
            x = v[lo : lo + step] @ target.T
            if near:
                out[lo : lo + step] = np.log(np.exp(x, out=x) @ odds)
            else:
                x += bias
                top = x.max(1)
                x -= top[:, None]
                out[lo : lo + step] = np.log(np.exp(x, out=x).sum(1)) + top
        return out


def _contexts(ids: np.ndarray, first: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, and the one before that; ``blank`` before a text's beginning."""
    one, two = np.full((2, len(ids)), blank, ids.dtype)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    begins = first[:-1]
    one[begins] = two[begins] = blank
    second = begins + 1
    two[second[second < first[1:]]] = blank
    return one, two


def _numbered(sent: Broadcast):
    """Each text's words as places in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _, begin = sent.value
        words, other = Words(tokens), begin[-3] + 1
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text")):
                found, first = sequences(t)
                ids = words.find(found)
                ids[ids < 0] = other
                yield pa.record_batch([batch.column("key").slice(lo, len(t)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["key", "ids"])

    return run


def _trained(sent: Broadcast, columns: list[str]):
    """Each task trains on all its texts' tokens from the same start; a vector of the model is its mean over the tasks, by its occurrences there.

    Rows are the places of vectors in the first contexts, then the second, then the targets. Only those that a task has met come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, unigram, begin = sent.value
        own = begin[-3]
        m, rows = own + 2, []
        model = LogBilinear.new(unigram, m + 1)
        met = [np.zeros(n) for n in (m + 1, m + 1, len(unigram))]
        made = np.random.default_rng(1)

        def learn() -> None:
            keys, times = np.unique(np.concatenate(rows), return_counts=True)
            rows.clear()
            word, keys = (keys % m).astype(np.int32), keys // m
            a, b, times = (keys // (m + 1)).astype(np.int32), (keys % (m + 1)).astype(np.int32), times.astype(np.int32)
            cls = (own + np.searchsorted(begin, word, "right") - 1).astype(np.int32)
            vector = word < own
            ids = np.stack([np.append(a, a[vector]), np.append(b, b[vector]), np.append(cls, word[vector]), np.append(times, times[vector])], 1)
            del keys, a, b, cls, word, times, vector
            for x, at in zip(met, (0, 1, 2), strict=True):
                x += np.bincount(ids[:, at], ids[:, 3], len(x))
            again = -(-ids[:, 3] // TIMES)
            ids[:, 3] = np.round(ids[:, 3] / again)
            model.train(ids, unigram, made, made.permutation(np.repeat(np.arange(len(ids), dtype=np.int32), again)))

        for batch in batches:
            ends = batch.column("ids").offsets.to_numpy().astype(np.int64)
            every, lo = batch.column("ids").values.to_numpy(), 0
            while lo < batch.num_rows:  # as many texts as LEARN tokens hold, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LEARN, "right")) - 1)
                ids = every[ends[lo] : ends[hi]].astype(np.int64)
                one, two = _contexts(ids, ends[lo : hi + 1] - ends[lo], m)
                rows.append((one * (m + 1) + two) * m + ids)
                if sum(map(len, rows)) >= LEARN:
                    learn()
                lo = hi
        if rows:
            learn()
        vectors = (model.context[0], model.context[1], np.column_stack([model.target, model.bias]))
        start = 0
        for x, n in zip(vectors, met, strict=True):
            for at in np.array_split(np.flatnonzero(n), len(n) // 50_000 + 1):
                values = np.zeros((len(at), SIZE + 1), np.float32)
                values[:, : x.shape[1]] = x[at] * n[at, None]
                yield pa.record_batch([pa.array(start + at), pa.array(n[at]), *(pa.array(c) for c in np.ascontiguousarray(values.T))], ["i", "n", *columns])
            start += len(n)

    return run


def language_model_scores(docs: DataFrame, folds: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Tokens are a text's words (A-Z lower-cased) and one end. Texts whose fold isn't ``held`` are learned from. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))). score is the log10 probability that the model gives the text: a log-bilinear model of the
    most frequent words, the end and "any other word", given the two before, normalised exactly over that vocabulary by classes. The vocabulary
    grows with the root of the counted tokens (``GROWTH``), and with it what scoring gathers;
    another word's probability is multiplied by its share (c + 0.1) of the counts of all other words, unseen words counting as one.

    Counts are of all training tokens. The model is trained by noise-contrastive estimation on all of them: in parts that a hash of the texts
    makes (``APART``), each on its own, then averaged by occurrences, so what reaches the driver is a model's parameters. The most frequent words' counts, ``HEAD`` or the vocabulary at most,
    are broadcast; the other tokens are joined to theirs. (Words are held as 64-bit hashes.)

    A null or empty text is its end alone. Without training texts c, N and V are 0. A null id is in fold 0; repeated rows
    give repeated rows; an empty table gives an empty one; other columns are not looked at.
    """
    sc = docs.sparkSession.sparkContext
    texts = whole_texts(docs, id_col, text_col).withColumn("held", fold(F.col("doc_id"), folds) == held)
    training = texts.where(~F.col("held"))
    counts = saved(training.select("text").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(_END.view(np.int64))
    ends = float((counts.where(F.col("token") == end).agg(F.sum("n")).first()[0]) or 0)
    most = max(VOCABULARY, int(GROWTH * np.sqrt(total)))
    head = _head(counts.where(F.col("token") != end), max(HEAD, most))
    order = np.lexsort((head[0], -head[1]))
    tokens = np.append(head[0][order].view(np.uint64), _END)  # the end is last
    n = np.append(head[1][order], ends).astype(float)
    own = np.arange(min(len(tokens) - 1, most))
    # the vocabulary: own words, the end, and any other word last
    m = len(own) + 2
    other_words = distinct - len(own) - (ends > 0)
    other_mass = total - n[own].sum() - ends + ALPHA * (other_words + 1)
    mass = np.append(n[own], [ends, other_mass]) + ALPHA
    begin = Factored.classes(len(own))
    unigram = np.append(mass[own], np.add.reduceat(mass, begin[:-1]))
    unigram /= unigram.sum()
    base_norm = np.log10(max(total + ALPHA * (distinct + 1), 1e-9))
    # places of the head's words in the vocabulary; -1 for those that share the last
    place = np.full(len(tokens), -1)
    place[own] = np.arange(len(own))
    place[-1] = m - 2
    start = sc.broadcast((np.append(tokens[own], _END), unigram, begin))  # places as in `place`
    columns = [f"x{k}" for k in range(SIZE + 1)]
    # the same parts, in the same order, however the input is split
    numbered = training.withColumn("key", F.xxhash64("doc_id", "text")).select("key", "text").mapInArrow(_numbered(start), "key long, ids array<int>")
    parts = numbered.repartition(max(1, round(np.sqrt(total) / APART)), "key").sortWithinPartitions("key")
    learned = parts.mapInArrow(_trained(start, columns), ", ".join(["i long, n double", *(f"{c} float" for c in columns)]))
    means = [(F.sum(c) / F.sum("n")).cast("float").alias(c) for c in columns]
    learned = learned.groupBy("i").agg(*means).toArrow()
    model = LogBilinear.new(unigram, m + 1)
    values, at = np.stack([learned.column(c).to_numpy() for c in columns], 1), learned.column("i").to_numpy()
    for k, x in enumerate((*model.context, model.target)):
        here = (at >= k * (m + 1)) & (at < (k + 1) * (m + 1) if k < 2 else True)
        x[at[here] - k * (m + 1)] = values[here, :SIZE]
    model.bias[at[here] - 2 * (m + 1)] = values[here, SIZE]
    del learned, values
    sent = sc.broadcast((tokens, n, place, Factored(model, begin)))
    log_other = float(np.log10(other_mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n, place, model = sent.value
        words = Words(tokens)
        part, row = TaskContext.get().partitionId() << 33, 0
        log_n = np.log10(np.append(n, 0) + ALPHA)  # place -1: unseen, or in the tail
        of_place = np.append(place, -1).astype(np.int32)
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text"), AT_ONCE):
                found, first = sequences(t)
                at = words.find(found)
                ids = of_place[at]
                other = ids < 0
                ids[other] = m - 1
                one, two = _contexts(ids, first, m)
                p = model.scores(one, two, ids)
                in_head = at >= 0
                base = np.where(in_head, log_n[at] - base_norm, 0.0)
                p = p + np.where(other & in_head, log_n[at] - log_other, 0.0)
                known = in_head & (np.append(n, 0)[at] > 0)
                begins = first[:-1]
                size = np.diff(first)
                tail = ~in_head
                tails = np.add.reduceat(tail, begins, dtype=np.int64)
                offsets = np.zeros(len(t) + 1, np.int32)
                np.cumsum(tails, out=offsets[1:])
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, len(t)), batch.column("held").slice(lo, len(t)), pa.array(part + row + np.arange(len(t))), pa.array(size), pa.array(np.add.reduceat(known, begins, dtype=np.int64)), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(p, begins)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[tail].view(np.int64)))],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "tail"],
                )
                row += len(t)

    scored = texts.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, tail array<long>")
    scored = saved(scored, "scored")  # a row's number holds for one evaluation
    keys = ["doc_id", "held_out", "row", "n_tokens"]
    # a text's first line carries what is known; each of its other lines is a token of the tail
    anchor = F.struct(F.lit(None).cast("long").alias("token"), F.col("n_known").alias("k"), F.col("base_score").alias("b"), F.col("score").alias("s"))
    rest = F.transform("tail", lambda x: F.struct(x.alias("token"), F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("b"), F.lit(0.0).alias("s")))
    lines = scored.select(*keys, F.inline(F.concat(F.array(anchor), rest)))
    whole = lines.where("token is null").select(*keys, "k", "b", "s")
    tail = lines.where("token is not null").select(*keys, "token").join(counts, "token", "left")
    log_c = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))
    tail = tail.select(*keys, F.col("n").isNotNull().cast("long").alias("k"), (log_c - base_norm).alias("b"), (log_c - log_other).alias("s"))
    return (
        whole.union(tail).groupBy(*keys).agg(F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
    )
