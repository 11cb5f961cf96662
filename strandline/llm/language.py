"""Language identification by unigrams of pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.learning import fold, mapped, whole_texts
from strandline.llm.storage import saved

#: Labelled documents of each language, about, that the probabilities are learned from; and rounds of learning.
FIT_ROWS, ROUNDS = 600, 3
#: Distinct lang values whose counts are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
#: For learning alone, a longer word is taken in parts of so many bytes; words of one length are summed over in groups of so many.
FIT_BYTES, FIT_TOGETHER = 48, 4096
#: A longer word is scored beside others of about its length, the forward sums rescaled every so many bytes.
ALIKE, RESCALE = 48, 8
#: Bytes of words that are scored together.
TOGETHER = 1 << 20
#: A text counts as its language's until so many bytes of evidence speak: the rate of ``Model.learned`` is averaged with so many bytes of the language's own.
BENEFIT_BYTES = 100
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MARK = ord("_")  # stands for a word's beginning in the tables below
_CODE = np.random.default_rng(23).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _hash(rows: np.ndarray) -> np.ndarray:
    """Of equally long byte strings, one in each row. (Up to a few dozen bytes that a fixed vocabulary names, so none collide there.)"""
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = h * _TIMES + _CODE[rows[:, j]]
    return textbatch.mixed(h + np.uint64(rows.shape[1]))


class Pieces:
    """A fixed vocabulary's pieces by hash: two tables, so that a look-up is two reads."""

    BITS = 20

    def __init__(self, pieces: list[bytes]) -> None:
        single = [bytes([b]) for b in range(256)]
        self.pieces = single + sorted({p for p in pieces if len(p) > 1})
        self.lengths = sorted({len(p) for p in self.pieces})
        hashes = np.zeros(len(self.pieces), np.uint64)
        for size in {len(p) for p in self.pieces}:
            own = [i for i, p in enumerate(self.pieces) if len(p) == size]
            hashes[own] = _hash(np.array([list(self.pieces[i]) for i in own], np.uint8))
        self.hashes = hashes
        self.tables = []
        left = np.arange(len(hashes))
        for shift in (64 - self.BITS, 24, 3):
            slot = (hashes >> np.uint64(shift)).astype(np.int64) & ((1 << self.BITS) - 1)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot[left]] = left
            left = left[table[slot[left]] != left]
            self.tables.append((np.uint64(shift), table))
            if not len(left):
                break

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        for shift, table in self.tables:
            i = table[(h >> shift).astype(np.int64) & ((1 << self.BITS) - 1)]
            hit = (i >= 0) & (self.hashes[i] == h)
            out[hit] = i[hit]
        return out


def public_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model, lower-cased A-Z, with a mark for a word's beginning."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).replace("_", "\0").replace("▁", "_").encode().lower()
            if b"\0" not in raw and b"_" not in raw[1:]:
                out.append(raw)
    return out


def _edges(pieces: Pieces, rows: np.ndarray):
    """(end, length, which rows, which piece) of all pieces in equally long words, by end."""
    longest, wanted = pieces.lengths[-1], set(pieces.lengths)
    hashes: list[np.ndarray] = []  # of what begins at each of the last places and ends here, the latest last
    for end in range(1, rows.shape[1] + 1):
        code = _CODE[rows[:, end - 1]]
        hashes = [h * _TIMES + code for h in hashes[-(longest - 1) :]] + [code] if longest > 1 else [code]
        for length in range(1, len(hashes) + 1):
            if length in wanted:
                piece = pieces.find(textbatch.mixed(hashes[-length] + np.uint64(length)))
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    yield end, length, hit, piece[hit]


def forward(pieces: Pieces, p: np.ndarray, rows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """log of each word's probability in each language: the sum over all its segmentations.

    Words shorter than the rows have their ``sizes`` given. Sums are kept for as many places as the longest piece has, and
    divided by the latest one every ``RESCALE`` bytes, so a word may have any length.
    """
    n, width = rows.shape
    sizes = np.full(n, width) if sizes is None else sizes
    room = pieces.lengths[-1] + 1
    alpha = np.zeros((room, n, p.shape[1]))
    alpha[0] = 1
    scale, logs = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    last = 0

    def ended() -> None:
        done = np.flatnonzero(sizes == last)
        if len(done):
            logs[done] = np.log(alpha[last % room, done]) + scale[done]
        if last % RESCALE == 0 and 0 < last < width:
            now = alpha[last % room].copy()
            alpha[...] /= now
            scale[...] += np.log(now)

    for end, length, hit, piece in _edges(pieces, rows):
        if end != last:
            ended()
            last = end
            alpha[end % room] = 0
        alpha[end % room, hit] += alpha[(end - length) % room, hit] * p[piece]
    ended()
    return logs


def expected(pieces: Pieces, p: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words (``weight`` times each), in one language."""
    edges = list(_edges(pieces, rows))
    n, width = rows.shape
    alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    alpha[0] = beta[width] = 1
    for end, length, hit, piece in edges:
        alpha[end, hit] += alpha[end - length, hit] * p[piece]
    for end, length, hit, piece in reversed(edges):
        beta[end - length, hit] += beta[end, hit] * p[piece]
    out = np.zeros(len(p))
    scale = weight / np.maximum(alpha[width], 1e-300)
    for end, length, hit, piece in edges:
        out += np.bincount(piece, alpha[end - length, hit] * p[piece] * beta[end, hit] * scale[hit], len(p))
    return out


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of words to be scored together: of one length up to ``ALIKE`` bytes, beyond it of lengths within a quarter, ``TOGETHER`` bytes at most."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        least = sizes[order[lo]]
        most = least if least <= ALIKE else least + least // 4
        hi = int(np.searchsorted(sizes[order], most, "right"))
        hi = min(hi, lo + max(1, TOGETHER // int(most)))
        yield order[lo:hi]
        lo = hi


def _rows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words' lower-cased bytes after the mark; behind a word stands what follows in the text."""
    rows = np.full((len(starts), int(sizes.max()) + 1), _MARK, np.uint8)
    at = np.minimum(starts[:, None] + np.arange(rows.shape[1] - 1), len(data) - 1)
    rows[:, 1:] = textbatch._LOWER[data[at]]
    return rows


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    p: np.ndarray
    #: Of each language, log-probability a byte of its own texts, and the least that a text in it may have (see ``unlearned_rates``).
    rates: np.ndarray | None = None
    least: np.ndarray | None = None

    def learned(self, logs: np.ndarray, bytes_: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each text, with these ``evidence``, looks more like the language ``best`` than like text of no learned one."""
        rate = (logs[np.arange(len(best)), best] + BENEFIT_BYTES * self.rates[best]) / (bytes_ + BENEFIT_BYTES)
        return rate >= self.least[best]

    def evidence(self, t: textbatch.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log-probability in each language; the same of its words without ASCII digits alone, and these words' bytes (with a mark each).

        Numbers and tokens say little on whether a text is of a learned language.
        """
        w = textbatch.words(t)
        _, one, of = np.unique(w.hashes, return_index=True, return_inverse=True)
        starts, sizes = w.starts[one], (w.ends - w.starts)[one]
        logs = np.zeros((len(one), len(self.languages)))
        for own in _alike(sizes):
            logs[own] = forward(self.pieces, self.p, _rows(t.data, starts[own], sizes[own]), sizes[own] + 1)
        text = np.repeat(np.arange(len(t)), np.diff(w.first))
        digits = np.zeros(len(t.data) + 1, np.int32)
        np.cumsum((t.data >= 48) & (t.data <= 57), out=digits[1:])
        plain = digits[w.ends] == digits[w.starts]
        add = lambda at, k: np.bincount(text[at], logs[of[at], k], len(t))
        every, some = (np.array([add(at, k) for k in range(len(self.languages))]).T for at in (slice(None), plain))
        return every, some, np.bincount(text[plain], (w.ends - w.starts + 1)[plain], len(t))


def _learn(pieces: Pieces):
    """Piece probabilities of the language of some words (lang, word, n), by EM over all segmentations."""

    def run(found: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for word, n in sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True)):
            groups.setdefault(len(word), []).append((word, n))
        parts = [g[k : k + FIT_TOGETHER] for _, g in sorted(groups.items()) for k in range(0, len(g), FIT_TOGETHER)]
        made = [(np.array([[_MARK, *word] for word, _ in g], np.uint8), np.array([n for _, n in g], float)) for g in parts]
        own = np.array([4.0 ** (min(len(x), 12) - 1) for x in pieces.pieces])
        own /= own.sum()
        for _ in range(ROUNDS):
            total = sum(expected(pieces, own, *g) for g in made) + 0.01
            own = total / total.sum()
        return pa.table({"lang": found.column("lang").slice(0, 1), "p": pa.array([own.astype(np.float32).tobytes()], pa.binary())})

    return run


def unlearned_rates(model: Model, labelled: DataFrame) -> Model:
    """``model`` with ``rates`` and ``least``, from texts (text, lang) of its languages.

    How text that wasn't learned looks is taken from what is at hand: each text as the other languages see it (its rate in the best of
    these), and each text read backwards (letters of the language, in words of none). A language's least rate is midway between
    the mean rate of its own texts and that of the nearer of both kinds, each text counting once whatever its length. A language to which
    no such text comes takes the mean distance of the others; without any, nothing is unlearned. The tasks add up; three rows a language come back.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        number = {name: k for k, name in enumerate(own.languages)}
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text"), 1 << 20):
                _, logs, bytes_ = own.evidence(t)
                full = np.flatnonzero(bytes_)
                lang = np.array([number.get(x, -1) for x in batch.column("lang").slice(lo, len(t)).to_pylist()], np.int64)
                full = full[lang[full] >= 0]
                rates, lang = logs[full] / bytes_[full, None], lang[full]
                back = pa.array([t.raw(i).decode()[::-1] for i in full], pa.string())
                found = [(np.zeros(len(full), int), lang, rates[np.arange(len(full)), lang])]
                if len(own.languages) > 1:
                    rates[np.arange(len(full)), lang] = -np.inf
                    found.append((np.ones(len(full), int), rates.argmax(1), rates.max(1)))
                for _, b in textbatch.texts(back, 1 << 20):
                    _, turned, bytes_ = own.evidence(b)
                    found.append((np.full(len(b), 2), turned.argmax(1), turned.max(1) / bytes_))
                kind, at, rate = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(rate, pa.float64())], ["kind", "lang", "rate"])

    means = np.full((3, len(model.languages)), np.nan)
    rows = labelled.select("text", "lang").mapInArrow(run, "kind int, lang long, rate double")
    for r in rows.groupBy("kind", "lang").agg(F.avg("rate").alias("rate")).collect():
        means[r["kind"], r["lang"]] = r["rate"]
    distance = means[0] - np.fmax(means[1], means[2])
    distance = np.where(np.isnan(distance), np.nanmean(distance) if not np.isnan(distance).all() else np.inf, distance)
    rates = np.nan_to_num(means[0])
    return Model(model.pieces, model.languages, model.p, rates, rates - np.maximum(distance, 0) / 2)


def fitting(labelled: DataFrame) -> DataFrame:
    """About ``FIT_ROWS`` documents (doc_id, text, lang) of each language, chosen by a hash."""
    known = labelled.where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(FIT_ROWS) / F.count("*")).alias("share"))
    if counts.count() <= MOST_BROADCAST:
        counts = F.broadcast(counts)
    return known.join(counts, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < F.col("share") * 1_000_000)


def train(labelled: DataFrame, vocabulary: str, tell_learned: bool = False) -> Model:
    """Piece probabilities of each language in (doc_id, text, lang), by EM over all segmentations.

    Takes about ``FIT_ROWS`` documents of each language, chosen by a hash; their words are counted, and each language is learned,
    on the executors. A language is one row of a probability for each piece (130 KB) on the driver. With ``tell_learned``
    the same documents also give what text of no learned language looks like (``unlearned_rates``).
    """
    pieces = Pieces(public_pieces(vocabulary))
    some = saved(fitting(labelled), "fitting") if tell_learned else fitting(labelled)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            out: dict[tuple[str, bytes], int] = {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                for word in text.encode().lower().split():
                    for k in range(0, len(word), FIT_BYTES):
                        key = lang[i], word[k : k + FIT_BYTES]
                        out[key] = out.get(key, 0) + 1
            yield pa.record_batch([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()), pa.array(list(out.values()), pa.int64())], ["lang", "word", "n"])

    found = some.select("text", "lang").mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = found.groupBy("lang").applyInArrow(_learn(pieces), "lang string, p binary").orderBy("lang").collect()
    p = np.array([np.frombuffer(r["p"], np.float32) for r in learned], np.float32).reshape(-1, len(pieces.pieces))
    model = Model(pieces, [r["lang"] for r in learned], np.ascontiguousarray(p.T))
    return unlearned_rates(model, some) if tell_learned and model.languages else model


def identify_languages(docs: DataFrame, vocabulary: str, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_row: bool = False, tell_learned: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the language's posterior probability) of each row.

    Learns from the text and lang of documents whose fold isn't ``held`` (see ``train``). A text's probability in a language is
    the product of its words' (A-Z lower-cased), each the sum over all its segmentations into pieces of the public vocabulary and
    single bytes. What is broadcast is a probability for each piece and language.

    A null text or one without a letter is ``und`` with score 0, as is every text if there is nothing to learn from; equal
    probabilities go to the first language by name; rows with a null lang or text aren't learned from; a null id is in fold 0; repeated rows
    give repeated rows; an empty table gives an empty one; other columns are not looked at; with ``keep_row`` the rows come
    whole, and doc_id, lang_pred and score are a struct, the last column. ``tell_learned`` adds learned (boolean): false where the text,
    byte for byte, is less likely in the language found than ``unlearned_rates`` allows (``und`` is never learned). The score alone can't
    tell that: it compares learned languages with each other, and is near 1 for one of them in any long text.
    """
    model = train(whole_texts(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where(fold(F.col("doc_id"), folds) != held), vocabulary, tell_learned)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            lang, score, learned = [], [], []
            for _, t in textbatch.texts(batch.column("text"), 1 << 20):
                logs, plain, bytes_ = own.evidence(t) if own.languages else (np.zeros((len(t), 1)),) * 3
                best = logs.argmax(1)
                odds = np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                known = own.learned(plain, bytes_, best) if own.least is not None else np.ones(len(t), bool)
                for i in range(len(t)):
                    if own.languages and _LETTER.search(t.raw(i).decode()):
                        lang.append(own.languages[best[i]])
                        score.append(1 / odds[i])
                        learned.append(bool(known[i]))
                    else:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        learned.append(False)
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.record_batch(columns + [pa.array(learned, pa.bool_())] * tell_learned, ["doc_id", "lang_pred", "score"] + ["learned"] * tell_learned)

    found = mapped(docs, id_col, text_col, run, "doc_id long, lang_pred string, score double" + ", learned boolean" * tell_learned, keep_row)
    return found if keep_row else found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", *["learned"] * tell_learned)
