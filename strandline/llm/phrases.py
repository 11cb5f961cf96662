"""Phrases that stay together, mined from a weighted de Bruijn graph of word sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.storage import saved

#: Words of the longest phrase: an edge joins two nodes of one word less.
ORDER = 5
#: Bytes of a text worked on at once; a longer text is taken in windows that overlap by ORDER - 1 words.
WINDOW = 4 << 20
#: Edges that a task holds before it adds equal ones up and lets them go.
HELD = 1 << 20
#: Edges in a bucket, about. Words found more often than this (or than a 2^20th of all words, so there are at most 2^20 of them) spread their edges.
BUCKET = 1 << 20
#: Words that have a number of their own everywhere, the most frequent ones; blocks of edges spell the others by their hashes. 8 MB.
CODED = 1 << 20
#: Bits of the set of frequent words, at most: 16 MB. It has no false negatives; what else it lets in is counted and then dropped.
MOST_BITS = 1 << 27
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_U = np.uint64
_SHIFT = 21
_LOW = (1 << _SHIFT) - 1


def lang_key(lang: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


@dataclass
class Stretch:
    """Words of some texts: hashes (of language and word), byte spans, and which of them begin a piece."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    fresh: np.ndarray
    #: Words from the first on whose edges begin here; the rest only complete them.
    own: int


def _stretch(data: np.ndarray, edges: np.ndarray, langs: np.ndarray) -> Stretch:
    """Words of texts whose bounds in ``data`` are ``edges`` and whose languages' keys are ``langs``."""
    n = len(data)
    apart = _PIECE[data]
    solid = ~(apart | _BLANK[data])
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    hashes = textbatch.spans_hash(data, starts, ends)
    hashes = textbatch.mixed(hashes + langs[np.searchsorted(edges, starts, "right") - 1])
    # a piece begins with a word if a separator or a text's bound lies between it and the word before
    bounds = np.cumsum(apart) + np.cumsum(edge[:n])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = bounds[starts[1:]] != bounds[starts[:-1]]
    return Stretch(data, hashes, starts, ends, fresh, len(starts))


def _windows(data: np.ndarray, size: int) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether it goes on) of windows of a long text; one begins ORDER - 1 words before the end of the last."""
    lo = 0
    while True:
        hi = lo + size
        gap = ~(_PIECE[data] | _BLANK[data]) if lo == 0 else gap
        while hi < len(data):
            more = np.flatnonzero(~gap[hi : hi + size])
            if len(more):
                hi += int(more[0])
                break
            hi += size
        if hi >= len(data):
            yield lo, len(data), False
            return
        begins = np.flatnonzero(gap[lo:hi] & np.concatenate([[True], ~gap[lo : hi - 1]]))
        if len(begins) < 2 * ORDER:  # too few words to go on from: a longer window
            size *= 2
            continue
        yield lo, hi, True
        lo += int(begins[1 - ORDER])


def stretches(batch: pa.RecordBatch) -> Iterator[Stretch]:
    """Words of a batch's texts (columns lang and text), a few megabytes at a time."""
    langs = batch.column("lang").dictionary_encode()
    keys = np.array([lang_key(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    for lo, t in textbatch.texts(batch.column("text"), WINDOW):
        own = keys[lo : lo + len(t)]
        if len(t.data) <= 2 * WINDOW:
            yield _stretch(t.data, t.offsets, own)
            continue
        for a, b, goes_on in _windows(t.data, WINDOW):
            s = _stretch(t.data[a:b], np.array([0, b - a]), own)
            s.own -= (ORDER - 1) * goes_on
            yield s


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, word, hash and count of the words of each stretch."""
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            for s in stretches(own):
                h, at, many = np.unique(s.hashes[: s.own], return_index=True, return_counts=True)
                words = [s.data[a:b].tobytes().lower() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist(), strict=True)]
                yield pa.record_batch([pa.array([lang] * len(h), pa.string()), pa.array(words, pa.binary()), pa.array(h.view(np.int64)), pa.array(many, pa.int64())], ["lang", "word", "hash", "n"])


def _bits(size: int):
    """Pages (number, bytes) of the bit set of some hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(size, bool)
        for batch in batches:
            flags[batch.column("hash").to_numpy().view(np.uint64) % _U(size)] = True
        packed = np.packbits(flags).reshape(-1, min(size // 8, 1 << 14))
        held = np.flatnonzero(packed.any(1))
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array([packed[k].tobytes() for k in held], pa.binary())], ["page", "bits"])

    return run


def _or(group: pa.Table) -> pa.Table:
    made = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in group.column("bits")])
    return pa.table({"page": group.column("page").slice(0, 1), "bits": pa.array([made.tobytes()], pa.binary())})


def _frequent(vocabulary: DataFrame, many: int) -> np.ndarray:
    """Flags by hash modulo their number: every word of ``vocabulary`` has its flag. At most ``MOST_BITS`` bits, whatever the vocabulary."""
    size = min(MOST_BITS, 1 << max(17, (32 * many).bit_length()))
    pages = vocabulary.select("hash").mapInArrow(_bits(size), "page long, bits binary").groupBy("page").applyInArrow(_or, "page long, bits binary").collect()
    packed = np.zeros((-(-size // 8 // (1 << 14)) or 1, min(size // 8, 1 << 14)), np.uint8)
    for p in pages:
        packed[p.page] = np.frombuffer(p.bits, np.uint8)
    return packed


def _smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or int(x.max()) <= np.iinfo(t).max))


def packed(spelled: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Edges as bytes, and their number before they were compressed: hashes of the words without a code, a column of numbers of words for each place, and counts."""
    parts = [np.ascontiguousarray(c) for c in (spelled, *(_smallest(grams[:, k]) for k in range(ORDER)), _smallest(counts))]
    head = np.array([[len(p), p.itemsize] for p in parts], np.int64)
    raw = head.tobytes() + b"".join(p.tobytes() for p in parts)
    return len(raw), pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(data, size, asbytes=True)
    head = np.frombuffer(raw, np.int64, 2 * (ORDER + 2)).reshape(-1, 2)
    at, parts = head.nbytes, []
    for n, width in head.tolist():
        kind = np.uint64 if not parts else {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]
        parts.append(np.frombuffer(raw, kind, n, at))
        at += n * width
    return parts[0], np.stack([p.astype(np.int32) for p in parts[1:-1]], axis=1), parts[-1].astype(np.int64)


def added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ``grams`` in order, and the sums of their counts."""
    if not len(grams):
        return grams, counts
    if int(grams.max()) > _LOW:
        order = np.lexsort(grams.T[::-1])
        own = grams[order]
        fresh = (own[1:] != own[:-1]).any(1)
    else:  # two numbers for a row
        one = (grams[:, 0].astype(np.int64) << 2 * _SHIFT) | (grams[:, 1].astype(np.int64) << _SHIFT) | grams[:, 2]
        two = (grams[:, 3].astype(np.int64) << _SHIFT) | grams[:, 4]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        fresh = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    begins = np.flatnonzero(np.concatenate([[True], fresh]))
    return grams[order[begins]], np.add.reduceat(counts[order], begins)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], coded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts (hashes of words without a code, edges, counts) as one, equal edges added up. Numbers of words: 0 none, up to ``coded`` those with a code, then those spelled."""
    spelled = np.unique(np.concatenate([p[0] for p in parts]))
    grams = []
    for own, g, _ in parts:
        if len(own):
            to = np.concatenate([np.arange(coded + 1), coded + 1 + np.searchsorted(spelled, own)]).astype(np.int32)
            g = to[g]
        grams.append(g)
    counts = np.concatenate([p[2] for p in parts])
    parts.clear()
    return spelled, *added(np.concatenate(grams), counts)


@dataclass
class Codes:
    """Hashes of the words that have a code, most frequent first, and the counts of those found more often than ``least``."""

    hashes: np.ndarray
    hot: np.ndarray
    least: int

    def spread(self, grams: np.ndarray) -> list[np.ndarray]:
        """In how many parts the edges that begin with 2, 3 and 4 given words are kept, by the least count of these words.

        A prefix can't be found more often than its rarest word, so none has much more than ``least`` edges in a part.
        """
        found = np.concatenate([[self.least], self.hot, [self.least]])
        upper, out = None, []
        for k in range(ORDER - 1):
            own = found[np.minimum(grams[:, k], len(found) - 1)]
            upper = own if upper is None else np.minimum(upper, own)
            out += [-(-upper // self.least)] if k else []
        return out

    def buckets(self, spelled: np.ndarray, grams: np.ndarray, many: int) -> np.ndarray:
        """The bucket of each edge: by its first two words, and by further ones as far as what stands before them is kept in parts."""
        hashes = np.concatenate([np.zeros(1, np.uint64), self.hashes, spelled])
        key = textbatch.mixed(textbatch.mixed(hashes[grams[:, 0]]) + hashes[grams[:, 1]])
        for k, parts in enumerate(self.spread(grams)):
            apart = np.flatnonzero(parts > 1)
            part = textbatch.mixed(hashes[grams[apart, k + 2]] + _U(k + 1)) % parts[apart].astype(np.uint64)
            key[apart] = textbatch.mixed(key[apart] + part + _U(1))
        return (key % _U(many)).astype(np.int64)


def _edges(flags: np.ndarray, codes: Codes, buckets: int):
    """Edges of a task's words, added up, as a packed block for each bucket.

    An edge is a word and up to ORDER - 1 that follow in its piece. Near a piece's end it is shorter: that is the correction
    without which the sum of a node's edges would miss these occurrences. A word that can't be in a phrase, as it is too rare,
    ends a piece.
    """
    bits, coded = flags.size * 8, len(codes.hashes)
    order = np.argsort(codes.hashes)
    names = np.append(codes.hashes[order], _U(0))
    numbers_of = np.append(order + 1, 0).astype(np.int32)

    def edges(s: Stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(s.hashes)
        at = np.minimum(np.searchsorted(names[:-1], s.hashes), coded)
        numbers = np.where(names[at] == s.hashes, numbers_of[at], 0)
        left = np.flatnonzero(numbers == 0)
        bit = s.hashes[left] % _U(bits)
        left = left[(flags.reshape(-1)[bit >> _U(3)] >> (7 - (bit & _U(7)).astype(np.uint8))) & 1 == 1]
        spelled, own = np.unique(s.hashes[left], return_inverse=True)
        numbers[left] = coded + 1 + own
        held = numbers > 0
        breaks = s.fresh | ~held
        breaks[1:] |= ~held[:-1]
        nexts = np.append(np.flatnonzero(breaks), n)  # where the run of each word ends
        length = np.minimum(nexts[np.searchsorted(nexts, np.arange(n), "right")] - np.arange(n), ORDER) if n else np.zeros(0, int)
        first = np.flatnonzero(held[: s.own] & (length[: s.own] > 1))
        grams = np.concatenate([numbers, np.zeros(ORDER, np.int32)])[first[:, None] + np.arange(ORDER)]
        grams[np.arange(ORDER) >= length[first, None]] = 0
        return spelled, *added(grams, np.ones(len(grams), np.int64))

    def blocks(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        spelled, grams, counts = merged(held, coded)
        bucket = codes.buckets(spelled, grams, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        ids, data, sizes = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = grams[order[a:b]]
            more = np.unique(own[own > coded])
            if len(more):
                own = np.where(own > coded, coded + 1 + np.searchsorted(more, own), own)
            size, block = packed(spelled[more - coded - 1], own, counts[order[a:b]])
            ids.append(int(bucket[order[a]]))
            data.append(block)
            sizes.append(size)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["bucket", "size", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for s in stretches(batch):
                own = edges(s)
                if len(own[1]):
                    held.append(own)
                    many += len(own[1])
                if many >= HELD:
                    yield from blocks(held)
                    held, many = [], 0
        if many:
            yield from blocks(held)

    return run


def _flows(codes: Codes, group: pa.Table, support: int) -> pa.Table:
    """Counts of all phrases that begin in a bucket: for each length the sums of the edges that begin with one.

    Where a phrase's edges are kept in parts the sum is one of several, so it comes out however small it is.
    """
    parts = [unpacked(b, n) for b, n in zip(group.column("block").to_pylist(), group.column("size").to_pylist(), strict=True)]
    spelled, grams, counts = merged(parts, len(codes.hashes))
    spread = codes.spread(grams)
    hashes = np.concatenate([np.zeros(1, np.uint64), codes.hashes, spelled])
    out, sums = [], []
    for m in range(2, ORDER + 1):
        held = grams[:, m - 1] != 0
        own, flow = grams[held, :m], counts[held]
        if not len(own):
            continue
        begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
        own, flow = own[begins], np.add.reduceat(flow, begins)
        keep = flow >= support
        if m < ORDER:
            keep |= spread[m - 2][held][begins] > 1
        words = np.zeros((int(keep.sum()), ORDER), np.uint64)
        words[:, :m] = hashes[own[keep]]
        out.append(words)
        sums.append(flow[keep])
    words, sums = (np.concatenate(out), np.concatenate(sums)) if out else (np.zeros((0, ORDER), np.uint64), np.zeros(0, np.int64))
    return pa.table({**{f"w{k}": pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(ORDER)}, "n": pa.array(sums)})


def phrase_counts(docs: DataFrame, support: int = 100, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, hash, n, n_lang) and phrases of 2 to ``ORDER`` words (gram, an array of hashes, and n) found ``support`` times or more.

    Edges of the graph, runs of ``ORDER`` words or what is left of a piece, are added up in tasks and then in buckets by their first
    words; all shorter counts are sums over edges with a common beginning, so the text is shuffled once, packed. Words are numbers there,
    or 64-bit hashes of language and word where they aren't among the ``CODED`` most frequent. A bucket has about ``BUCKET`` edges; words found more often than that spread theirs by what follows, and those sums are added up again.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = texts.mapInArrow(_counted, "lang string, word binary, hash long, n long").groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))
    every = saved(every, "words")
    langs = every.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    total = langs.agg(F.sum("n_lang")).first()[0] or 0
    least = max(BUCKET, total >> 20)
    words = saved(every.where(F.col("n") >= support).join(langs, "lang").select("lang", F.col("word").cast("string").alias("word"), "hash", "n", "n_lang"), "vocabulary")
    top = words.orderBy(F.desc("n"), "hash").limit(CODED).select("hash", "n").toPandas()
    counts = top["n"].to_numpy(np.int64)
    codes = Codes(top["hash"].to_numpy(np.int64).view(np.uint64), counts[counts > least], least)
    sent = spark.sparkContext.broadcast((_frequent(words, words.count()), codes))
    buckets = max(1, total // BUCKET)
    fields = ", ".join(f"w{k} long" for k in range(ORDER)) + ", n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(*sent.value, buckets)(batches)

    def flow(group: pa.Table) -> pa.Table:
        return _flows(sent.value[1], group, support)

    blocks = texts.mapInArrow(run, "bucket long, size long, block binary")
    flows = blocks.groupBy("bucket").applyInArrow(flow, fields)
    keys = [f"w{k}" for k in range(ORDER)]
    counts = flows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    gram = F.filter(F.array(*keys), lambda w: w != 0)
    return words, saved(counts.select(gram.alias("gram"), "n"), "phrases")


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, support: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` best phrases.

    A phrase of 2 to ``ORDER`` words found ``a`` times (``support`` or more) is cut after each of its words; with l and r counts of its
    parts, and n words in the language, the cut's score is floor(1000 * a * n / (l * r)), in decimals of 38 digits; the lowest cut (the earliest of several) is
    the phrase's. A node of the graph whose whole flow goes on through one edge is a unary path and is compacted into it: a phrase
    goes if one word more, before or after, is found as often. (Anything longer that has it as often has such a one between.)

    Texts are lower-cased A-Z and split into pieces at ``.,;:!?`` and ends of lines, and pieces at blanks and tabs; phrases don't
    leave a piece. A null language is ``und``; a null text, or one without words, has nothing; repeated rows count each time; phrases of one score and count
    are ranked by their bytes. An empty table gives an empty one; other columns are not looked at.
    """
    words, found = phrase_counts(docs, support, text_col, lang_col)
    single = words.select(F.array("hash").alias("gram"), "n")
    longer = found.where(F.size("gram") > 2).select(F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"), F.col("n").alias("in"))
    open_ = found.join(longer.groupBy("gram").agg(F.max("in").alias("in")), "gram", "left").where(F.col("in").isNull() | (F.col("in") < F.col("n"))).drop("in")
    cuts = open_.select("gram", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    parts = saved(found.unionByName(single), "parts")
    left, right = parts.select(F.col("gram").alias("left"), F.col("n").alias("l")), parts.select(F.col("gram").alias("right"), F.col("n").alias("r"))
    cuts = cuts.withColumn("left", F.expr("slice(gram, 1, k)")).withColumn("right", F.expr("slice(gram, k + 1, size(gram) - k)")).join(left, "left").join(right, "right")
    of = words.select("hash", "lang", "word", "n_lang")
    named = cuts.withColumn("hash", F.col("gram")[0]).join(of.select("hash", "lang", F.col("n_lang").alias("n")), "hash")
    score = F.expr("cast(1000 as decimal(4,0)) * a_ * n_ div (l_ * r_)")
    scored = named.select("lang", "gram", "k", "a", "l", "r", "n", *[_exact(F.col(c)).alias(f"{c}_") for c in "alrn"]).withColumn("score", score)
    best = scored.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("*", F.posexplode("gram").alias("at", "hash")).join(of.select("hash", "word"), "hash").groupBy("lang", "gram", "a", "n", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("own"))
    rows = spelled.select("lang", F.array_join("own.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    # the first of each language's parts, then of these: no language is one task's
    order = "order by score desc, a desc, phrase"
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.expr(f"row_number() over (partition by lang, part {order})")).where(F.col("rank") <= first)
    return some.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as long)")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
