"""Test items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch

#: Permutations. Each is a band of one row: containment is sought at low Jaccard similarity.
PERMUTATIONS = 64
#: Bytes of an index, about, that is searched for in one pass over the documents; more items take more passes.
BLOCK = 96 << 20
#: Bytes of an item in an index besides its shingles.
ITEM = 64 * (4 + 4 + 32)
#: The smallest partition, in shingles.
LEAST = 2
_A = np.random.default_rng(5).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HALF = np.uint64(32)


class Index:
    """Items partitioned by the size of their shingle sets, each partition with its own hash tables.

    Partition c holds the items of over c / 2 and up to c shingles. They are compared with windows of
    2 * c shingles, c apart, so a passage of an item lies whole in some window, and their Jaccard similarity
    has a lower bound (about 0.18 at containment 0.75) however long the document is.
    """

    def __init__(self, ids: list, items: list[str], size: int) -> None:
        self.ids, self.sets = [], []
        for lo, t in textbatch.texts(pa.array(items, pa.string())):
            sh, first = textbatch.shingles(textbatch.words(t), size)
            for i in range(len(t)):
                if first[i + 1] > first[i]:
                    self.ids.append(ids[lo + i])
                    self.sets.append(np.unique(sh[first[i] : first[i + 1]]))
        classes = [max(LEAST, 1 << (len(s) - 1).bit_length()) for s in self.sets]
        self.tables = {}
        for c in sorted(set(classes)):
            own = np.array([i for i, x in enumerate(classes) if x == c])
            every = np.concatenate([self.sets[i] for i in own])
            begins = np.concatenate([[0], np.cumsum([len(self.sets[i]) for i in own])[:-1]])
            bits = max(10, math.ceil(math.log2(len(own))) + 4)
            marks = np.zeros((PERMUTATIONS, 1 << bits), bool)
            mask = np.uint32((1 << bits) - 1)
            values = np.empty((PERMUTATIONS, len(own)), np.uint32)
            for k in range(PERMUTATIONS):  # 32 bits of each minimum are kept: what they let through is verified
                values[k] = np.minimum.reduceat(every * _A[k], begins) >> _HALF
                marks[k, values[k] & mask] = True
            order = np.argsort(values, axis=1, kind="stable")
            self.tables[c] = np.take_along_axis(values, order, 1), own[order].astype(np.int32), marks, mask

    def candidates(self, sh: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which some window has a minimum in common."""
        many = np.diff(first)
        texts = np.flatnonzero(many)
        found: set[tuple[int, int]] = set()
        if not len(texts) or not self.tables:
            return found
        width = min(self.tables)
        begins, text, level = _cuts(first[:-1][texts], many[texts], width), None, None
        count = -(-many[texts] // width)
        level = np.empty((PERMUTATIONS, len(begins)), np.uint64)
        hashed = np.empty_like(sh)
        for k in range(PERMUTATIONS):
            np.multiply(sh, _A[k], out=hashed)
            np.minimum.reduceat(hashed, begins, out=level[k])
        while True:
            ends = np.cumsum(count)
            if width in self.tables:
                text = np.repeat(texts, count)
                after = np.arange(1, len(text) + 1)
                after[ends - 1] -= 1
                last = np.zeros(len(text), bool)  # a text's last block is in the window before
                last[ends[count > 1] - 1] = True
                self._look_up(width, level, after, np.flatnonzero(~last), text, found)
            if width >= max(self.tables):
                return found
            width *= 2
            starts = _cuts(ends - count, count, 2)
            level = np.minimum.reduceat(level, starts, axis=1)
            count = -(-count // 2)

    def _look_up(self, c: int, level: np.ndarray, after: np.ndarray, windows: np.ndarray, text: np.ndarray, found: set) -> None:
        values, owners, marks, mask = self.tables[c]
        for k in range(PERMUTATIONS):
            low = (np.minimum(level[k], level[k][after])[windows] >> _HALF).astype(np.uint32)
            hit = np.flatnonzero(marks[k][low & mask])
            a, b = np.searchsorted(values[k], low[hit], "left"), np.searchsorted(values[k], low[hit], "right")
            for i in np.flatnonzero(b > a):
                found.update((int(text[windows[hit[i]]]), int(j)) for j in owners[k, a[i] : b[i]])


def _cuts(begins: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Where blocks of ``width`` begin, for runs of ``counts`` that begin at ``begins``."""
    blocks = -(-counts // width)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(begins, blocks) + nth * width


def _matches(items: Index, t: textbatch.Texts, size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, shingles that they share) of every text that contains an item."""
    sh, first = textbatch.shingles(textbatch.words(t), size)
    last, own = -1, None
    for i, j in sorted(items.candidates(sh, first)):
        if i != last:
            last, own = i, np.unique(sh[first[i] : first[i + 1]])
        item = items.sets[j]
        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
        shared = int((own[at] == item).sum())
        if 100 * shared >= percent * len(item):
            yield i, j, shared


def _search(index, size: int, percent: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        kind = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            out = []
            ids = batch.column("doc_id")
            for lo, t in textbatch.texts(batch.column("text")):
                out += [(ids[lo + i].as_py(), items.ids[j], len(items.sets[j]), shared) for i, j, shared in _matches(items, t, size, percent)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, kind["string" if n == "item_id" and names[1] == "string" else "long"]) for n, c in zip(("doc_id", "item_id", "n_item", "n_shared"), columns, strict=True)], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _drop(index, size: int, percent: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            for lo, t in textbatch.texts(batch.column(text_col)):
                stays[[lo + i for i, _, _ in _matches(index.value, t, size, percent)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _blocks(benchmark: DataFrame, size: int, item_id_col: str, item_text_col: str) -> tuple[str, list]:
    """The items' kind of id, and a broadcast index of each block of items."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = "long" if dict(items.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    items = items.withColumn("item_id", F.col("item_id").cast(kind))
    # a shingle takes eight bytes, a word with its blank two at least
    blocks = max(1, math.ceil((items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) * 4 + ITEM)).first()[0] or 0) / BLOCK))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = items.where(block_of == b).collect()  # less than BLOCK bytes
        found.append(benchmark.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text or "" for r in rows], size)))
    return kind, found


def uncontaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, size: int = 5, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, whole, whose text contains no test item (see ``contaminated``). Each row is judged by itself, whatever its id."""
    for index in _blocks(benchmark, size, item_id_col, item_text_col)[1]:
        docs = docs.mapInArrow(_drop(index, size, percent, text_col), docs.schema)
    return docs


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    percent: int = 75,
    size: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that contain a test item.

    An item is contained if ``percent`` / 100 of its distinct ``size``-word shingles (A-Z lower-cased)
    occur anywhere in the document. Candidates come from minima of windows sized by the item's partition (see ``Index``),
    and each is verified on the exact sets of the whole item and the whole document.

    Items are searched for in blocks whose indexes take about ``BLOCK`` bytes, so what a task holds at a time has a bound;
    each block is one pass over the documents without a shuffle. An item's or text's null counts as empty;
    an item without words is contained in nothing; one of fewer words than ``size`` has its whole
    sequence as its only shingle, and is found in documents of that very sequence. Rows with a null id are searched too;
    repeated rows and items give repeated rows; an empty table gives an empty one; other columns are not looked at.
    """
    kind, blocks = _blocks(benchmark, size, item_id_col, item_text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for index in blocks:
        parts.append(texts.mapInArrow(_search(index, size, percent, ["long", kind]), f"doc_id long, item_id {kind}, n_item long, n_shared long"))
    found = reduce(DataFrame.union, parts)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))
