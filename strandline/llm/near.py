"""Near-duplicate documents by min-max hashing, banded, with every link confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.components import connected_components, relabelled, rooted
from strandline.llm.storage import saved

#: Permutations; each gives two signature values, its least and its greatest hash.
PERMUTATIONS = 64
#: Values in a band. A pair at 0.75 shares none of the 2 * 64 / 4 bands once in 200,000 times.
ROWS = 4
_A = np.random.default_rng(99).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes in a block, about; two blocks' sets are compared in one task.
BLOCK = 256


def signatures(sh: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Band keys (rows x bands) of the shingle runs that begin at ``begins``.

    One multiplication for each permutation and shingle serves two values. Bands take the least
    values, or the greatest, of distinct permutations, so values within a band are independent.
    """
    values = np.empty((2, PERMUTATIONS, len(begins)), np.uint64)
    hashed = np.empty_like(sh)
    for k in range(PERMUTATIONS):
        np.multiply(sh, _A[k], out=hashed)
        np.minimum.reduceat(hashed, begins, out=values[0, k])
        np.maximum.reduceat(hashed, begins, out=values[1, k])
    grouped = textbatch.mixed(values.reshape(-1, ROWS, len(begins)))
    bands = np.zeros((len(grouped), len(begins)), np.uint64)
    for r in range(ROWS):
        bands = textbatch.mixed(bands + grouped[:, r])
    return (bands + textbatch.mixed(np.arange(len(bands), dtype=np.uint64))[:, None]).T


def _arrays(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _key(w: textbatch.Words, i: int) -> bytes | None:
    own = w.hashes[w.first[i] : w.first[i + 1]]
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text")):
                w = textbatch.words(t)
                sh, first = textbatch.shingles(w, size)
                full = np.diff(first) > 0
                bands = signatures(sh, first[:-1][full]) if full.any() else np.zeros((0, 0), np.uint64)
                n = [len(np.unique(sh[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, len(t)), batch.column("text_key").slice(lo, len(t)), pa.array([_key(w, i) for i in range(len(t))], pa.binary()), pa.array(n, pa.int64()), _arrays(bands.ravel().view(np.int64), full * bands.shape[1], pa.int64())],
                    ["doc_id", "text_key", "node", "n_shingles", "bands"],
                )

    return run


def _sets(size: int):
    """Nodes and their sets; a node that several rows of a task have comes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, t in textbatch.texts(batch.column("text")):
                w = textbatch.words(t)
                keys = [_key(w, i) for i in range(len(t))]
                fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
                if not fresh:
                    continue
                sh, first = textbatch.shingles(w, size)
                own = [np.unique(sh[first[i] : first[i + 1]]) for i in fresh]
                yield pa.record_batch(
                    [pa.array([keys[i] for i in fresh], pa.binary()), _arrays(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())],
                    ["node", "shingles"],
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """Pairs (a, b, and columns ``more``) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .select("a", "b", *more, F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
        .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
        .select("a", "b", *more)
    )


def _forest(one: np.ndarray, two: np.ndarray, most: int) -> list[int]:
    """Which of the links between ``one`` and ``two`` (numbers below ``most``) are needed to connect what they connect."""
    up = list(range(most))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    needed = []
    for i, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            needed.append(i)
    return needed


def _linked(percent: int):
    """Which components are linked by nodes of two blocks, or of one: products of the nodes' incidence matrices.

    Of the links found only a forest comes out, so there are fewer than the blocks have components.
    """

    def run(block: pa.Table) -> pa.Table:
        one = block.column("one").to_numpy()
        named = block.column("label").combine_chunks().dictionary_encode()
        label = named.indices.to_numpy()
        arrays = block.column("shingles").combine_chunks()
        sizes = np.diff(arrays.offsets.to_numpy()).astype(np.float32)
        row = np.repeat(np.arange(len(sizes)), np.diff(arrays.offsets.to_numpy()))
        values, column, times = np.unique(arrays.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[column] > 1  # only what two nodes have can be in an intersection
        row, column = row[shared], np.cumsum(times > 1)[column[shared]] - 1
        left = np.flatnonzero(one)
        both = np.zeros((len(left), len(sizes)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, (lo, lo + 8192))
            part = np.zeros((len(sizes), 8192), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            both += part[left] @ part.T
        close = 100 * both >= percent * (sizes[left][:, None] + sizes[None] - both)
        close &= label[left][:, None] != label[None]
        i, j = np.nonzero(close)
        many = len(named.dictionary)
        pairs = np.unique(label[left[i]].astype(np.int64) * many + label[j])
        a, b = pairs // many, pairs % many
        needed = np.array(_forest(a, b, many), np.int64)
        names = named.dictionary.cast(pa.binary())
        return pa.table({"a": names.take(pa.array(a[needed])), "b": names.take(pa.array(b[needed]))})

    return run


def _mixed(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(bucket, node, leader, label, top, low) of the buckets whose nodes are in several components, so far; ``top`` is the leader's, ``low`` the least."""
    held = saved(members.join(labels, "node", "left").select("bucket", "node", "leader", F.coalesce("label", "node").alias("label")), name)
    several = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("leader"), F.col("label"))).alias("top"))
    return saved(held.join(several.where("low <> high").drop("high"), "bucket"), name)


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` with the components that ``found`` (a, b) links as one; those of a single node come in."""
    merged = connected_components(found)
    fresh = merged.join(labels, "node", "left_anti")
    return saved(relabelled(labels, merged).union(fresh), "labels")


def _rest(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components whose nodes share a bucket.

    Components that meet in a bucket are of one group. Within a group, each node outside its largest component is compared with
    all nodes. Groups are cut into
    blocks of about ``BLOCK`` nodes by a hash, and each pair of blocks is a task of its own, so a group of any size is spread
    out, its sets are sent once for each block they meet, and only links that connect components come out.
    """
    active = saved(mixed.select("node", "label").distinct(), "active")
    groups = connected_components(mixed.select(F.col("low").alias("a"), F.col("label").alias("b")).distinct())
    sizes = active.groupBy("label").agg(F.count("*").alias("n")).join(groups.select(F.col("node").alias("label"), F.col("label").alias("grp")), "label")
    largest = sizes.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    counts = largest.select(
        "grp",
        F.col("top.label").alias("major"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("majors"),
    )
    of_label = saved(sizes.select("label", "grp").join(counts, "grp"), "groups")
    placed = active.join(of_label, "label").withColumn("minor", F.col("label") != F.col("major"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    # a task is (i, j): minor block i against minor block j >= i, or against major block j - minors
    pairs = F.when(
        F.col("minor"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))),
            F.transform(F.sequence(F.col("own"), F.col("minors") + F.col("majors") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(i.alias("i"), (F.col("own") + F.col("minors")).alias("j"))))
    tasks = (
        placed.withColumn("own", own)
        .select("grp", "node", "label", F.explode(F.array_distinct(pairs)).alias("t"), "own", "minor")
        .select("grp", "t.i", "t.j", "node", "label", (F.col("minor") & (F.col("own") == F.col("t.i"))).alias("one"))
        .join(sets, "node")
    )
    return tasks.groupBy("grp", "i", "j").applyInArrow(_linked(percent), "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", keep_key: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more are linked; component_id is the least doc_id that can be reached, kept is doc_id = component_id.

    Documents of one word sequence are one node (a partial aggregation, so thousands of copies are no hot task).
    Nodes that share a band meet in its bucket. No bucket's pairs are all made. First each node is tested against one other,
    the least leader (least node) of its buckets; then, where a bucket's nodes are in different components, against the leaders
    of these buckets; where that still leaves several components in a bucket, ``_rest`` tests them in blocks and
    returns links between components alone. So every pair that shares a band is either tested or already in one component.

    A text that is null, empty or white space has no shingles and is linked with nothing; one of fewer words has
    its whole sequence as the only shingle. Rows with a null id are linked with nothing, have a
    null component_id and are kept. Rows that repeat an id get that id's component each; an empty table
    gives an empty one; other columns are not looked at. ``keep_key`` adds text_key, the text's xxhash64, so that rows
    of one id and different texts can be told apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    base = saved(keyed.mapInArrow(_fingerprints(size), "doc_id long, text_key long, node binary, n_shingles long, bands array<long>"), "fingerprints")
    nodes = saved(
        base.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    members = saved(every.join(crowded, "bucket"), "members")

    wanted = nodes.select("node", F.col("rep").alias("doc_id")).join(members.select("node").distinct(), "node", "left_semi")
    few = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # rows that repeat a wanted id give its node again and again: one set a node, or each link would come out once for each pair of rows
    found = few.mapInArrow(_sets(size), "node binary, shingles array<long>").join(wanted.select("node"), "node", "left_semi")
    sets = saved(found.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")

    others = members.where("node <> leader")
    first = _confirmed(others.groupBy("node").agg(F.min("leader").alias("a")).select("a", F.col("node").alias("b")), sets, percent)
    labels = rooted(first.select(F.col("b").alias("node"), F.col("a").alias("label")))
    labels = saved(labels.union(labels.select(F.col("label").alias("node"), "label").distinct()), "labels")
    mixed = _mixed(members, labels, "mixed")
    again = mixed.where((F.col("node") != F.col("leader")) & (F.col("label") != F.col("top")))
    ends = again.select(F.col("leader").alias("a"), F.col("node").alias("b"), "label", "top").distinct()
    links = _confirmed(ends, sets, percent, "label", "top").select(F.col("label").alias("a"), F.col("top").alias("b")).distinct()
    labels = _merged(labels, links)
    fresh = saved(_rest(_mixed(mixed.select("bucket", "node", "leader"), labels, "mixed"), sets, percent), "links")
    if not fresh.isEmpty():
        labels = _merged(labels, fresh)

    least = saved(labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    of_node = saved(labels.join(least, "label").select("node", "component_id"), "components")
    reps = nodes.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return base.select("doc_id", "text_key", "node", "n_shingles").join(saved(reps, "components"), "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        *["text_key"] * keep_key,
    )
