"""Token counts, and BPE encoding and decoding, of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bpe, textbatch
from strandline.llm.learning import mapped, whole_texts

_MADE: dict[tuple, object] = {}


def _once(kind: str, text: str, make: Callable):
    """Kept in the Python worker between tasks."""
    key = kind, hash(text)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _vocabulary(text: str) -> bpe.Vocabulary:
    return _once("vocabulary", text, lambda: bpe.Vocabulary(text))


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, in one pass without a shuffle.

    ``tokenizer`` is the path of a byte-level BPE vocabulary (JSON); the driver reads it and
    broadcasts it (its size is fixed: 50,000 merges are 1.5 MB). Tokens are counted by heap merging:
    bytes less merges. Special strings in a text count as one token each.
    A null or empty text has no tokens; a null id stays null; repeated rows give repeated rows; an
    empty table gives an empty one; other columns are not looked at.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = vocabulary.value
        count = _once("counter", text, lambda: bpe.counter(_vocabulary(text))).text
        for batch in batches:
            sizes, tokens = [], []
            for _, some in textbatch.texts(batch.column("text")):
                sizes.append(np.diff(some.offsets))
                tokens += [count(some.raw(i).decode()) for i in range(len(some))]
            if tokens:
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    found = whole_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


#: Mean bytes of a content-defined chunk (a power of two), the least and the most.
CHUNK, LEAST, MOST = 1024, 128, 16384
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(t: textbatch.Texts) -> list[list[int]]:
    """For each text, where its chunks end: places chosen by a rolling hash of the 16 bytes before.

    Equal passages get equal chunks wherever they stand, save for the first and last one.
    """
    h = _GEAR[t.data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    cut = np.flatnonzero((h >> np.uint32(32 - CHUNK.bit_length() + 1)) == 0) + 1
    first = np.searchsorted(cut, t.offsets)
    data, out = t.data, []
    for i in range(len(t)):
        begin, end = int(t.offsets[i]), int(t.offsets[i + 1])
        ends, last = [], begin
        for p in cut[first[i] : first[i + 1]].tolist() + [end]:
            while p - last > MOST:
                last += MOST
                while data[last] & 0xC0 == 0x80:
                    last += 1
                ends.append(last)
            while p < end and data[p] & 0xC0 == 0x80:
                p += 1
            if p - last >= LEAST and p < end:
                ends.append(last := p)
        if end > begin:
            ends.append(end)
        out.append(ends)
    return out


class Chunk(NamedTuple):
    """A chunk encoded by itself: its first pre-tokens with their identifiers, the identifiers between, and the last pre-token's text."""

    head: list[str]
    ids: list[bytes]
    middle: bytes
    last: str


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk seen before, in any document, is not encoded again.

    Where two chunks join, the text from the last pre-token of the first one on is encoded anew, and its pre-tokens are
    compared with the second chunk's own: from the first place on where both begin the same pre-token with the same identifiers, the
    second chunk's encoding holds, since what follows such a place doesn't depend on what is before it. (All but the last pre-token of a chunk end
    within it, so the last one's beginning holds too.) Where none of the first ``HEAD`` agrees, the whole chunk is part of the join, which then
    goes on to the next one.
    """

    ROOM, HEAD = 24 << 20, 6

    def __init__(self, vocabulary: bpe.Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.encode = bpe.encoder(vocabulary)
        self.kept: dict[bytes, Chunk | str] = {}
        self.used = self.hits = self.misses = 0

    def chunk(self, raw: bytes) -> Chunk | str:
        """The encoded chunk; or its text, if it has too few pre-tokens for a join at both ends."""
        if (found := self.kept.get(raw)) is not None:
            self.hits += 1
            return found
        self.misses += 1
        text = raw.decode()
        head, size = [], 0
        for m in bpe.PATTERN.finditer(text):
            if len(head) == self.HEAD:
                break
            head.append(m[0])
            size = m.end()
        # the last pre-token begins where a blank or line feed does that can't belong to one before
        last = max(text.rfind(" "), text.rfind("\n"))
        while last > size and not self._begins(text, last):
            last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
        if last > size:
            found = Chunk(head, [self.encode.piece(x) for x in head], self.encode.plain(text[size:last]), text[last:])
            self.used += len(raw) + len(found.middle) + 1000
        else:
            found = text
            self.used += 2 * len(raw) + 300
        if self.used > self.ROOM:
            self.kept.clear()
            self.used = 0
        self.kept[raw] = found
        return found

    @staticmethod
    def _begins(text: str, at: int) -> bool:
        """Whether a pre-token surely begins at white space: what is before isn't white space, nor what follows."""
        return at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace() and text[at - 1].isprintable() and text[at + 1].isprintable()

    def _agreed(self, join: str, chunk: Chunk) -> tuple[bytes, int]:
        """Identifiers of ``join`` and the chunk's beginning up to where the two encodings agree, and that pre-token's number; 0 if they don't."""
        starts, size = {}, len(join)
        for j, piece in enumerate(chunk.head):
            starts[size] = j
            size += len(piece)
        out = []
        for m in bpe.PATTERN.finditer(join + "".join(chunk.head)):
            j = starts.get(m.start(), 0)
            if j and m.end() < size and chunk.head[j] == m[0] and self.encode.piece(m[0]) == chunk.ids[j]:
                return b"".join(out), j
            out.append(self.encode.piece(m[0]))
        return b"", 0

    def plain(self, t: textbatch.Texts, i: int, ends: list[int]) -> bytes:
        """Packed identifiers of text i, which has no special string, from its chunks."""
        raw, out, join, last = t.raw(i), [], "", 0
        for end in (e - int(t.offsets[i]) for e in ends):
            begin, last = last, end
            found = self.chunk(raw[begin:end])
            if isinstance(found, str):
                join += found
                continue
            if join:
                ids, agreed = self._agreed(join, found)
                if not agreed:
                    join += raw[begin:end].decode()
                    continue
                out += [ids, *found.ids[agreed:], found.middle]
            else:
                out += [*found.ids, found.middle]
            join = found.last
        if join:
            out.append(self.encode.plain(join))
        return b"".join(out)

    def ids(self, t: textbatch.Texts) -> Iterator[bytes]:
        """Packed identifiers of each text; what stands between special strings is encoded by itself."""
        special = self.vocabulary.special
        bpe.foresee(self.encode, t.data)
        for i, ends in enumerate(chunk_ends(t)):
            raw = t.raw(i)
            if not any(name.encode() in raw for name in special):
                yield self.plain(t, i, ends)
                continue
            parts = self.vocabulary.cut.split(raw.decode())
            some = next(textbatch.texts(pa.array(parts), len(raw) + 1))[1]
            yield b"".join(bpe.packed([special[x]]) if k % 2 else self.plain(some, k, e) for k, (x, e) in enumerate(zip(parts, chunk_ends(some), strict=True)))


def decoded(vocabulary: bpe.Vocabulary, ids: bytes) -> bytes:
    """The text's UTF-8; bytes that aren't UTF-8 become replacement characters."""
    raw = b"".join(map(vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    try:
        raw.decode()
    except UnicodeDecodeError:
        raw = raw.decode(errors="replace").encode()
    return raw


def encode_documents(
    docs: DataFrame, tokenizer: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, ids (array of int).

    One pass without a shuffle. Every Python worker keeps the chunks it has encoded (24 MB), so shared
    passages cost one look-up; results don't depend on what is kept. Every text is decoded again from its identifiers.
    A null or empty text has no identifiers (the digests of nothing); a null id stays null; repeated
    rows give repeated rows; an empty table gives an empty one; other columns are not looked at; with
    ``keep_row`` the rows come whole, and the rest is a struct, the last column.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = vocabulary.value
        words = _vocabulary(text)
        encoder = _once("chunks", text, lambda: ChunkEncoder(words))
        for batch in batches:
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
            for lo, some in textbatch.texts(batch.column("text")):
                n, hashes, backs, arrays = [], [], [], []
                for ids in encoder.ids(some):
                    n.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    backs.append(hashlib.sha256(decoded(words, ids)).hexdigest())
                    if keep_ids:
                        arrays.append(np.frombuffer(ids, "<u4").astype(np.int32))
                columns = [batch.column("doc_id").slice(lo, len(some)), pa.array(n, pa.int64()), pa.array(hashes), pa.array(backs)]
                yield pa.record_batch(columns + [pa.array(arrays, pa.list_(pa.int32()))] * keep_ids, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return mapped(docs, id_col, text_col, run, schema, keep_row)


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded``'s doc_id with the text of its identifiers. Null identifiers give a null text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary.value)
        for batch in batches:
            out = [None if x is None else decoded(words, np.array(x, "<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
