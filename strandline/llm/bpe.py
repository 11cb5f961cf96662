"""Byte-level byte-pair merging with a fixed public vocabulary.

Each stretch of text between pre-token boundaries is merged by a heap and a linked list: the heap
gives the adjacent pair of lowest rank, the list joins the two symbols. The number of tokens is the
number of symbols at the start less the number of merges. Where identifiers are asked for, short words
are merged without a heap, most of them side by side in arrays.
"""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import regex

#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: White space other than the blank and the line feed, as the pattern's \s takes it.
_ODD_SPACE = regex.compile(r"[\s--[ \n]]", regex.V1)
#: Bits of a symbol in a number that holds two.
SYMBOL = 20
MASK = (1 << SYMBOL) - 1
#: Bytes of a word whose pairs are looked through for each merge, at most; what a pair without a merge counts as, more than any merge; words merged side by side.
SHORT, NONE, SIDE = 40, 1 << 62, 4096
#: Bytes that a worker keeps in the cache of words, about, those in the other two, and the longest text kept as a key.
ROOM, LESS_ROOM, KEY_CHARS = 48 << 20, 8 << 20, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in names]
    return [names.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merge ranks and symbols of a tokenizer's JSON text."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        self.of_byte = [ids[c] for c in byte_symbols()]
        # of two symbols as one number: the merge's rank and the new symbol, likewise
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << SYMBOL | ids[b]] = rank << SYMBOL | ids[a + b]
        keys = np.array(sorted(self.rank), np.int64)
        self.pairs = keys, np.array([self.rank[k] for k in keys.tolist()], np.int64)
        self.symbol_of_byte = np.array(self.of_byte, np.int64)
        self.byte_pairs = self.merge_of(np.repeat(self.symbol_of_byte, 256), np.tile(self.symbol_of_byte, 256))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for name, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in name if c in back)
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        ordered = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """The symbols that stay, with gaps at -1, and how many merges were made."""
        symbol = [self.of_byte[b] for b in word]
        n = len(symbol)
        if n < 2:
            return symbol, 0
        found = self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # a pair's merge and its place as one number, so that the least is the merge of lowest rank, the leftmost
        heap = [merge * n + i for i in range(n - 1) if (merge := found(symbol[i] << SYMBOL | symbol[i + 1]))]
        heapify(heap)
        merges = 0
        while heap:
            merge, left = divmod(heappop(heap), n)
            right, one = after[left], symbol[left]
            # one of the two may have been merged meanwhile
            if right >= n or one < 0 or found(one << SYMBOL | symbol[right]) != merge:
                continue
            symbol[left] = one = merge & MASK
            symbol[right] = -1
            merges += 1
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if merge := found(one << SYMBOL | symbol[beyond]):
                    heappush(heap, merge * n + left)
            if (ahead := before[left]) >= 0 and (merge := found(symbol[ahead] << SYMBOL | one)):
                heappush(heap, merge * n + ahead)
        return symbol, merges

    def symbols(self, word: bytes) -> list[int]:
        """The symbols that stay. A short word's pairs are looked through for each merge, which takes less than a heap of them; longer ones go to ``merge``."""
        if len(word) > SHORT:
            return [i for i in self.merge(word)[0] if i >= 0]
        found, out = self.rank.get, [self.of_byte[b] for b in word]
        pairs = [found(a << SYMBOL | b, NONE) for a, b in pairwise(out)]
        while (merge := min(pairs, default=NONE)) != NONE:
            at = pairs.index(merge)
            out[at] = one = merge & MASK
            del out[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = found(one << SYMBOL | out[at + 1], NONE)
            if at:
                pairs[at - 1] = found(out[at - 1] << SYMBOL | one, NONE)
        return out

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, merges = self.pairs
        wanted = left << SYMBOL | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, merges[at], NONE)

    def packed_words(self, words: list[bytes]) -> list[bytes]:
        """``packed(symbols(word))`` of words that aren't empty, many side by side: each step makes the next merge of every word that has one left."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for lo in range(0, len(order), SIDE):
            some = order[lo : lo + SIDE]
            for k, ids in zip(some, self._side_by_side([words[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        wide = int(size.max())
        left = np.arange(wide) < size[:, None]  # symbols that aren't merged into one before
        raw = np.zeros((len(words), wide), np.int64)
        raw[left] = np.frombuffer(b"".join(words), np.uint8)
        table = np.full((len(words), wide), NONE)
        table[:, :-1] = np.where(left[:, 1:], self.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]], NONE)
        # all as one row, a word's symbols from its base on; after and before are places within the word
        symbol, merges, stays = self.symbol_of_byte[raw].ravel(), table.ravel(), left.ravel()
        after, before = np.tile(np.arange(1, wide + 1), len(words)), np.tile(np.arange(-1, wide - 1), len(words))
        rows = np.arange(len(words))
        while True:
            place = table[rows].argmin(1)  # the least merge, the leftmost
            best = merges[rows * wide + place]
            goes = best != NONE
            rows, place, best = rows[goes], place[goes], best[goes]
            if not len(rows):
                break
            base, one = rows * wide, best & MASK
            at = base + place
            gone = base + after[at]
            beyond, ahead = after[gone], before[at]
            symbol[at], after[at], stays[gone], merges[gone], merges[at] = one, beyond, False, NONE, NONE
            has = beyond < size[rows]
            then = (base + beyond)[has]
            before[then] = place[has]
            merges[at[has]] = self.merge_of(one[has], symbol[then])
            has = ahead >= 0
            then = (base + ahead)[has]
            merges[then] = self.merge_of(symbol[then], one[has])
        ids = symbol[stays].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class _Cache(dict):
    """Results by text. When they take half of ``room`` bytes (200 for an entry without its characters and identifiers, about), they
    become the old half, and the old half before goes; what is asked for again is taken over.
    """

    def __init__(self, make, prefix: str = "", room: int = LESS_ROOM) -> None:
        self.make, self.prefix, self.room, self.used, self.old = make, prefix, room, 0, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(self.prefix + key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(key) <= KEY_CHARS:
            if self.used >= self.room // 2:
                self.old = dict(self)
                self.clear()
                self.used = 0
            self[key] = value
            self.used += 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)


class Splitter:
    """Cuts texts where pre-tokens end for sure, and sums what ``leaf`` gives for each part.

    A blank, or a lone line feed, between two characters that aren't white space always begins a
    pre-token, so the parts between such places can be taken one by one, and kept by their text.
    """

    def __init__(self, vocabulary: Vocabulary, leaf, line_feed, total, special) -> None:
        self.vocabulary, self.leaf, self.line_feed, self.total, self.special = vocabulary, leaf, line_feed, total, special
        self.pretoken = _Cache(leaf)
        self.at_start = _Cache(self.whole)
        self.after_blank = _Cache(self.whole, " ", ROOM)

    def whole(self, text: str):
        found = PATTERN.findall(text)
        return self.leaf(text) if len(found) == 1 else self.total(map(self.piece, found))

    def piece(self, pretoken: str):
        """Of one pre-token; one that begins with a blank is kept as a part after a blank is."""
        if pretoken[0] == " " and not pretoken.isspace():
            return self.after_blank[pretoken[1:]]
        return self.pretoken[pretoken]

    def plain(self, text: str):
        """Of a text without special tokens."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return self.whole(text)
        found, blank = [], self.after_blank.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                found.append(self.line_feed)
            parts = line.split(" ")
            found.append(self.at_start[parts[0]])
            found.extend(map(blank, parts[1:]))
        return self.total(found)

    def text(self, text: str):
        cut = self.vocabulary.cut
        if cut is None or not any(name in text for name in self.vocabulary.special):
            return self.plain(text)
        return self.total(self.special(x) if k % 2 else self.plain(x) for k, x in enumerate(cut.split(text)))


def counter(vocabulary: Vocabulary) -> Splitter:
    """Its text(x) is the number of tokens of x; no identifiers are made."""

    def leaf(pretoken: str) -> int:
        raw = pretoken.encode()
        return len(raw) - vocabulary.merge(raw)[1]

    return Splitter(vocabulary, leaf, leaf("\n"), sum, lambda name: 1)


#: The type code of unsigned integers of four bytes.
_FOUR = "I" if array("I").itemsize == 4 else "L"


#: Letters alone, which with a blank before them are one pre-token.
_LETTERS = regex.compile(r"\p{L}+")
#: Bytes of text whose words are merged together, and what is taken off a word's ends to find its letters.
WINDOW, MARKS = 1 << 20, b".,;:!?\"'()"


def foresee(splitter: Splitter, data: np.ndarray) -> None:
    """Encodes words of letters in ``data`` (texts in UTF-8) that ``splitter``, an ``encoder``, will ask for and hasn't kept, side by side."""
    kept, old = splitter.after_blank, splitter.after_blank.old
    for lo in range(0, len(data), WINDOW):
        words = {w.strip(MARKS) for w in set(data[lo : lo + WINDOW].tobytes().split())}
        # words cut by the window's ends may not be UTF-8; what stands for such bytes is no letter
        words = b" ".join(w for w in words if len(w) < SHORT).decode(errors="replace").split(" ")
        new = [w for w in words if w not in kept and w not in old and w.isalpha() and (w.isascii() or _LETTERS.fullmatch(w))]
        for word, ids in zip(new, splitter.vocabulary.packed_words([f" {w}".encode() for w in new]), strict=True):
            kept.keep(word, ids)


def packed(ids: list[int]) -> bytes:
    """Identifiers as little-endian unsigned 32-bit integers."""
    return array(_FOUR, ids).tobytes()


def encoder(vocabulary: Vocabulary) -> Splitter:
    """Its text(x) is the identifiers of x, packed."""

    def leaf(pretoken: str) -> bytes:
        return packed(vocabulary.symbols(pretoken.encode()))

    return Splitter(vocabulary, leaf, leaf("\n"), b"".join, lambda name: packed([vocabulary.special[name]]))
