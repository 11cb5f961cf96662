"""Quality rules, line by line first, then by document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.learning import whole_texts
from strandline.llm.storage import saved

#: Phrases of boilerplate lines in English, German, French and Spanish, and what a sentence ends with.
BOILERPLATE = re.compile(
    r"licen[sc]ed under|all rights reserved|copyright|terms of (?:use|service)|privacy policy|cookie policy"
    r"|accept (?:all )?cookies|subscribe to our|sign up for|click here|enable javascript|lorem ipsum"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl\u00e4rung|impressum|newsletter abonnieren|cookies akzeptieren|hier klicken"
    r"|tous droits r\u00e9serv\u00e9s|conditions d['\u2019]utilisation|politique de confidentialit\u00e9|mentions l\u00e9gales|accepter les cookies|cliquez ici"
    r"|todos los derechos reservados|t\u00e9rminos de (?:uso|servicio)|pol\u00edtica de (?:privacidad|cookies)|aviso legal|aceptar (?:las )?cookies|haga clic aqu\u00ed",
    re.I,
)
_ENDS = ".!?:;\"'\u201d\u2019\u00bb\u2026)]\u3002\uff01\uff1f"
_SEPARATED = re.compile(r"\s[|>\u00bb\u2022\u00b7/]\s")
_MARKED = re.compile(r"\S(?:!!|[#*$%&|<>]{2,})(?=\s|$)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A line of more words than this isn't boilerplate, whatever phrase it has and however often it occurs.
BOILERPLATE_WORDS = 30
#: A line is boilerplate if it stands between so many different pairs of lines, and in one of so many of all different places of lines
#: (so there can't be more than that many such lines).
LEAST_PLACES, OF_ALL = 10, 100_000
#: A line fails with so many navigation separators, at least one for so many of its words; or if it has so many words, all with capitals, and no end.
SEPARATORS, WORDS_A_SEPARATOR, TITLE_WORDS = 2, 4, (4, 12)
#: Lines of so few words without a sentence's end are navigation if so many follow each other.
SHORT_WORDS, RUN = 6, 3
#: A line of at least so many words fails if it doesn't end as a sentence does and has no sentence end inside.
UNENDED_WORDS = 20
#: A line fails if this share of its words ends in repeated marks.
MARKED_SHARE = 0.3
#: A document fails if less than this share of its word characters stays.
KEPT_SHARE = 0.5


def _ended(line: str) -> bool:
    return line.rstrip()[-1:] in _ENDS


def line_fails(line: str, common: bool = False) -> str | None:
    """The rule that removes a line with a word: boilerplate, navigation or punctuation; else None. ``common``: it stands in very many places."""
    words = _WORD.findall(line)
    n = len(words)
    if n <= BOILERPLATE_WORDS and (common or BOILERPLATE.search(line)):
        return "boilerplate"
    bars = len(_SEPARATED.findall(line)) if any(c in line for c in "|>\u2022\u00b7\u00bb/") else 0
    if bars >= SEPARATORS and bars * WORDS_A_SEPARATOR >= n - bars:
        return "navigation"
    marked = len(_MARKED.findall(line)) if re.search(r"!!|[#*$%&|<>]{2}", line) else 0
    if marked >= MARKED_SHARE * n:
        return "punctuation"
    if not _ended(line):
        if TITLE_WORDS[0] <= n <= TITLE_WORDS[1] and all(w[0].isupper() or w[0].isdigit() for w in words):
            return "navigation"
        if n >= UNENDED_WORDS and not re.search(r"[.!?]\s", line):
            return "punctuation"
    return None


def _solid(text: str) -> int:
    """Code points that are not ASCII white space."""
    return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))


def failing(lines: list[str], common: list[bool] | None = None) -> list[str | None]:
    """Why each line with a word is removed, or None: its own rule, or a run of short lines that don't end."""
    found = [line_fails(line, bool(common and common[k])) for k, line in enumerate(lines)]
    short = [why is not None and why != "punctuation" or not _ended(line) and len(_WORD.findall(line)) <= SHORT_WORDS for line, why in zip(lines, found, strict=True)]
    k = 0
    while k < len(lines):
        end = k
        while end < len(lines) and short[end]:
            end += 1
        if end - k >= RUN:
            found[k:end] = [why or "navigation" for why in found[k:end]]
        k = end + 1
    return found


def cleaned(text: str, common: list[bool] | None = None) -> tuple[str, int, int, int]:
    """The text without failing lines, word characters of all and of the lines kept, lines removed. ``common`` is of the lines with a word."""
    lines = text.split("\n")
    chars = [_solid(line) for line in lines]
    full = [k for k, n in enumerate(chars) if n]
    gone = {k for k, why in zip(full, failing([lines[k] for k in full], common), strict=True) if why}
    stays = [k for k in range(len(lines)) if k not in gone]
    return "\n".join(lines[k] for k in stays), sum(chars), sum(chars[k] for k in stays), len(gone)


def line_hashes(t: textbatch.Texts) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line with a word, from its first word to its last (A-Z lower-cased), and where each text's lines begin."""
    w = textbatch.words(t, lower=False)
    text = np.repeat(np.arange(len(t)), np.diff(w.first))
    line = np.searchsorted(np.flatnonzero(t.data == 10), w.starts)
    begins = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1]))) if len(line) else np.zeros(0, np.int64)
    last = np.append(begins[1:], len(line)) - 1 if len(begins) else begins
    return textbatch.spans_hash(t.data, w.starts[begins], w.ends[last]), np.searchsorted(text[begins], np.arange(len(t) + 1))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different pairs of a line, and the lines before and after it as one hash."""
    for batch in batches:
        for _, t in textbatch.texts(batch.column("text")):
            h, first = line_hashes(t)
            before, after = np.zeros_like(h), np.zeros_like(h)
            before[1:], after[:-1] = h[:-1], h[1:]
            begins, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0]
            before[begins] = after[ends - 1] = 0
            pairs = np.unique(np.stack([h, textbatch.mixed(before) + after * np.uint64(3)], 1), axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["line", "place"])


def common_lines(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the lines of (text) that stand between many different pairs of lines: copies of a document count once. ``OF_ALL`` at most."""
    places = texts.select("text").mapInArrow(_places, "line long, place long").distinct().groupBy("line").agg(F.count("*").alias("n"))
    # a line in fewer places than LEAST_PLACES only counts for the total
    table = saved(places.groupBy(F.when(F.col("n") >= LEAST_PLACES, F.col("line")).alias("line")).agg(F.sum("n").alias("n")), "places")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = table.where("line is not null").where(F.col("n") * OF_ALL >= total)
    return np.sort(often.select("line").toArrow().column("line").to_numpy())


def repeated_words(w: textbatch.Words) -> np.ndarray:
    """For each text, how many words stand in a run of three that the text has twice or more."""
    n = len(w.hashes)
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    if n < 3:
        return np.zeros(len(count), np.int64)
    place = textbatch._PLACE
    key = textbatch.mixed(w.hashes[:-2] * place[0] + w.hashes[1:-1] * place[1] + w.hashes[2:] * place[2] + text[:-2].astype(np.uint64) * place[3])
    at = np.flatnonzero(text[:-2] == text[2:])
    ordered = np.sort(key[at])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(count), np.int64)
    near = np.minimum(np.searchsorted(twice, key[at]), len(twice) - 1)
    hit = at[twice[near] == key[at]]
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(text[covered], minlength=len(count))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed,
    kept_chars and, if ``keep_text``, cleaned_text of each row.

    Every line with a word is judged first (``line_fails``, ``failing``): known phrases of boilerplate, and lines that stand in very many
    different places of all documents (``common_lines``); menus; lines that aren't sentences. Failing lines are removed. A document is kept if at least
    ``KEPT_SHARE`` of its word characters stays and it passes the base rules: 50 words or more, and
    at most half of them in repeated runs of three. One pass counts lines (their hashes alone are shuffled), one judges.

    A null text counts as empty: no words, base_failed, not kept. A null id stays null; repeated rows give repeated
    rows; an empty table gives an empty one; other columns are not looked at.
    """
    rows = whole_texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(common_lines(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text")):
                w = textbatch.words(t, lower=False)
                words, repeats = np.diff(w.first), repeated_words(w)
                h, first = line_hashes(t)
                at = np.minimum(np.searchsorted(often, h.view(np.int64)), max(len(often) - 1, 0))
                common = (often[at] == h.view(np.int64)).tolist() if len(often) else [False] * len(h)
                rows = []
                for i in range(len(t)):
                    text = t.raw(i).decode()
                    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
                    fresh, chars, stay, removed = cleaned(text, common[first[i] : first[i + 1]])
                    failed = bool(words[i] < 50 or 100 * repeats[i] > 50 * words[i])
                    rows.append((chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), failed, not failed and stay >= KEPT_SHARE * chars, removed, stay, fresh))
                chars, symbols, dups, failed, kept, removed, stay, fresh = zip(*rows, strict=True)
                columns = [batch.column("doc_id").slice(lo, len(t)), pa.array(words, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed), pa.array(kept), pa.array(removed, pa.int64()), pa.array(stay, pa.int64())]
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "kept_chars"]
                yield pa.record_batch(columns + [pa.array(fresh)] * keep_text, names + ["cleaned_text"] * keep_text)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, kept_chars long"
    return rows.mapInArrow(run, schema + ", cleaned_text string" * keep_text)
