"""Personal data: base patterns, and further spans by a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbatch
from strandline.llm.learning import mapped, sample, whole_texts

KINDS = ("email", "ip", "card", "phone")
#: Texts, and stretches of them that may hold personal data, at most, that the model is trained on; rounds of training, learning rate, and L2 decay.
FIT_ROWS, FIT_STRETCHES, EPOCHS, RATE, DECAY = 2400, 6000, 6, 0.3, 1e-4
#: Tokens in a segment at most, and tokens kept around one that may be personal data.
LONGEST, AROUND = 6, 2
#: An added segment must be so much likelier than tokens of no kind.
MARGIN = 3.0
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CUE = re.compile(rb"[@0-9]")
#: Words before a span that tell its kind.
_BEFORE = {
    "email": "email", "e-mail": "email", "mail": "email", "contact": "email",
    "ip": "ip", "address": "ip", "host": "ip", "server": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card",
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the four base patterns, leftmost and non-overlapping per kind, that pass their checks."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and (text[lo - 1] in "._%+-" or (text[lo - 1].isascii() and text[lo - 1].isalnum())):
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _features(kind: str, text: str, lo: int, hi: int, before: str) -> list[str]:
    """Of a whole candidate segment: its shape, sizes, checks and the word before."""
    s = text[lo:hi]
    d = _digits(s)
    parts = re.split(r"[.\-\x20()]+", s)
    shape = re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", s)))[:24]
    letters = sum(c.isalpha() for c in s)
    found = [
        "any", f"digits{min(len(d), 20)}", f"letters{min(letters, 3)}", f"at{min(s.count('@'), 2)}",
        f"dots{min(s.count('.'), 4)}", f"plus{int(s[0] == '+')}", f"blanks{min(s.count(' '), 5)}", f"dashes{min(s.count('-'), 4)}",
        f"paren{int('(' in s)}", f"shape:{shape}", f"before:{_BEFORE.get(before.lower().strip(':.,'), '-')}",
        f"luhn{int(12 <= len(d) <= 19 and luhn(d))}",
        f"octets{int(len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts))}",
    ]
    return [f"{kind}|{f}" for f in found]


@dataclass
class Lattice:
    """A stretch of tokens and the segments that may cover it: (from, to, kind or "", feature names, span)."""

    n: int
    edges: list[tuple[int, int, str, list[str], int, int]] = field(default_factory=list)


def _trim(text: str, lo: int, hi: int) -> tuple[int, int]:
    while hi > lo and text[hi - 1] in ".,;:!?\"')]>»”":
        if text[hi - 1] == ")" and "(" in text[lo:hi]:
            break
        hi -= 1
    while lo < hi and text[lo] in "\"'[<«“":
        lo += 1
    return lo, hi


def _candidates(text: str, lo: int, hi: int, tokens: int) -> Iterator[str]:
    """The kinds that a segment may be of."""
    s = text[lo:hi]
    d = len(_digits(s))
    if s.isascii():
        if ("@" in s and tokens == 1) or (3 <= tokens <= LONGEST and re.search(r"\S *(?:\(at\)|\[at\]| at | AT ) *\S.*(?:\.|\bdot\b|\(dot\)|\[dot\])", s)):
            yield "email"
        if d >= 4 and re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?::[0-9]{1,5})?", s):
            yield "ip"
        if 12 <= d <= 19 and re.fullmatch(r"[0-9][0-9 .-]*[0-9]", s) and luhn(_digits(s)):
            yield "card"
        if 7 <= d <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s) and tokens <= LONGEST:
            yield "phone"


_STRETCH = re.compile(r"[@0-9]|(?<=\w)[ (\[](?:at|AT)[ )\]](?=\S+[ (\[.]*(?:dot|DOT|\.)\b)")


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Where the tokens are of each stretch around a digit or at-sign."""
    marks = [m.start() for m in _STRETCH.finditer(text)]
    if not marks:
        return
    spans = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in spans])
    hot = sorted({int(i) for i in np.searchsorted(starts, marks, "right") - 1} - {-1})
    k = 0
    while k < len(hot):
        first = max(0, hot[k] - AROUND)
        last = hot[k]
        while k + 1 < len(hot) and hot[k + 1] <= last + 2 * AROUND:
            k += 1
            last = hot[k]
        k += 1
        yield spans[first : min(len(spans), last + AROUND + 1)]


def lattices(text: str) -> Iterator[Lattice]:
    """Each stretch's tokens with their candidate segments."""
    for own in stretches(text):
        lattice = Lattice(len(own))
        for i, (lo, _) in enumerate(own):
            before = text[slice(*own[i - 1])] if i else ""
            lattice.edges.append((i, i + 1, "", [], *own[i]))
            for j in range(i, min(len(own), i + LONGEST)):
                if j > i and "\n" in text[own[j - 1][1] : own[j][0]]:
                    break
                a, b = _trim(text, lo, own[j][1])
                if a < b:
                    lattice.edges += [(i, j + 1, kind, _features(kind, text, a, b, before), a, b) for kind in _candidates(text, a, b, j - i + 1)]
        if len(lattice.edges) > len(own):
            yield lattice


def _sums(lattice: Lattice, scores: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-sums; a segment is at most LONGEST tokens, so time is linear in the stretch."""
    forward, backward = np.full(lattice.n + 1, -np.inf), np.full(lattice.n + 1, -np.inf)
    forward[0] = backward[lattice.n] = 0
    order = sorted(range(len(scores)), key=lambda e: lattice.edges[e][0])
    for e in order:
        i, j = lattice.edges[e][:2]
        forward[j] = np.logaddexp(forward[j], forward[i] + scores[e])
    for e in reversed(order):
        i, j = lattice.edges[e][:2]
        backward[i] = np.logaddexp(backward[i], backward[j] + scores[e])
    return forward, backward


class Model:
    """Weights of whole-segment features. A segment of no kind scores 0 for each token."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def train(self, examples: list[tuple[Lattice, set[Span]]]) -> None:
        """Ascent of the conditional likelihood: features of the right segments less the expected ones."""
        seen: dict[str, float] = {}
        for _ in range(EPOCHS):
            for lattice, right in examples:
                scores = [self.score(names) for *_, names, _, _ in lattice.edges]
                forward, backward = _sums(lattice, scores)
                gradient: dict[str, float] = {}
                for e, (i, j, kind, names, a, b) in enumerate(lattice.edges):
                    if kind:
                        g = float((kind, a, b) in right) - np.exp(forward[i] + scores[e] + backward[j] - forward[-1])
                        for n in names:
                            gradient[n] = gradient.get(n, 0.0) + g
                for n, g in gradient.items():
                    g -= DECAY * self.weights.get(n, 0.0)
                    seen[n] = seen.get(n, 1e-2) + g * g
                    self.weights[n] = self.weights.get(n, 0.0) + RATE * g / seen[n] ** 0.5

    def decode(self, lattice: Lattice) -> list[Span]:
        """Boundaries and kinds of the best segmentation, jointly, by dynamic programming."""
        best, back = np.full(lattice.n + 1, -np.inf), [None] * (lattice.n + 1)
        best[0] = 0
        for edge in sorted(lattice.edges, key=lambda e: e[0]):
            i, j, kind, names, *_ = edge
            s = best[i] + (self.score(names) - MARGIN if kind else 0.0)
            if s > best[j]:
                best[j], back[j] = s, edge
        out, j = [], lattice.n
        while j:
            i, _, kind, _, a, b = back[j]
            if kind:
                out.append((kind, a, b))
            j = i
        return out[::-1]


def _variants(text: str, spans: list[Span]) -> Iterator[tuple[str, set[Span]]]:
    """The text, and it with its spans written in other usual ways, so that whole-span features carry over."""
    yield text, set(spans)
    changes = {
        "phone": lambda s: re.sub(r"^\+[0-9]{1,2}[ .-]?", "", s),
        "email": lambda s: s.replace("@", " at ").replace(".", " dot "),
        "ip": lambda s: s.replace(".", "[.]"),
        "card": lambda s: ".".join(re.findall(r".{1,4}", _digits(s))),
    }
    out, right, last = [], set(), 0
    for kind, a, b in spans:
        if a < last:
            return
        out.append(text[last:a])
        lo = sum(map(len, out))
        out.append(changes[kind](text[a:b]))
        right.add((kind, lo, lo + len(out[-1])))
        last = b
    yield "".join([*out, text[last:]]), right


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stretch of whole texts, and of these with their spans rewritten, with the right spans in it."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            for fresh, right in _variants(text, base_spans(text)) if text else ():
                for own in stretches(fresh):
                    lo, hi = own[0][0], own[-1][1]
                    out.append((fresh[lo:hi], joined([(k, a - lo, b - lo) for k, a, b in sorted(right) if lo <= a and b <= hi])))
        yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["stretch", "right"])


def train(texts: DataFrame) -> Model:
    """Trained on stretches of ``FIT_ROWS`` whole texts (doc_id, text), chosen by a hash, with the base spans in them taken as right.

    The stretches are cut out on the executors; ``FIT_STRETCHES`` different ones reach the driver.
    """
    some = sample(texts, FIT_ROWS, 4).repartition("doc_id").mapInArrow(_examples, "stretch string, right string").distinct()
    examples = []
    for row in some.orderBy(F.xxhash64("stretch", "right"), "stretch").limit(FIT_STRETCHES).collect():
        right = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row.right.split(",") if x)}
        examples += [(lattice, right) for lattice in lattices(row.stretch)]
    model = Model()
    model.train(examples)
    return model


def find(model: Model, text: str) -> tuple[list[Span], list[Span]]:
    """Base spans; and all spans: these and the model's that overlap none of them."""
    base = base_spans(text)
    more = []
    for lattice in lattices(text):
        for kind, a, b in model.decode(lattice):
            if not any(a < hi and lo < b for _, lo, hi in base):
                more.append((kind, a, b))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_MAY = re.compile(rb"[@0-9]|[ (\[](?:at|AT)[ )\]]\S+[ (\[]*(?:dot|DOT|\.)")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep_row: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and, if ``redact``, redacted_text of each row.

    Base spans are pattern matches that pass their checks; n_* count them. ``spans`` has all spans as kind:start:end in code
    points, those of a semi-Markov conditional random field added where no base span is: it chooses boundaries and kinds of segments
    of up to ``LONGEST`` tokens jointly; n_spans counts all. It is trained on the driver on stretches of ``FIT_ROWS`` texts. In
    redacted_text every span is ``[KIND]``.

    A null or empty text has no spans; what any of several overlapping spans covers is redacted. A null id stays null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not looked at; with
    ``keep_row`` the rows come whole, and what is found is a struct, the last column.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(whole_texts(docs, id_col, text_col)))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo, t in textbatch.texts(batch.column("text")):
                n = {k: [0] * len(t) for k in KINDS}
                digests, spans, many, texts = [nothing] * len(t), [""] * len(t), [0] * len(t), []
                for i in range(len(t)):
                    raw = t.raw(i)
                    base = every = ()
                    if _MAY.search(raw):
                        base, every = find(model, raw.decode())
                        for kind, _, _ in base:
                            n[kind][i] += 1
                        digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                        spans[i], many[i] = joined(every), len(every)
                    if redact:
                        texts.append(redacted(raw.decode(), every) if every else raw.decode())
                columns = [batch.column("doc_id").slice(lo, len(t)), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(spans), pa.array(many, pa.int64())]
                names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"]
                yield pa.record_batch(columns + [pa.array(texts, pa.string())] * redact, names + ["redacted_text"] * redact)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return mapped(docs, id_col, text_col, run, schema + ", redacted_text string" * redact, keep_row)


def redacted(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for kind, a, b in spans:
        if b > last:
            out += [text[last : max(a, last)], f"[{kind.upper()}]" if a >= last else ""]
            last = b
    return "".join([*out, text[last:]])
