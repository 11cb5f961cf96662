"""The classifier against the same one in plain loops, and texts that are taken in windows."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import textbatch, toxicity
from strandline.llm.toxicity import BITS


def by_hand(text: str | None) -> set:
    code = [int(toxicity._CODE[b]) for b in (text or "").encode()]
    out = set()
    for size in toxicity.SIZES:
        for i in range(len(code) - size + 1):
            h = code[i]
            for c in code[i + 1 : i + size]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            h ^= h >> 29
            out.add((h * (0xBF58476D1CE4E5B9 + 2 * size) % 2**64) >> (64 - BITS))
    return out


def made_up(seed: int) -> tuple[list, list]:
    made = random.Random(seed)
    words = "der the une casa stone river ein la walked bright nasty awful horrid".split()
    data, marks = [], []
    for k in range(160):
        toxic = made.random() < 0.3
        text = " ".join(made.choice(words[:10] + words[10:] * toxic) for _ in range(made.randrange(1, 25)))
        data.append((k, text.upper() if k % 9 == 0 else text, "x"))
        if k % 10:
            marks.append((k, int(toxic) if k % 23 else None, "y"))
    return [*data, (None, "nasty", "x"), (200, None, "x"), (201, "", "x"), data[3], (202, "Ünï你 awful \x00 stone", "x")], [*marks, marks[5]]


def scores_by_hand(data: list, marks: list) -> list:
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2
    rows = [(by_hand(t), y) for k, t, _ in data for m, y, _ in marks if k == m and y is not None and not held(k)]
    n = {y: sum(1 for r in rows if r[1] == y) for y in (0, 1)}
    ratio = {}
    for f in set().union(*(r[0] for r in rows)):
        a, b = (sum(1 for own, y in rows if y == kind and f in own) for kind in (1, 0))
        x = np.log((a + 1) / (n[1] + 2)) - np.log((b + 1) / (n[0] + 2))
        if a + b >= 2 and abs(x) >= 3 * np.sqrt(1 / (a + 1) + 1 / (b + 1)):
            ratio[f] = x
    names = sorted(ratio)
    x = np.array([[ratio[f] * (f in own) for f in names] for own, _ in rows])
    y = np.array([float(r[1]) for r in rows])
    w, b = np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()))
    sw, sb = np.full(len(names), 1e-8), 1e-8
    for _ in range(60):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        gw = x.T @ g + 1e-3 * w
        sw, sb = sw + gw**2, sb + g.sum() ** 2
        w, b = w - 0.1 * gw / np.sqrt(sw), b - 0.1 * g.sum() / np.sqrt(sb)
    assert len(names) > 5
    return [(k, held(k), float(1 / (1 + np.exp(-(b + sum(w[i] * ratio[f] for i, f in enumerate(names) if f in by_hand(t))))))) for k, t, _ in data]


@pytest.mark.parametrize("window", [4 << 20, 37])
def test_scores_are_those_of_plain_loops(spark, monkeypatch, window):
    monkeypatch.setattr(toxicity, "WINDOW", window)
    data, marks = made_up(3)
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int, text string")).collect()), key=str)
    want = sorted(((k, h, s, int(s >= 0.3)) for k, h, s in scores_by_hand(data, marks)), key=str)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def test_a_long_text_takes_bounded_memory():
    made = random.Random(1)
    text = " ".join(f"{made.getrandbits(40):x}" for _ in range(3_000_000))
    tracemalloc.start()
    try:
        t = next(textbatch.texts(pa.array([text])))[1]
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        _, found = toxicity.features(t)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(t.data) > 30_000_000 and len(np.unique(found)) == len(found) > 900_000
    assert peak < 450e6
