"""How the language model's sums are made: kept, as products, or one by one, and always the same."""

import numpy as np
import pytest

from strandline.llm import lm


def _model(own: int, scale: float) -> tuple[lm.LogBilinear, np.ndarray]:
    begin = lm.Factored.classes(own)
    unigram = np.full(own + len(begin) - 1, 1.0)
    model = lm.LogBilinear.new(unigram / unigram.sum(), own + 3)
    model.context *= scale
    model.target *= scale
    return model, begin


def _by_hand(model: lm.LogBilinear, begin: np.ndarray, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    own = begin[-3]
    x = (model.context[0, one] + model.context[1, two]).astype(float) @ model.target.T.astype(float) + model.bias
    cls = np.searchsorted(begin, ids, "right") - 1
    out = x[np.arange(len(ids)), own + cls] - np.logaddexp.reduce(x[:, own:], axis=1)
    for k in range(len(begin) - 3):
        at = np.flatnonzero(cls == k)
        out[at] += x[at, ids[at]] - np.logaddexp.reduce(x[at, begin[k] : begin[k + 1]], axis=1)
    return out / np.log(10)


def test_frequent_contexts_are_summed_once(monkeypatch):
    model, begin = _model(400, 4)
    made = np.random.default_rng(5)
    one, two, ids = made.integers(0, 403, 20000), made.integers(0, 403, 20000), made.integers(0, 40, 20000)  # two classes
    factored, exp, numbers = lm.Factored(model, begin), np.exp, []
    first = factored.scores(one, two, ids)
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: (numbers.append(np.size(x)), exp(x, *a, **b))[1])
    again = factored.scores(two, one, ids)
    monkeypatch.undo()
    assert sum(numbers) <= 22 + 2 * 20  # of biases, none for contexts or tokens
    assert np.allclose(first, _by_hand(model, begin, one, two, ids), atol=1e-4)
    assert np.allclose(again, _by_hand(model, begin, two, one, ids), atol=1e-4)


@pytest.mark.parametrize("scale", [4, 60])  # 60: scores so far apart that products of exponentials vanish
@pytest.mark.parametrize(("near", "common", "held"), [(1024, 4, 1 << 22), (20, 4, 1 << 22), (20, 2, 22 * 100), (20, 10**6, 1 << 22)])
def test_scores_by_any_path_are_those_by_hand(monkeypatch, scale, near, common, held):
    for name, value in (("NEAR", near), ("KEPT", 3), ("MANY", 500), ("COMMON", common), ("HELD", held)):
        monkeypatch.setattr(lm, name, value)
    model, begin = _model(400, scale)
    made = np.random.default_rng(6)
    one, two, ids = (np.minimum(made.geometric(0.01, 12000) - 1, n) for n in (402, 402, 401))
    p = lm.Factored(model, begin).scores(one, two, ids)
    assert np.allclose(p, _by_hand(model, begin, one, two, ids), rtol=1e-5, atol=1e-3)


def test_training_moves_each_place_by_its_rows_sum(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 64)
    unigram = np.array([0.4, 0.3, 0.2, 0.06, 0.04])
    made = np.random.default_rng(7)
    ids = np.stack([made.integers(0, 6, 200), made.integers(0, 6, 200), made.integers(0, 5, 200), made.integers(1, 4, 200)], 1)
    model, plain = lm.LogBilinear.new(unigram), lm.LogBilinear.new(unigram)
    model.train(ids, unigram, np.random.default_rng(8))
    draw, log_kq = np.random.default_rng(8), np.log(unigram * lm.NOISE)
    seen = [np.full_like(x, lm.START) for x in (plain.context[0], plain.context[1], plain.target, plain.bias)]
    weight = len(ids) / ids[:, 3].sum() / 64
    for lo in range(0, len(ids), 64):
        noise = np.searchsorted(np.cumsum(unigram), draw.random(lm.NOISE) * unigram.sum(), "right")
        grads = [np.zeros_like(s) for s in seen]
        for a, b, word, times in ids[lo : lo + 64]:
            v = plain.context[0, a] + plain.context[1, b]
            for w, sign in [(word, 1), *((w, -1) for w in noise)]:
                g = sign * times * weight / (1 + np.exp(sign * (v @ plain.target[w] + plain.bias[w] - log_kq[w])))
                for grad, at, by in zip(grads, (a, b, w, w), (plain.target[w], plain.target[w], v, 1), strict=True):
                    grad[at] += g * by
        for x, s, grad in zip((plain.context[0], plain.context[1], plain.target, plain.bias), seen, grads, strict=True):
            s += grad * grad
            x += lm.RATE * grad / np.sqrt(s)
    for x, y in ((model.context, plain.context), (model.target, plain.target), (model.bias, plain.bias)):
        assert np.allclose(x, y, atol=1e-3)
