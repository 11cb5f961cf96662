"""Words that are merged side by side, against merges one by one and the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from strandline.llm import bpe, textbatch, tokens

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def words(n: int) -> list[str]:
    made = random.Random(9)
    parts = ["re", "on", "the", "ble", "é", "è", "ß", "th", "in", "你", "Ω", "a", "Q", "zz"]
    return ["".join(made.choice(parts) for _ in range(made.randrange(1, 9))) for _ in range(n)]


def test_words_side_by_side_are_merged_as_one_by_one():
    vocabulary = bpe.Vocabulary(open(BPE).read())
    some = [w.encode() for w in [*words(9000), "a", "é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]]
    got = vocabulary.packed_words(some)
    for word, ids in zip(some, got, strict=True):
        want = [i for i in vocabulary.merge(word)[0] if i >= 0]
        assert vocabulary.symbols(word) == want and np.frombuffer(ids, "<u4").tolist() == want


def test_few_words_of_a_text_are_merged_alone(monkeypatch):
    alone = []
    for name in ("merge", "symbols"):
        one = getattr(bpe.Vocabulary, name, None)
        monkeypatch.setattr(bpe.Vocabulary, name, lambda self, word, one=one: alone.append(word) or one(self, word), raising=False)
    made = random.Random(4)
    some = list(dict.fromkeys(words(30000)))
    texts = [" ".join(made.choice(some) + made.choice(["", "", ",", ".", "'s", "\n", "  ", "ª", "́"]) for _ in range(4000)) for _ in range(5)]
    encoder, library = tokens.ChunkEncoder(bpe.Vocabulary(open(BPE).read())), Tokenizer.from_file(BPE)
    got = [ids for _, t in textbatch.texts(pa.array(texts)) for ids in encoder.ids(t)]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(alone) < 0.4 * len({w for text in texts for w in text.split()})
