"""Small tests of what a review of the corpus operators found missing."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import contamination, language, lm, near, pii, quality, textbatch, toxicity, urls
from strandline.llm.queries import PIECES


def test_vocabulary_grows_with_the_counted_tokens(spark, monkeypatch):
    made = random.Random(5)
    order = [k for _ in range(600) for k in made.sample(range(100), 60)]
    data = [(d, " ".join(f"alpha{k} beta{k}" for k in order[60 * d : 60 * d + 60])) for d in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm, "VOCABULARY", 8)  # all 200 words are counted often enough for vectors of their own
    held = [r for r in lm.language_model_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_factored_model_is_normalised():
    begin = lm.Factored.classes(20)
    assert begin[-3] == 20 and np.diff(begin)[-2:].tolist() == [1, 1]
    unigram = np.full(20 + len(begin) - 1, 1.0)
    model = lm.LogBilinear.new(unigram / unigram.sum(), 23)
    model.context *= 20
    model.target *= 20
    each = np.arange(22)
    for one, two in ((0, 3), (22, 22), (21, 20)):
        p = 10 ** lm.Factored(model, begin).scores(np.full(22, one), np.full(22, two), each)
        assert np.isclose(p.sum(), 1, atol=1e-5) and p.std() > 0.01


def test_stages_judge_rows_by_their_own_text(spark, tmp_path):
    import corpus_pipeline

    made = random.Random(8)
    a, b, item = (" ".join(f"w{made.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (None, item), (7, item), (7, b + " end"), (None, None)], "doc_id long, text string")
    near = corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 7"), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in near) == sorted([(2, a), (5, b)])
    near = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(None, a), (None, a), (3, b), (None, b), (None, None), (None, ""), (9, item), (9, item), (9, item + " more")], docs.schema), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near if r.doc_id != 9) == sorted([(0, a), (3, b), (0, ""), (0, "")])
    assert len([r for r in near if r.doc_id == 9]) == 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if r.text != item)


def test_quality_rejects_what_base_rules_pass(spark):
    made = random.Random(31)
    prose = lambda k: " ".join(f"{made.choice(['river', 'stone', 'garden', 'letter', 'window', 'train'])}{made.randrange(900)}" for _ in range(k)) + "."
    menu = "\n".join(f"{made.choice(['Shop', 'Blog', 'Team', 'Help'])} {made.randrange(900)}" for _ in range(150))
    shared = "All the words of this page are part of the weekly letter of our town."
    data = [(0, "\n".join(prose(30) for _ in range(5))), (1, menu), (2, "\n".join(f"Home | About{k} | Contact{k}" for k in range(60)))]
    data += [(10 + k, f"{prose(9)}\n{shared}\n" * 2 + "\n".join(prose(12) for _ in range(8))) for k in range(30)]
    data += [(50, "\n".join(["Alle Rechte vorbehalten. Datenschutzerklärung", "Tous droits réservés", *[prose(40)] * 1, prose(30)]))]
    data += [(60 + k, data[0][1]) for k in range(40)]  # copies don't make a line common
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(docs, keep_text=True).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [k for k in sorted(got) if not got[k].kept] == [1, 2]
    assert all(shared not in got[10 + k].cleaned_text and got[10 + k].n_lines_removed == 2 for k in range(30))
    assert got[50].n_lines_removed == 2 and got[0].n_lines_removed == got[60].n_lines_removed == 0
    assert quality.line_fails("Home About Contact Login Register") == "navigation"
    assert quality.line_fails("He told me to click here and there, and " + "then " * 30 + "we went on home.") is None


def _thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_cancel_in_polynomials_differ(spark):
    one, two = _thue_morse(2048, "a", "b"), _thue_morse(2048, "b", "a")
    rest = [" ".join(f"w{10 * d + k}" for k in range(10)) for d in range(4)]
    rows = [(0, f"a b c d e {one}"), (1, f"a b c d e {two}"), (2, f"{one} x y {one} x y " + rest[1]), (3, f"{one} x y {two} x y " + rest[1]), (4, one), (5, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert found[4] == 4 and found[5] == 5 and found[0] != found[1]
    hits = contamination.contaminated(docs, spark.createDataFrame([(0, one), (1, two)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == [(4, 0), (5, 1)]
    counts = {r.doc_id: r.n_repeat_words for r in quality.quality(docs).collect()}
    assert counts[2] == 6 and counts[3] == 0
    known = {r.doc_id: r.n_known for r in lm.language_model_scores(docs.where("doc_id < 2").union(spark.createDataFrame([(16, one)], docs.schema)), folds=1, held=1).collect()}
    assert known == {0: 7, 1: 7, 16: 2}
    assert textbatch.words(next(textbatch.texts(pa.array([f"{one} {two}"])))[1]).hashes.tolist()[0] != textbatch.words(next(textbatch.texts(pa.array([two])))[1]).hashes.tolist()[0]


def test_urls_beyond_the_literal_lengths_and_hot_urls(spark, monkeypatch):
    rules = spark.createDataFrame([(f"h{k}.org", "/" + "a" * k, "block") for k in range(12)], "host string, path string, verdict string")
    data = [(k, f"http://x.h{k % 14}.org/{'a' * (k % 17)}") for k in range(300)] + [(k, "http://h5.org/aaaaaaa") for k in range(300, 700)] + [(k, None) for k in range(700, 1000)]
    pages = spark.createDataFrame(data, "page_id long, url string").repartition(5)
    want = sorted(map(tuple, urls.filter_urls(pages, rules).collect()), key=str)
    assert sum(r[3] is not None for r in want) > 400
    monkeypatch.setattr(urls, "MOST_LENGTHS", 3)
    monkeypatch.setattr(urls, "HOT", 10)
    assert sorted(map(tuple, urls.filter_urls(pages, rules).collect()), key=str) == want
    twice = rules.union(rules)
    assert sorted(map(tuple, urls.filter_urls(pages, twice).collect()), key=str) == want


def test_labels_beyond_the_broadcast_give_the_same_scores(spark, monkeypatch):
    made = random.Random(3)
    data = [(k, " ".join(made.choice("one two three four five six".split()) for _ in range(20)) + (" vileword" if k % 5 == 0 else "")) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "en", 0.5) for k, t in data] + [(0, data[0][1], "de", 0.1)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(200)] + [(3, 0, 1)], "doc_id long, toxic int, text int")
    one = sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect())
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    two = sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect())
    assert len(one) == 201 and all(a == c and abs(b - d) < 1e-9 for (a, b), (c, d) in zip(one, two, strict=True))


def test_long_words_and_many_languages(spark):
    pieces = language.Pieces([b"_a", b"ab", b"b", b"bc", b"_ab", b"abc", b"bcabcabcabcabc"])
    p = np.random.default_rng(2).random((len(pieces.pieces), 2))
    p /= p.sum(0)
    at = {x: i for i, x in enumerate(pieces.pieces)}

    def brute(word: bytes, k: int) -> float:
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for n in pieces.lengths:
                if n <= end and word[end - n : end] in at:
                    ways[end] += ways[end - n] * p[at[word[end - n : end]], k]
        return math.log(ways[-1])

    words = [b"_abc", b"_" + b"abc" * 12, b"_" + b"bca" * 19 + b"b"]
    rows = np.array([list(w.ljust(60, b"b")) for w in words], np.uint8)
    got = language.forward(pieces, p, rows, np.array([len(w) for w in words]))
    assert np.allclose(got, [[brute(w, k) for k in (0, 1)] for w in words])
    logs = language.forward(pieces, p, np.full((1, 5000), ord("b"), np.uint8))
    assert np.all(np.isfinite(logs)) and np.all(logs < -1000)
    # no refusal, and ties go to the first by name
    data = [(k, "same words for all", f"l{k:03d}") for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = language.identify_languages(docs, PIECES).collect()
    assert len(found) == 600 and len({r.lang_pred for r in found}) == 1


def test_personal_data_of_held_out_forms(spark):
    texts = [(k, f"word mail{k}.x@host{k % 7}.example.com then +1 ({200 + k}) 555-{1000 + k} and 10.0.{k}.7 in 20{k % 90 + 10} v{k}.0 {k} items " + "filler text here " * 300) for k in range(100)]
    model = pii.train(spark.createDataFrame(texts, "doc_id long, text string"))
    found = [pii.find(model, f"please call ({300 + k}) 555-{2000 + k} today, {k} of 20 done in 2019, room {k}, page {k} of 30")[1] for k in range(60)]
    assert sum([x[0] for x in spans] == ["phone"] for spans in found) >= 54
    assert not any(pii.find(model, f"in {1900 + k} there were {k} of {k + 20} items, version {k}.2 and 3,{k:03d} more")[1] for k in range(60))


def test_language_stage_rejects_what_was_not_learned(spark, tmp_path):
    """Beside several learned languages: text of another, code and random letters go, also long ones; learned ones stay, with numbers too."""
    import corpus_pipeline

    own = {
        "de": "der die das und nicht ist ein eine mit auf für schön straße haus gehen wir sie über heute morgen zwischen immer wieder".split(),
        "en": "the of and to in river stone walked under bright morning letters quiet garden seven old train window through their".split(),
        "es": "el la los que por con para una casa camino noche siempre ciudad hombre mujer entre tiempo puede donde mucho".split(),
    }
    other = "przez jest nie tylko miasto dzień wszystko kiedy może bardzo człowiek życie jednak zawsze którzy gdzie został".split()
    made = random.Random(4)
    say = lambda words, n: " ".join(made.choice(words) for _ in range(n)) + "."
    letters = lambda: "".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(made.randrange(3, 9)))
    data = [(k, say(own[lang], 60), lang) for k, lang in enumerate(list(own) * 60)]
    good = [(200, say(own["de"], 8), None), (201, say(own["en"], 3000), None), (202, "token 4111111111111111 " + say(own["es"], 40) + " +1 (706) 555-3138 2abc3ff2ca8fb1e4", None), (None, say(own["en"], 20), None)]
    bad = [(300, say(other, 40), None), (301, say(other, 3000), None), (302, " ".join(letters() for _ in range(60)), None), (303, "x" * 30000, None), (304, None, "de"), (305, "12 34", "de")]
    bad += [(306, "\n".join(f"memcpy(buf->ptr[i], &tmp_q, sizeof(*ptr)); if (!ptr || !buf->fn) goto err_{k};" for k in range(20)), None)]
    docs = spark.createDataFrame(data + good + bad + good[:1], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert got == {(k, lang) for k, _, lang in data} | {(200, "de"), (201, "en"), (202, "es"), (None, "en")}
    rows = corpus_pipeline.language_id(spark, docs.where("doc_id < 100"), str(tmp_path)).count()
    assert rows == 100 and corpus_pipeline.language_id(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == 0
