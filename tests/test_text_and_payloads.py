"""Folding of every character, files whose order counts, and payloads that aren't arrays."""

import json
import sys
import unicodedata

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.sources import files


def plain(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_every_character_folds_as_its_decomposition(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    # a letter on each side, as names are trimmed; one character a row, and many in one
    rows = spark.createDataFrame([(c, f"a{chr(c)}z") for c in codes], "code int, s string").repartition(8)
    want = spark.createDataFrame([(c, plain(f"a{chr(c)}z")) for c in codes], "code int, want string")
    wrong = rows.select("code", text.folded(F.col("s")).alias("got")).join(want, "code").where("got <> want or got is null")
    assert wrong.take(5) == []
    names = ["Škoda Čapek Łódź ÅÄÖ Ørsted", "ﬁnans ½ ㎯ ⑽ ㏂ ﬃ", "Straße Æther", "東京 Tokyo Ⅷ ™", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.folded(F.col("s"))).collect()]
    assert got == [plain(n or "") for n in names]
    assert [r[0] for r in spark.createDataFrame([("Čedok Šeř ASA (B)",)], "s string").select(text.company_key(F.col("s"))).collect()] == ["cedok ser"]


def test_the_first_row_of_the_files_wins(spark, tmp_path):
    for name, sep, mark, first in (("a", ";", "﻿", 0), ("b", ";", "", 300)):
        lines = [sep.join(("Security_ID ", " ISIN", "Notes"))] + [sep.join((f"S{k % 50}", f"I{k % 50}", f'"note {k}{sep} x"')) for k in range(first, first + 300)]
        (tmp_path / f"{name}.csv").write_text(mark + "\n".join(lines) + "\n", encoding="utf-8")
    assert files.found_separator(spark, str(tmp_path)) == ";"
    df = files.read_csv(spark, str(tmp_path), None, placed=True)
    assert df.columns == ["security_id", "isin", "notes", files.PLACE]
    for parts in (1, 7):
        got = {r.security_id: r.notes for r in files.first_wins(df.repartition(parts, "notes"), ["security_id", "isin"]).collect()}
        assert got == {f"S{k}": f"note {k}; x" for k in range(50)}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.csv").write_text('"a,b,c"\tb\n1\t2\n')
    assert files.read_csv(spark, str(tmp_path / "one"), None).collect() == [("1", "2")]


def test_payloads_and_what_is_turned_away(spark, tmp_path):
    sent = {
        "A.ST": json.dumps([{"date": "2020-01-02", "close": 1.5, "open": "1.25"}, 7, {"date": "2020-01-03", "close": {"x": 1}}, {"date": "2020-01-06", "close": 2}]),
        "B.ST": "[]", "C.ST": '{"error": {"message": "no such symbol"}}', "D.ST": "<html>busy</html>", "E.ST": '{"data": []}', "F.ST": '"text"', "G.ST": '{"message": "limit reached"}', "H é.ST": '[{"date": "2020-01-02", "close": 9}]',
    }
    for name, body in sent.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows, turned = files.read_payloads(spark, str(tmp_path), files.HISTORY)
    assert sorted((r.security_id, r.date, r.close, r.open) for r in rows.collect()) == [("A.ST", "2020-01-02", 1.5, 1.25), ("A.ST", "2020-01-03", None, None), ("A.ST", "2020-01-06", 2.0, None), ("H é.ST", "2020-01-02", 9.0, None)]
    assert sorted(map(tuple, turned.collect())) == [
        ("A.ST", files.NO_OBJECT, "7"), ("C.ST", files.ERROR, "no such symbol"), ("D.ST", files.CORRUPT, "<html>busy</html>"), ("E.ST", files.NO_ARRAY, '{"data": []}'),
        ("F.ST", files.NO_ARRAY, '"text"'), ("G.ST", files.ERROR, "limit reached"),
    ]
    assert [(r.security_id, str(r.date), r.close_raw) for r in files.read_history(spark, str(tmp_path)).orderBy("security_id", "date").collect()] == [("A.ST", "2020-01-02", 1.5), ("A.ST", "2020-01-06", 2.0), ("H é.ST", "2020-01-02", 9.0)]


def test_the_first_row_of_a_roster_wins(spark, tmp_path):
    (tmp_path / "ST.json").write_text(json.dumps([{"Code": f"C{k % 20}", "Name": f"n{k}"} for k in range(400)]))
    for _ in range(2):
        assert {r.code: r.company_name for r in files.read_roster(spark, str(tmp_path)).collect()} == {f"C{k}": f"n{k}" for k in range(20)}
