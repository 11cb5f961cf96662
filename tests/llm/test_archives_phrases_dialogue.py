"""WARC archives, phrases and repaired conversations against brute force, other readers, and odd rows; repeated rows of near duplicates."""

import base64
import collections
import glob
import gzip
import hashlib
import random
import re
import zlib

import pytest

from strandline.llm import dialogue, near, phrases, warc
from strandline.llm.queries import op13_dialogue

PAGES = [
    (1, "http://a b/\r\nX: 1", "same"), (5, None, "same"), (5, "u", "same"), (None, "v", "same"), (7, "w", None), (8, "x", ""), (7, "x", ""),
    (9, "y", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n üé 你\x1f\x08"), (None, "z", "lonely"), (3, "long", "<p>" * 3_000_000), (2, "long", "<p>" * 3_000_000),
]


def pages(spark, rows):
    wide = [(*r, "x", "y") for r in rows]
    return spark.createDataFrame(wide, "page_id long, url string, html string, payload string, key string").repartition(3)


def brute_archives(rows, least=0):
    groups = collections.defaultdict(list)
    for k, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is not None, page, k))
    out = []
    for html, own in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        for n, (_, page, _) in enumerate(own):
            again = len(raw) >= least and n < len(own) - 1
            out.append((page, len(raw), digest, "revisit" if again else "response", own[-1][1] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_match_brute_force(spark, least):
    got = warc.deduplicated_archives(pages(spark, PAGES), least_bytes=least).collect()
    assert sorted(map(tuple, got), key=str) == brute_archives(PAGES, least)
    assert warc.deduplicated_archives(pages(spark, PAGES).where("false")).count() == 0


def test_archives_are_what_other_readers_expect(spark, tmp_path):
    folder = warc.write_archives(pages(spark, PAGES), str(tmp_path / "out"), date="2020-01-02T03:04:05Z")
    records = []
    for name in glob.glob(f"{folder}/part-*"):
        with gzip.open(name) as f:
            records += warc.parsed(f.read())
    kinds = collections.Counter(f["warc-type"] for f, _ in records)
    assert kinds["response"] == 5 and kinds["revisit"] == 6 and kinds["warcinfo"] >= 1
    ids = {f["warc-record-id"]: f for f, _ in records}
    assert len(ids) == len(records)
    for f, block in records:
        if f["warc-type"] == "revisit":
            first = ids[f["warc-refers-to"]]
            assert first["warc-type"] == "response" and first["warc-payload-digest"] == f["warc-payload-digest"] and block.endswith(b"\r\n\r\n")
            assert f["warc-profile"].endswith("identical-payload-digest") and f["warc-date"] == "2020-01-02T03:04:05Z"
    assert "http://a%20b/%0D%0AX:%201" in {f.get("warc-target-uri") for f, _ in records}
    one, two = (sorted(map(str, warc.read_archives(spark, folder, whole_files=w).collect())) for w in (False, True))
    assert one == two and len(one) == len(PAGES)
    texts = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert texts[9] == PAGES[7][2] and texts[3] == PAGES[9][2]


def test_archives_of_others_and_broken_ones(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    made = [
        warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", 4), ("Content-Type", "application/http")], body),
        warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<b>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", 5)], b""),
        warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<c>"), ("WARC-Refers-To", "<nowhere>"), ("X-Page-ID", 6)], b""),
    ]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "plain" / "b.warc").write_bytes(gzip.compress(made[2].replace(b"ID: 6", b"ID: 7")))
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "plain"), whole_files=True)).collect()}
    assert got == {4: ("response", 5, None), 5: ("revisit", 5, 4), 6: ("revisit", None, None), 7: ("revisit", None, None)}
    with pytest.raises(ValueError, match="cut"):
        list(warc.parsed(made[0][:-6]))
    with pytest.raises(ValueError, match="differs"):
        warc._row(*next(warc.parsed(made[0].replace(b"hello", b"hallo"))), True)


def brute_phrases(rows, support, first=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        inside = {q[i:j] for q, a in held.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * a >= 100 * held[q[i:j]]}
        own = []
        for p, a in held.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                own.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, r + 1, p, a, left, right, n[lang], s) for r, (s, a, p, left, right) in enumerate(own[:first])]
    return sorted(out)


def spoken(seed: int) -> list[tuple]:
    made = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "Zürich", "a" * 40, "\x1c"]
    rows = []
    for _ in range(400):
        some = vocabulary[: made.choice([3, 8, 16])]
        rows.append((made.choice(["en", "fr", None, "und"]), " ".join(made.choice(some) + made.choice([""] * 6 + [".", ", ", "\n", "\t"]) for _ in range(made.randrange(60)))))
    rows += [("en", None), (None, ""), ("en", "x y z . x y z"), ("de", "one two three four five six seven"), ("de", "over and over and over and over")] * 3
    return [*rows, ("en", " ".join(made.choice(vocabulary) for _ in range(3000)))]


@pytest.mark.parametrize(("window", "bucket", "held", "coded"), [(4 << 20, 1 << 20, 1 << 21, 1 << 20), (64, 50, 97, 9), (300, 7, 500, 30), (4 << 20, 300, 1 << 20, 1)])
def test_phrases_match_brute_force_however_they_are_parted(spark, monkeypatch, window, bucket, held, coded):
    for name, value in (("WINDOW", window), ("BUCKET", bucket), ("HELD", held), ("CODED", coded), ("MOST_BITS", 1 << 17)):
        monkeypatch.setattr(phrases, name, value)
    rows = spoken(5)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, text string, gram string, n long, word string").repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, support=6).collect()))
    assert len(got) > 300 and got == brute_phrases(rows, 6)
    few = sorted(map(tuple, phrases.collocations(docs, support=6, first=5).collect()))
    assert few == brute_phrases(rows, 6, 5)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_edges_come_out_of_a_block_as_they_went_in():
    made = random.Random(1)
    import numpy as np

    dictionary = np.array(sorted(made.randrange(2**64) for _ in range(300)), np.uint64)
    grams = np.array([[made.randrange(301) for _ in range(5)] for _ in range(1000)], np.int64)
    counts = np.array([made.choice([1, 2, 70000]) for _ in range(1000)], np.int64)
    for n in (0, 1000):
        size, block = phrases.packed(dictionary, grams[:n], counts[:n])
        d, g, c = phrases.unpacked(block, size)
        assert (d == dictionary).all() and (g == grams[:n]).all() and (c == counts[:n]).all()
    for low in (0, 1 << 22):  # two numbers for a row, or numbers too large for that
        some = np.array([[made.randrange(3) + low for _ in range(5)] for _ in range(2000)], np.int32)
        got = dict(zip(map(tuple, (sums := phrases.added(some, np.ones(2000, np.int64)))[0].tolist()), sums[1].tolist(), strict=True))
        assert got == collections.Counter(map(tuple, some.tolist())) and list(got) == sorted(got)


def exhaustive(codes):
    """Least (cost, audit) by trying all edits, two insertions in a row at most."""
    best = None

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and state in dialogue.ENDS:
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            go(i, dialogue.WANTED[state], cost + 2, audit + "I", inserted + 1)
        if i < len(codes):
            initial, fault = dialogue.ROW[codes[i]]
            more = fault == "truncated"
            go(i + 1, state, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                if (state, initial) in dialogue.KEEP:
                    go(i + 1, dialogue.KEEP[state, initial], cost + more, audit + "K", 0)
                go(i + 1, dialogue.WANTED[state], cost + more + 2, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def test_search_matches_exhaustion_and_segments_make_no_difference():
    made = random.Random(1)
    for _ in range(300):
        codes = "".join(made.choice(dialogue.CODES) for _ in range(made.randrange(6)))
        assert dialogue.cheapest(codes) == exhaustive(codes)
    for _ in range(200):
        codes, n = "".join(made.choice(dialogue.CODES) for _ in range(made.randrange(1, 40))), made.randrange(1, 9)
        parts = [codes[i : i + n] for i in range(0, len(codes), n)]
        got = dialogue.joined([dialogue.searched(p, len(parts)) | {"turns": 0, "first_turn": None, "last_turn": None} for p in parts])
        assert (got["cost"], got["audit"]) == dialogue.cheapest(codes)
        whole = dialogue.searched(codes, 1)
        assert all(got[f] == whole[f] for f in ("blank", "duplicate", "truncated", "illegal"))


def brute_report(rows):
    """op13 row by row; ties of a turn by role, then SHA-256 of the text."""
    hurt, out = collections.defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(kind, text)
        hurt[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in hurt.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        codes, seen, counts = "", set(), collections.Counter()
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            codes += next(c for c, v in dialogue.ROW.items() if v == (role[:1] if role[:1] and role[0] in "sua" else "?", fault))
        cost, audit = exhaustive(codes)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(own[k][1][:1] + own[k + 1][1][:1] not in ("su", "ua", "au") for k in range(len(own) - 1))
        lines, state, left = [], 0, list(own)
        for edit in audit:
            row = left.pop(0) if edit != "I" else (None, "", "")
            if edit != "D":
                state = dialogue.KEEP[state, row[1][0]] if edit == "K" else dialogue.WANTED[state]
                lines.append(f"{row[1] if edit == 'K' else dialogue.ROLES[state]}:{row[2]}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed: int) -> list[tuple]:
    made = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "Good. ", "été\x0b", "x" * 50 + "."]
    rows = []
    for conv in [*range(60), None]:
        n = made.randrange(1, 8)
        rows += [(conv, made.choice([k, k, k, None, 2**40]), made.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "ux"]), made.choice(texts)) for k in range(n)]
    rows += [(70, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(40)]
    drops = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, (drops, 0, "user", "Gone."), rows[3], rows[3]]


@pytest.mark.parametrize("segment", [1 << 14, 4])
def test_repair_matches_brute_force(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    rows = [r for r in talks(3) if r[0] != 70] if segment > 4 else talks(4)
    if segment == 4:
        monkeypatch.setitem(globals(), "exhaustive", dialogue.cheapest)  # held against exhaustion above
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, place long").repartition(3)
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in op13_dialogue(spark, str(tmp_path)).collect()}
    want = brute_report(rows)
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {conv: want.get(conv, nothing) for conv in {r[0] for r in rows}}


def test_repaired_turns_alternate(spark):
    rows = [r for r in talks(9) if r[0] is not None]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = collections.defaultdict(list)
    for r in dialogue.repaired(convs, dialogue.plans(convs)).collect():
        turns[r.conv_id].append((r.place, r.role, r.text, r.edit))
    for own in turns.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[1][0] for x in own))
        assert all(text == "" for _, _, text, edit in own if edit == "I")
    assert dialogue.plans(convs.where("false")).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    """Rows that repeat an id and text come out as often as they went in, be they linked by a band, a hub, or alone."""
    made = random.Random(7)
    base = [f"w{made.randrange(500)}" for _ in range(120)]

    def changed(*at):
        return " ".join(f"new{k}" if k in at else w for k, w in enumerate(base))

    plain = [(1, changed()), (2, changed(60)), (3, changed(60, 61)), (4, changed(3)), (5, " ".join(f"z{k}" for k in range(80))), (6, "two words"), (7, None), (8, changed())]
    times = {1: 3, 2: 2, 3: 4, 4: 1, 5: 3, 6: 2, 7: 2, 8: 2}
    rows = [r for r in plain for _ in range(times[r[0]])]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter(r.doc_id for r in got) == times
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 1), (5, 5), (6, 6), (7, 7)}


def test_near_duplicates_recall(spark):
    """Every link that comparing all pairs finds is found; 400 documents, some of them copied and changed at random, whole rows repeated."""
    made = random.Random(11)
    rows = []
    for k in range(100):
        base = [f"w{made.randrange(300)}" for _ in range(made.choice([8, 30, 120]))]
        for j in range(4):
            own = list(base)
            for _ in range(made.choice([0, 1, 2, 3])):
                own[made.randrange(len(own))] = f"n{made.randrange(10**6)}"
            rows.append((4 * k + j, " ".join(own)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.split()) for k, t in rows)}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    links = 0
    for a in sets:
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((root(a), root(b)))
                top[y] = x
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows + rows[::7], "doc_id long, text string")).collect()}
    assert links > 100 and got == {k: root(k) for k in sets}
