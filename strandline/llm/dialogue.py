"""Conversations made to alternate, at the least cost, by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.storage import saved

#: What costs: another role, a row less, a row more, a row that stays truncated.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a conversation that one search looks at; a longer one is searched in parts, and the parts are joined.
SEGMENT = 1 << 14
#: States: nothing yet, a system turn, a user's turn, an assistant's turn. A conversation may end in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where a row with a role's initial leads if it is kept, and where a row of the wanted role leads.
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60
_WHITE = " \t\n\x0b\x0c\r"
#: A row as one character: its initial (s, u, a or another) and its first fault (none, truncated, blank, duplicate).
INITIALS, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")
CODES = "".join(chr(ord("A") + k) for k in range(len(INITIALS) * len(FAULTS)))
ROW = {c: (INITIALS[k // len(FAULTS)], FAULTS[k % len(FAULTS)]) for k, c in enumerate(CODES)}


def lower_bounds(codes: str, ends: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each place and state the least that the rest can cost, up to one of the states ``ends``."""

    def inserted(b: list[int]) -> tuple[int, int, int, int]:
        user, assistant = min(b[USER], INSERT + b[ASSISTANT]), min(b[ASSISTANT], INSERT + b[USER])
        return min(b[NOTHING], INSERT + user), min(b[SYSTEM], INSERT + user), user, assistant

    out = [inserted([0 if s in ends else _FAR for s in range(4)])]
    for c in reversed(codes):
        initial, fault = ROW[c]
        after, more = out[-1], TRUNCATED * (fault == "truncated")
        here = [DELETE + x for x in after]
        if fault not in ("blank", "duplicate"):
            for s in range(4):
                here[s] = min(here[s], REROLE + more + after[WANTED[s]])
                if (s, initial) in KEEP:
                    here[s] = min(here[s], more + after[KEEP[s, initial]])
        out.append(inserted(here))
    return out[::-1]


def cheapest(codes: str, start: int = NOTHING, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost of leading ``codes`` from ``start`` to one of ``ends``, and of the edits that have it the ASCII-least initials; None if none can.

    Depth-first with an explicit stack, edits in ASCII order, so of two ways to a node the earlier has the lesser initials.
    A node (place, state) is left if its cost and the lower bound of the rest aren't below the incumbent's cost, or if it was
    reached before at no higher cost (its dominance table). The first incumbent costs one more than the bound of the root; bounds
    come from a pass over the suffixes, so few nodes are entered that don't lead to the best, and when the stack is empty it is proved.
    """
    bounds = lower_bounds(codes, ends)
    if bounds[0][start] >= _FAR:
        return None
    incumbent, audit = bounds[0][start] + 1, None
    least: dict[tuple[int, int], int] = {}
    way: list[str] = []
    stack = [(0, "", 0, start, 0)]  # edits before, edit, place, state, cost
    while stack:
        depth, edit, place, state, cost = stack.pop()
        if cost + bounds[place][state] >= incumbent or cost >= least.get((place, state), _FAR):
            continue
        least[place, state] = cost
        del way[max(depth - 1, 0) :]
        if edit:
            way.append(edit)
        if place == len(codes) and state in ends:
            incumbent, audit = cost, "".join(way)
        nexts = [("I", place, WANTED[state], cost + INSERT)]
        if place < len(codes):
            initial, fault = ROW[codes[place]]
            more = cost + TRUNCATED * (fault == "truncated")
            nexts = [("D", place + 1, state, cost + DELETE), *nexts]
            if fault not in ("blank", "duplicate"):
                if (state, initial) in KEEP:
                    nexts.append(("K", place + 1, KEEP[state, initial], more))
                nexts.append(("R", place + 1, WANTED[state], more + REROLE))
        stack += [(depth + 1, *n) for n in reversed(nexts)]
    return None if audit is None else (incumbent, audit)


_FOUND = "first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<struct<begin: int, end: int, cost: long, audit: string>>"


def searched(codes: str, parts: int) -> dict:
    """What a segment of one of ``parts`` has, and its cheapest ways; that of a whole conversation is asked only for the way from the beginning to an end."""
    asked = [(NOTHING, ASSISTANT, ENDS)] if parts == 1 else [(a, b, (b,)) for a in range(4) for b in range(4)]
    found = [(a, b, cheapest(codes, a, ends)) for a, b, ends in asked]
    initials = "".join(ROW[c][0] for c in codes)
    return {
        "first": initials[0], "last": initials[-1], **{f: sum(ROW[c][1] == f for c in codes) for f in FAULTS[1:]},
        "illegal": sum(initials[k : k + 2] not in LEGAL for k in range(len(codes) - 1)),
        "ways": [{"begin": a, "end": b, "cost": f[0], "audit": f[1]} for a, b, f in found if f],
    }


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    way = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    names = [x.split()[0] for x in _FOUND.split(", ")[:6]] + ["ways"]
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            made = [searched(*x) for x in zip(part.column("codes").to_pylist(), part.column("parts").to_pylist(), strict=True)]
            kept = [c for c in part.schema.names if c not in ("codes", "parts")]
            kinds = {"first": pa.string(), "last": pa.string(), "ways": way}
            yield pa.record_batch([*[part.column(c) for c in kept], *[pa.array([m[n] for m in made], kinds.get(n, pa.int64())) for n in names]], [*kept, *names])


def joined(parts: list[dict]) -> dict:
    """A conversation's figures from those of its segments, in order; of ways that meet, the least (cost, audit) for each state stays."""
    best = {NOTHING: (0, "")}
    illegal, turns, first, last, before = 0, 0, None, None, None
    counts = dict.fromkeys(FAULTS[1:], 0)
    for p in parts:
        to: dict[int, tuple[int, str]] = {}
        for w in p["ways"]:
            if w["begin"] in best:
                cost, audit = best[w["begin"]]
                made = cost + w["cost"], audit + w["audit"]
                to[w["end"]] = min(to.get(w["end"], made), made)
        best = to
        illegal += p["illegal"] + (before is not None and before + p["first"] not in LEGAL)
        before = p["last"]
        for f in counts:
            counts[f] += p[f]
        if p["turns"]:
            turns += p["turns"] - (p["first_turn"] == last)
            first, last = p["first_turn"] if first is None else first, p["last_turn"]
    cost, audit = min(best[s] for s in ENDS if s in best)
    gaps = last - first + 1 - turns if turns else 0
    return {"gaps": gaps, **{k: counts[k] for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            made = [joined(x) for x in part.column("parts").to_pylist()]
            columns = [pa.array([m[n] for m in made], pa.string() if n == "audit" else pa.int64()) for n in names]
            yield pa.record_batch([part.column("conv_id"), *columns], ["conv_id", *names])


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(convs: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )


def plans(convs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation in ``convs`` (conv_id, turn, role, text).

    gaps are turns missing between the least and the greatest. A row's first fault counts: it is blank, or its role and text were
    there before in the conversation, or its text doesn't end in ``.``, ``!`` or ``?``. illegal counts neighbours whose roles' initials aren't su, ua or
    au. ``audit`` has the initials of the cheapest edits, the ASCII-least of several: Keep, Rerole (to user or assistant), Delete
    (what is blank or duplicate must go), Insert (an empty turn of user or assistant), so that the roles read ``(s?(ua)+)?``.

    No text is shuffled here, only its digest. Rows are sorted over the whole cluster by (conversation, turn, role, digest), so one
    conversation of any size lies in many partitions; duplicates come from an aggregation; each ``SEGMENT`` rows are searched alone,
    from each state to each, and only the ways of the segments (at most 16 bytes for a row) are joined for a conversation.

    A null role or text is one space. Null turns come first; rows of one turn are taken by role, then digest of the text. A null conv_id is
    a conversation of its own. An empty role has no initial that is legal. An empty table gives an empty one; other columns are not looked at.
    """
    rows = _rows(convs)
    ended = F.rtrim(F.col("text"), F.lit(_WHITE))
    shape = rows.select(
        "conv_id", "turn", "role", _text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("salt"),
        F.when(ended == "", 2).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), 1).otherwise(0).alias("fault"),
    )
    order = ["conv_id", "turn", "role", "key", "salt"]
    ordered = saved(shape.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()), "ordered")
    firsts = ordered.groupBy("conv_id", "role", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = ordered.drop("key").join(firsts, "place", "left")
    fault = F.when(F.col("fault") == 2, 2).when(F.col("first").isNull(), 3).otherwise(F.col("fault"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    coded = marked.select("conv_id", F.shiftright("place", SEGMENT.bit_length() - 1).alias("segment"), F.struct("place", "turn", F.char((initial * len(FAULTS) + fault + ord("A")).cast("long")).alias("code")).alias("one"))
    segments = coded.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("one")).alias("ones"))
    turns = F.array_distinct(F.filter("ones.turn", lambda t: t.isNotNull()))
    segments = segments.select("conv_id", "segment", F.concat_ws("", "ones.code").alias("codes"), turns.alias("t")).select(
        "conv_id", "segment", "codes", F.size("t").cast("long").alias("turns"), F.try_element_at("t", F.lit(1)).alias("first_turn"), F.try_element_at("t", F.lit(-1)).alias("last_turn")
    )
    every = segments.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id")))
    solved = every.mapInArrow(_solved, "conv_id long, segment long, turns long, first_turn long, last_turn long, " + _FOUND)
    own = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*solved.columns[1:])), _by_segment).alias("parts"))
    return saved(own.mapInArrow(_joined, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "plans")


def _by_segment(a: Column, b: Column) -> Column:
    return F.when(a["segment"] < b["segment"], -1).when(a["segment"] > b["segment"], 1).otherwise(0)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each conversation's plan first: what the plan makes of them."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    conv, audit, at, place, state, out = None, "", 0, 0, NOTHING, []

    def inserted() -> None:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = WANTED[state]
            out.append((conv, place, None, ROLES[state], "", "I"))
            at, place = at + 1, place + 1

    def emitted() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for conv_id, plan, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text")), strict=True):
            inserted()
            if plan is not None:
                if at != len(audit):
                    raise ValueError(f"conversation {conv} has fewer rows than its plan")
                conv, audit, at, place, state = conv_id, plan, 0, 0, NOTHING
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                state = KEEP[state, role[0]] if edit == "K" else WANTED[state]
                out.append((conv, place, turn, role if edit == "K" else ROLES[state], text, edit))
                place += 1
        yield emitted()
    inserted()
    yield emitted()


def repaired(convs: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place from 0, turn, role, text, edit) that ``planned`` (of ``plans``) makes of ``convs``.

    Texts are shuffled once, by conversation, and stream by in order, so a task holds a batch of rows whatever a conversation's length; one
    conversation is one task's, as its turns come out in order and together. Inserted turns have a null turn.
    """
    rows = _rows(convs).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _text_key(F.col("text")).alias("key"), "text", F.lit(None).cast("string").alias("audit"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"))]
    heads = planned.select("conv_id", F.lit(0).alias("kind"), *none, "audit")
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").mapInArrow(_applied, "conv_id long, place long, turn long, role string, text string, edit string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running = None, None
    for batch in batches:
        ids, out = [], []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if running:
                    ids.append(conv)
                    out.append(running.hexdigest())
                conv, running = conv_id, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
    if running:
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the ``role:text`` lines of each conversation, straight from ``repaired`` (whose turns come in order and together)."""
    return turns.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def repair_report(convs: DataFrame, ids: DataFrame) -> DataFrame:
    """What ``plans`` says of each conv_id in ``ids`` (once each), and repaired_sha256; zeros and digests of nothing for one without rows."""
    planned = plans(convs)
    found = digests(repaired(convs, planned)).withColumnRenamed("conv_id", "of")
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    named = planned.withColumnRenamed("conv_id", "own")
    figures = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        every.join(named, F.col("conv_id").eqNullSafe(F.col("own")), "left")
        .join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
        .select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    )


def damaged(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turn, role, text; nulls as one space) with faults put in by crc32(``conv_id:turn``) modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes the role user.
    """
    space = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), space) for c in ("conv_id", "turn")])), F.lit(20))
    rows = _rows(convs).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n", "kind")
