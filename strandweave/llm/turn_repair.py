"""Conversation structure repair: the cheapest edits that make turns alternate, as a DP over retained turns.

A turn is kept, reroled or deleted, and turns without text may be inserted. Only retained turns are states: between
two of them lie deletions, priced by a prefix sum, and the inserts that their roles call for. So what is to come after
a turn costs the least, over the roles of the next retained one, of the inserts plus a running minimum of own cost,
deletions up to there and what comes after it; the minima are kept for each role while turns are read from the end.
Of equally cheap edits those are taken whose initials are least: a gap's deletions come before its inserts,
so of the cheapest next turns the farthest one, then the one with more inserts, then a kept one.

Turns are sorted over all tasks by conversation and turn and written once. A conversation that lies in one part
is repaired there. One that a cut goes through is repaired by stretches, one for each part it lies in: the costs
between the roles at both ends of each stretch are combined along the conversation, which gives what follows each
stretch; then each is repaired for itself. Only the digest of such a conversation is made in one task, which reads
its turns in order and holds none of them: a digest can't be made in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import settle, small

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What was retained last: nothing yet, system, user, assistant; initials of the last three, and their roles if reroled or inserted.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts between what was retained last and next. Only at the start may a system turn be kept.
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
#: Inserts after the last retained turn.
AFTER = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: The white space of texts.
SPACE = " \t\n\x0b\x0c\r"
#: Characters of a text by which turns of the same number and role are dealt out.
HEAD = 64
LONG = (1 << 63) - 1
#: Stands for the turn of rows that have none, below all others.
NEVER = -(1 << 63)
_FAR = 1 << 60


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the rows after damage; rows that are dropped stay as marks of their conversation."""
    code = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = code == 0
    text = F.when((code == 1) | gone, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(gone, "").when(code == 4, "user").otherwise(role)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), gone.alias("gone"), F.when(code == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def ordered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows with their place ``at``: number of the part in the upper bits, of the row in the part below; by
    conversation (null last) and turn (nulls first), ties by role and text. A conversation lies in neighbouring parts;
    only unlike texts of one turn and role that begin alike are never parted.
    """
    keys = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role")]
    by = [*keys, F.substring("text", 1, HEAD)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return settle(dealt.sortWithinPartitions(*keys, F.col("text")).withColumn("at", F.monotonically_increasing_id()))


def _features(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it doesn't end a sentence."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    return trimmed == "", ~F.substring(trimmed, -1, 1).isin(".", "!", "?")


class Turns:
    """The turns of a stretch of one conversation: what is retained last before and after it decides what it costs.

    ``initial`` is the state a kept turn leads to, or none; ``dead`` says that a turn must go; ``own`` is what a
    turn costs beside its edit if it is retained.
    """

    def __init__(self, initial: list[int | None], dead: list[bool], truncated: list[bool]):
        self.initial, self.dead = initial, dead
        self.own = [TRUNCATED if t else 0 for t in truncated]

    def to_come(self, after: list[int]) -> tuple[list[list[int]], list[list[tuple]]]:
        """Cost of all that follows, and the choice of the next retained turn, by place and state.

        ``after`` is what follows the stretch by the state it ends in. A choice is (place, next state, inserts, edit), or none
        where the rest of the stretch is deleted. Entry n is for what was retained last before turn n.
        """
        n = len(self.initial)
        # The least of own cost, deletions before it from here on, and what is to come, by state and farthest place.
        held: dict[int, tuple[int, int, str]] = {}
        cost, choice = [[0] * 4 for _ in range(n + 1)], [[None] * 4 for _ in range(n + 1)]
        for at in range(n, -1, -1):
            if at < n:
                held = {state: (c + DELETE, j, edit) for state, (c, j, edit) in held.items()}
                if not self.dead[at]:
                    for state in (SYSTEM, USER, ASSISTANT):
                        kept = self.initial[at] == state
                        if not kept and state == SYSTEM:
                            continue
                        c = (0 if kept else REROLE) + self.own[at] + cost[at + 1][state]
                        if state not in held or c < held[state][0]:
                            held[state] = (c, at, "K" if kept else "R")
            for last in range(4):
                best, pick, key = DELETE * (n - at) + after[last], None, None
                for state, (c, j, edit) in held.items():
                    if (last, state) not in BETWEEN:
                        continue
                    inserts = BETWEEN[last, state]
                    total = c + INSERT * inserts
                    if total < best or total == best and pick is not None and (-j, -inserts, edit) < key:
                        best, pick, key = total, (j, state, inserts, edit), (-j, -inserts, edit)
                cost[at][last], choice[at][last] = min(best, _FAR), pick
        return cost, choice

    def walk(self, entry: int, choice: list[list[tuple]]) -> tuple[list[str], int]:
        """The edits of each turn, inserts before it with it, and the state that the stretch ends in."""
        edits, at, last = [], 0, entry
        while (pick := choice[at][last]) is not None:
            j, state, inserts, edit = pick
            edits += ["D"] * (j - at) + ["I" * inserts + edit]
            at, last = j + 1, state
        return edits + ["D"] * (len(self.initial) - at), last

    def between(self) -> list[int]:
        """Costs by state before and state after, row by row; far where there is no way."""
        columns = [self.to_come([0 if end == state else _FAR for end in range(4)])[0][0] for state in range(4)]
        return [columns[end][start] for start in range(4) for end in range(4)]


def lines(roles: list[str], texts: list[str], edits: list[str], last: int) -> Iterator[str]:
    """The repaired turns as ``role:text``; a role that is given or inserted follows from the one before."""
    turn = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    for role, text, edit in zip(roles, texts, edits, strict=True):
        for e in edit:
            if e == "D":
                continue
            last = INITIALS.get(role[:1], START) if e == "K" else turn[last]
            yield f"{role if e == 'K' else ROLES[last]}:{'' if e == 'I' else text}"


def closing(last: int) -> list[str]:
    """The turns to insert at the end."""
    return {0: [], 1: ["assistant:"], 2: ["user:", "assistant:"]}[AFTER[last]]


FINAL = [INSERT * AFTER[s] for s in range(4)]


class Tally:
    """Counts over a stretch, which add up with those of the next one."""

    COLUMNS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, turns, roles, blank, duplicate, truncated):
        known = [t for t in turns if t != NEVER]
        initials = [r[:1] for r in roles]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        ends = (initials[0], initials[-1]) if initials else (None, None)
        low, high = (known[0], known[-1]) if known else (None, None)
        self.values = (len(roles), sum(blank), sum(duplicate), sum(truncated), pairs, len(set(known)), low, high, *ends)

    @staticmethod
    def add(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return b if not a[0] else a
        illegal = a[4] + b[4] + (a[9] + b[8] not in ("su", "ua", "au"))
        turns = a[5] + b[5] - (a[7] is not None and a[7] == b[6])
        low, high = b[6] if a[6] is None else a[6], a[7] if b[7] is None else b[7]
        return (*(x + y for x, y in zip(a[:4], b[:4], strict=True)), illegal, turns, low, high, a[8], b[9])

    @staticmethod
    def shown(v: tuple) -> tuple:
        """gaps, blank, duplicate, truncated and illegal."""
        gaps = 0 if v[6] is None else min(LONG, v[7] - v[6] + 1 - v[5])
        return (gaps, *v[1:5])


def _faults(blank: list[bool], again: list[bool], open_end: list[bool]) -> tuple[list[bool], list[bool], list[bool]]:
    """Only the first fault of a row counts."""
    duplicate = [a and not b for b, a in zip(blank, again, strict=True)]
    return blank, duplicate, [o and not b and not d for o, b, d in zip(open_end, blank, duplicate, strict=True)]


def _seen(roles: list[str], texts: list[str]) -> list[bool]:
    known: set[tuple[str, str]] = set()
    out = []
    for key in zip(roles, texts, strict=True):
        out.append(key in known)
        known.add(key)
    return out


def repair(turns: list[int], roles: list[str], texts: list[str], blank: list[bool], open_end: list[bool]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one whole conversation."""
    faults = _faults(blank, _seen(roles, texts), open_end)
    own = Turns([INITIALS.get(r[:1]) for r in roles], [b or d for b, d in zip(faults[0], faults[1], strict=True)], faults[2])
    cost, choice = own.to_come(FINAL)
    edits, last = own.walk(START, choice)
    made = [*lines(roles, texts, edits, START), *closing(last)]
    return (*Tally.shown(Tally(turns, roles, *faults).values), cost[0][START], "".join(edits) + "I" * AFTER[last], hashlib.sha256("\n".join(made).encode()).hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair the conversations of a part, whose rows come in order; one at a time is held."""

    def result(conv, rows: list[tuple]) -> tuple:
        columns = [list(c) for c in zip(*(r[1:] for r in rows if not r[-1]), strict=True)] or [[]] * 6
        return (conv, *repair(*columns[:5]))

    def batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], _NAMES)

    held, now, made = [], (), []
    for b in small(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != now:
                made.append(result(now, held))
                held = []
            now = row[0]
            held.append(row)
        if len(made) >= 1000:
            yield batch(made)
            made = []
    if held:
        made.append(result(now, held))
    if made:
        yield batch(made)


def _of_part(rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple, Turns]:
    rows = rows.sort_values("at")
    faults = _faults(*(rows[c].tolist() for c in ("blank", "again", "open_end")))
    own = Turns([INITIALS.get(i) for i in rows["initial"]], [b or d for b, d in zip(faults[0], faults[1], strict=True)], faults[2])
    return rows, faults, own


def _measure(rows: pd.DataFrame) -> pd.DataFrame:
    rows, faults, own = _of_part(rows)
    tally = Tally(rows["turn"].tolist(), rows["initial"].tolist(), *faults).values
    return pd.DataFrame([[rows["_conv"].iloc[0], rows["part"].iloc[0], own.between(), *tally]], columns=["_conv", "part", "costs", *Tally.COLUMNS]).astype({"low": "Int64", "high": "Int64"})


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """What follows each stretch of a conversation, by the state it ends in, from the last stretch on."""
    rows = rows.sort_values("part")
    after, out = FINAL, []
    for part, costs in zip(rows["part"].tolist()[::-1], rows["costs"].tolist()[::-1], strict=True):
        out.append((rows["_conv"].iloc[0], part, list(after)))
        after = [min(_FAR, *(int(costs[4 * s + e]) + after[e] for e in range(4))) for s in range(4)]
    return pd.DataFrame(out, columns=["_conv", "part", "after"])


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of a conversation, and the states that its chosen stretches start in."""
    rows = rows.sort_values("part")
    tally = None
    for v in rows[list(Tally.COLUMNS)].itertuples(index=False, name=None):
        v = tuple(None if x is None or x is pd.NA or x != x else x if isinstance(x, str) else int(x) for x in v)
        tally = v if tally is None else Tally.add(tally, v)
    state, entries = START, []
    for ends in rows["ends"]:
        entries.append(state)
        state = int(ends[state])
    first = rows.iloc[0]
    cost = min(int(first["costs"][4 * START + e]) + int(first["after"][e]) for e in range(4))
    return pd.DataFrame([[first["_conv"], *Tally.shown(tally), cost, state, rows["part"].tolist(), entries]], columns=["_conv", *_NAMES[1:7], "state", "parts", "entries"])


def _edits(rows: pd.DataFrame) -> pd.DataFrame:
    """A stretch's edits for each state that it may start in, and the state that each leads to."""
    after = [int(x) for x in rows["after"].iloc[0]]
    rows, _, own = _of_part(rows)
    _, choice = own.to_come(after)
    walks = [own.walk(s, choice) for s in range(4)]
    return pd.DataFrame([[rows["_conv"].iloc[0], rows["part"].iloc[0], rows["at"].tolist(), [w[0] for w in walks], [w[1] for w in walks]]], columns=["_conv", "part", "ats", "edits", "ends"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each turn of a chosen stretch comes to: its edits, and the state before it."""
    turn = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    for b in small(batches, 4):
        for r in b.to_pylist():
            states, state = [], r["entry"]
            for initial, edit in zip(r["initials"], r["edits"], strict=True):
                states.append(state)
                for e in edit:
                    state = state if e == "D" else INITIALS.get(initial, START) if e == "K" else turn[state]
            yield pa.RecordBatch.from_arrays([pa.array(r["ats"], pa.int64()), pa.array(r["edits"], pa.string()), pa.array(states, pa.int32())], ["at", "edit", "state"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose repaired turns come in order; none of them is held."""
    now, hasher, empty = None, None, True
    for b in small(batches):
        for conv, role, text, edit, state, closed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if hasher is None or conv != now:
                now, hasher, empty = conv, hashlib.sha256(), True
            for line in closing(closed) if closed is not None else lines([role], [text], [edit], state):
                hasher.update((line if empty else "\n" + line).encode())
                empty = False
            if closed is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([hasher.hexdigest()])], ["_conv", "repaired_sha256"])


def _split(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie in more than one part; ``_conv`` numbers them."""
    live = rows.where("not gone")
    blank, open_end = _features(F.col("text"))
    seen = live.groupBy("_conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    facts = live.select("_conv", "at", F.shiftright("at", 33).alias("part"), F.coalesce("turn", F.lit(NEVER)).alias("turn"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("open_end"))
    facts = settle(facts.join(seen, "at", "left").withColumn("again", F.coalesce("again", F.lit(True))))
    tallies = ", ".join(f"{c} {'string' if c in ('first', 'last') else 'long'}" for c in Tally.COLUMNS)
    measured = settle(facts.groupBy("_conv", "part").applyInPandas(_measure, f"_conv int, part long, costs array<long>, {tallies}"))
    after = settle(measured.select("_conv", "part", "costs").groupBy("_conv").applyInPandas(_follow, "_conv int, part long, after array<long>"))
    walks = settle(facts.join(after, ["_conv", "part"]).groupBy("_conv", "part").applyInPandas(_edits, "_conv int, part long, ats array<long>, edits array<array<string>>, ends array<int>"))
    chained = measured.join(after, ["_conv", "part"]).join(walks.select("_conv", "part", "ends"), ["_conv", "part"])
    counts = ", ".join(f"{c} long" for c in _NAMES[1:7])
    totals = settle(chained.groupBy("_conv").applyInPandas(_total, f"_conv int, {counts}, state int, parts array<long>, entries array<int>"))
    entries = totals.select("_conv", F.explode(F.arrays_zip("parts", "entries")).alias("e")).select("_conv", F.col("e.parts").alias("part"), F.col("e.entries").alias("entry"))
    chosen = settle(walks.join(entries, ["_conv", "part"]).select("_conv", "part", "entry", "ats", F.element_at("edits", F.col("entry") + 1).alias("edits")))
    ending = F.repeat(F.lit("I"), F.element_at(F.array(*(F.lit(AFTER[s]) for s in range(4))), F.col("state") + 1))
    audits = chosen.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("part", F.array_join("edits", "").alias("text")))).alias("own"))
    audits = audits.select("_conv", F.array_join(F.transform("own", lambda x: x["text"]), "").alias("audit"))
    found = totals.join(audits, "_conv").withColumn("audit", F.concat("audit", ending))

    initials = facts.groupBy("_conv", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "initial"))), lambda x: x["initial"]).alias("initials"))
    applied = chosen.join(initials, ["_conv", "part"]).select("entry", "ats", "edits", "initials").mapInArrow(_apply, "at long, edit string, state int")
    turns = live.join(applied, "at").where("edit <> 'D'").select("_conv", "at", "role", "text", "edit", "state", F.lit(None).cast("int").alias("closed"))
    ends = totals.select("_conv", F.lit(LONG).alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("edit"), F.lit(0).alias("state"), F.col("state").alias("closed"))
    streamed = turns.unionByName(ends).repartition("_conv").sortWithinPartitions("_conv", "at").select("_conv", "role", "text", "edit", "state", "closed")
    return found.join(streamed.mapInArrow(_digest, "_conv long, repaired_sha256 string"), "_conv")


def repaired(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation, after damage.

    Nulls: a null role or text is one space, as is a null conv_id or turn where damage is drawn; rows without
    conv_id are one conversation; those without turn come first and count in no gap. Rows of an equal turn come by role,
    then text. Repeated rows are damaged alike, the later ones being duplicates. An empty table gives no row, a
    conversation without rows after damage zeros, an empty audit and the digest of nothing. ``parts`` sets
    how many parts the rows are sorted into.
    """
    rows = ordered(damaged(conversations), parts)
    # A part's first conversation is the only one that it can share with the part before: fewer rows than parts.
    spread = rows.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.lit(1).alias("_")).groupBy("conv_id").count().where("count > 1")
    cut = settle(spread.select("conv_id").coalesce(1).withColumn("_conv", F.monotonically_increasing_id().cast("int")), 1)
    blank, open_end = _features(F.col("text"))
    columns = ["conv_id", F.coalesce("turn", F.lit(NEVER)).alias("turn"), "role", "text", blank.alias("blank"), open_end.alias("open_end"), "gone"]
    if not cut.count():
        return rows.select(*columns).mapInArrow(_whole, RESULT)
    own = cut.withColumnRenamed("conv_id", "_id")
    same = rows["conv_id"].eqNullSafe(own["_id"])
    inside = rows.join(F.broadcast(own), same, "left_anti").select(*columns).mapInArrow(_whole, RESULT)
    across = rows.join(F.broadcast(own), same, "inner")
    done = _split(across)
    none = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _NAMES[1:7]}
    shown = own.join(done, "_conv", "left").select(F.col("_id").alias("conv_id"), *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return inside.unionByName(shown)


#: Edits turn by turn, the best of each state kept; an insert stands before a retained turn or at the end, as elsewhere it gains nothing.
ORACLE = r"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as tab),
k as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, 1 + len(key)), lambda i: ascii(key[i])::ubigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) % 20 as code
  from k, crc),
d as (
  select conv_id, turn, case code when 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, range(case code when 3 then 2 else 1 end) r where code <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, E' \t\n\x0b\x0c\r') as t from d),
f as (
  select *, case when t = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when t[-1] not in ('.', '!', '?') then 't' else '' end as fault,
    role[1] as s, lag(role[1]) over (partition by conv_id order by i) as before from o),
own as materialized (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and before || s not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from f group by conv_id),
turns as materialized (select * from f),
go(last, next, inserts) as (values ('', 's', 0), ('', 'u', 0), ('', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'u', 1), ('u', 'a', 0), ('a', 'u', 0), ('a', 'a', 1)),
walk as (
  select conv_id, 0::bigint as i, '' as last, 0::bigint as cost, '' as audit, []::varchar[] as made from own
  union all
  select conv_id, i, last, best.cost, best.audit, best.made from (
    select conv_id, i, last, min(struct_pack(cost := cost, audit := audit, made := made)) as best from (
      select w.conv_id, f.i, w.last, w.cost + 4 as cost, w.audit || 'D' as audit, w.made from walk w join turns f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1
      union all
      select w.conv_id, f.i, g.next, w.cost + 3 * g.inserts + case when e = 'R' then 3 else 0 end + case when fault = 't' then 3 else 0 end, w.audit || repeat('I', g.inserts) || e,
        list_concat(w.made, case g.inserts when 0 then [] else [case g.next when 'a' then 'user:' else 'assistant:' end] end, [case when e = 'K' then role when g.next = 'u' then 'user' else 'assistant' end || ':' || text])
      from walk w join turns f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1 and fault not in ('b', 'd')
        join go g on w.last = g.last join (values ('K'), ('R')) x(e) on case e when 'K' then g.next = f.s else g.next <> 's' end) group by conv_id, i, last)),
fin as (
  select w.conv_id, min(struct_pack(cost := cost + 3 * z.n, audit := audit || repeat('I', z.n), made := list_concat(made, z.rest))) as best
  from walk w join own on w.conv_id is not distinct from own.conv_id and w.i = own.n
    join (values ('', 0, []::varchar[]), ('s', 2, ['user:', 'assistant:']), ('u', 1, ['assistant:']), ('a', 0, []::varchar[])) z(last, n, rest) on w.last = z.last group by w.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join own on c.conv_id is not distinct from own.conv_id left join fin on c.conv_id is not distinct from fin.conv_id
"""
