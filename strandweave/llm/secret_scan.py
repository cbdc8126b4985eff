"""Secret scan with multipart credential linking.

Three base kinds are found by pattern alone: assignments, access identifiers and long hex runs. Weak
candidates (user or key names, 40-character keys, endpoints) say little by themselves; they are reported
only where complementary parts stand together: in one scope (a stretch of text between blank lines), at
most ``REACH`` code points apart. An identifier needs a secret, a secret an identifier or an endpoint, and an
endpoint a secret. The parts are joined as intervals by two sweeps over their places in each scope. A scope lies within
one text, so the join needs no shuffle: a text is read, matched and joined where it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import small

#: Kinds in the order in which ties of place are listed.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = KINDS[:3]
#: What each kind is a part of: i identifier, s secret, e endpoint.
ROLES = {"assign": "s", "access": "i", "hex": "s", "ident": "i", "key": "s", "endpoint": "e"}
REACH = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters: a shorter run holds no match that is long enough
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENT = re.compile(r"""(?:user(?:name)?|login|account|client_id|key_id)["']?\x20?[:=]\x20?["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[^A-Z]{0,39}[A-Z])(?=[^a-z]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
_ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|arn:aws:[^\s\"'<>]+)")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_RARE = re.compile(r"[:=]|[A-Za-z0-9+/]{40}")
_LOGIN = re.compile(r"://([^/?#@\s]+)@")

#: Which roles complement a role.
_NEEDS = {"i": "s", "s": "ie", "e": "s"}


def find_parts(text: str) -> list[tuple[int, int, int, int]]:
    """(start, rank of the kind, end, scope) of all base matches and weak candidates, by place."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if _RARE.search(text):
        found += [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _KEY.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text or "arn:aws:" in text else []
    if not found:
        return []
    found.sort()
    breaks, out, scope = iter([m.start() for m in _BLANK.finditer(text)] + [len(text) + 1]), [], 0
    at = next(breaks)
    for start, rank, stop in found:
        while start > at:
            scope, at = scope + 1, next(breaks)
        out.append((start, rank, stop, scope))
    return out


def linked(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the base parts and of the weak ones with a complementary part in reach, by place.

    One sweep forward keeps the furthest end of each role, one backward the nearest start.
    """
    out = []
    for _, scope in groupby(parts, key=lambda p: p[3]):
        rows = list(scope)
        roles, near = [ROLES[KINDS[p[1]]] for p in rows], [p[1] < 3 for p in rows]
        ends: dict[str, int] = {}
        for n, (p, role) in enumerate(zip(rows, roles, strict=True)):
            near[n] |= any(p[0] - ends[r] <= REACH for r in _NEEDS[role] if r in ends)
            ends[role] = max(ends.get(role, 0), p[2])
        starts: dict[str, int] = {}
        for n in range(len(rows) - 1, -1, -1):
            near[n] |= any(starts[r] - rows[n][2] <= REACH for r in _NEEDS[roles[n]] if r in starts)
            starts[roles[n]] = rows[n][0]
        out += [p[:3] for p, ok in zip(rows, near, strict=True) if ok]
    return out


def spans_text(parts: list[tuple]) -> str:
    return ",".join(f"{KINDS[p[1]]}:{p[0]}:{p[2]}" for p in parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())]))
    for b in small(batches):
        rows = [linked(find_parts(t or "")) for t in b.column(1).to_pylist()]
        base = [[p for p in r if p[1] < 3] for r in rows]
        counts = [pa.array([sum(p[1] == k for p in r) for r in base], pa.int64()) for k in range(3)]
        digests = pa.array([hashlib.sha256(spans_text(r).encode()).hexdigest() for r in base], pa.string())
        found = pa.array([[{"start": s, "rank": k, "stop": e} for s, k, e in r] for r in rows], kind)
        spans = pa.array(list(map(spans_text, rows)), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, found, spans], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document row: doc_id, counts and digest of the base spans, ``found`` and ``spans``.

    ``found`` lists (start, rank, stop) of base spans and of weak candidates that are linked; ``spans`` is its
    text. A null text counts as empty and has no span; repeated rows are scanned each by itself; an empty
    table gives no row; the time a text takes is linear in its length.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,rank:int,stop:long>>, spans string")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with each reported span replaced by ``mark``; of an endpoint, only its user and password.

    All rows and columns stay as they are but for ``text`` and, where there is one, ``n_chars``, which follows the text.
    Texts without a span are left alone, null ones too; repeated rows are masked each by itself; an empty table stays
    empty. A row is masked where it is read, so the result doesn't depend on how the rows are dealt out.
    """
    columns, new = docs.columns, "__sw_text"
    old = F.col("text").cast("string")
    out = docs.withColumn(new, _redactor(mark)(old))
    changed = F.col(new).isNotNull()
    values = {"text": F.coalesce(new, old).alias("text")}
    if "n_chars" in columns:
        values["n_chars"] = F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[values.get(c, F.col(f"`{c}`")) for c in columns])


def redacted(text: str, mark: str) -> str | None:
    """The text with its reported parts masked, or None where there are none."""
    spans = []
    for start, rank, stop in linked(find_parts(text)):
        login = _LOGIN.search(text, start, stop) if KINDS[rank] == "endpoint" else None
        spans += [(start, stop)] if KINDS[rank] != "endpoint" else [login.span(1)] if login else []
    return masked_text(text, *zip(*sorted(spans), strict=True), mark) if spans else None


def _redactor(mark: str):
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, mark) for t in texts], dtype=object)

    return masked


def masked_text(text: str, starts: list[int], stops: list[int], mark: str) -> str:
    """The text with the union of the spans, given by place, replaced: one mark for spans that overlap."""
    out, at = [], 0
    for start, stop in zip(starts, stops, strict=True):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _sql_kinds() -> str:
    """All candidates of each kind with what must be long enough of them, as DuckDB finds them."""
    value = r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    name = r"""["'']?\x20?[:=]\x20?["'']?[A-Za-z0-9@._-]{3,}"""
    mixed = r"regexp_matches({0}, '[0-9]') and regexp_matches({0}, '[A-Z]') and regexp_matches({0}, '[a-z]')"
    kinds = (
        (f"({_either_case('password|passwd|secret|token|api_?key')}){value}", 2, "length({0}) >= 8"),
        ("AKIA[A-Z0-9]+", 0, "length({0}) >= 16"),
        ("[0-9a-f]+", 0, "length({0}) >= 32"),
        (f"(?:{_either_case('user')}(?:{_either_case('name')})?|{_either_case('login|account|client_id|key_id')}){name}", 0, "true"),
        ("[A-Za-z0-9+/]+", 0, f"length({{0}}) = 40 and {mixed}"),
        (r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"''<>]+|arn:aws:[^\s\"''<>]+)", 0, "true"),
    )
    rows = []
    for rank, (pattern, group, test) in enumerate(kinds):
        values = f"regexp_extract_all(t, '{pattern}', {group})"
        rows.append(
            f"select r, {rank} as rank, '{ROLES[KINDS[rank]]}' as part, regexp_extract_all(t, '{pattern}') as hit, string_split_regex(t, '{pattern}') as gap, "
            f"list_filter(range(1, len(hit) + 1), lambda i: {test.format('vals[i]')}) as good from (select *, {values} as vals from d)"
        )
    return " union all ".join(rows)


#: Places follow from the texts between the matches; each part is compared with every other in its scope.
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as ({_sql_kinds()}),
i as (select r, rank, part, hit, gap, unnest(good) as i from m),
s as (
  select r, rank, part, length(hit[i]) as n,
    (coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0))::bigint as start from i),
p as (select s.*, start + n as stop, len(regexp_extract_all(left(t, start), '
[ 	
]*
')) as scope from s join d using (r)),
l as (
  select distinct a.r, a.rank, a.start from p a join p b on a.r = b.r and a.scope = b.scope and (a.part = 's') <> (b.part = 's')
  where case when (b.start, b.rank) < (a.start, a.rank) then a.start - b.stop else b.start - a.stop end <= {REACH}),
k as (select p.*, [{", ".join(f"'{x}'" for x in KINDS)}][rank + 1] || ':' || start || ':' || stop as span from p left join l using (r, rank, start) where rank < 3 or l.r is not null)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (rank < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, rank), '') as spans
from d left join k using (r) group by d.r, d.doc_id
"""
