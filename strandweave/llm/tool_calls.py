"""Chat formatting: tool calls linked to their results, in dependency order, as canonical JSON.

An assistant's text may be a JSON object with ``tool_calls`` (id, name, arguments, depends_on) and ``content``; a
tool's text one with ``tool_call_id`` and ``content``; any other text is plain content. Calls and results are
joined by hash on conversation and identifier, never by conversation alone, so a conversation that holds a
third of all rows is spread like any other. Calls that depend on each other form components; each is ordered in one
task, and those of more than ``MOST`` dependencies by rounds of equi-joins instead.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import as_many_parts, settle, small, with_row_id
from strandweave.operators.graph import components

#: Dependencies of a component up to which it is ordered in one task.
MOST = 50_000
#: Argument schemas by tool name, in the part of JSON Schema that ``problems`` checks. Production parameter.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "required": ["url"]},
    "weather": {"type": "object", "properties": {"place": {"type": "string"}, "unit": {"enum": ["celsius", "fahrenheit"]}}, "required": ["place"]},
}

#: Up to this, a double that is whole is that whole number.
LARGEST = 1 << 53

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def sound(text: str) -> str:
    """A string with lone surrogates as replacement marks, which is what can be written."""
    return text.encode("utf-8", "replace").decode()


def plain(value):
    """A JSON value whose strings can be written and whose whole numbers are integers, so that equal ones look alike."""
    if isinstance(value, str):
        return sound(value)
    if isinstance(value, float) and value.is_integer() and abs(value) <= LARGEST:
        return int(value)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return {sound(k): plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, characters as they are and whole numbers up to 2^53 without a point."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value its schema does not allow."""
    kind = schema.get("type")
    value = int(value) if kind == "integer" and isinstance(value, float) and value.is_integer() else value
    if kind and (not isinstance(value, _KINDS[kind]) or isinstance(value, bool) and kind in ("number", "integer")):
        return [f"{at}: not {kind}"]
    out = [] if "enum" not in schema or value in schema["enum"] else [f"{at}: not listed"]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] if value < schema.get("minimum", value) else []
        out += [f"{at}: too large"] if value > schema.get("maximum", value) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known and schema.get("additionalProperties", True) is False]
        out += [p for k in sorted(value) if k in known for p in problems(value[k], known[k], f"{at}.{k}")]
    if isinstance(value, list) and "items" in schema:
        out += [p for n, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{n}]")]
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def _loads(text: str):
    """The value of a JSON text; None if it isn't JSON, holds NaN or infinity, or a number that no double holds."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_number)
    except (ValueError, RecursionError):
        return None


def _text(value) -> str | None:
    return sound(value) if isinstance(value, str) else None if value is None else canonical(value)


def read_message(role: str | None, text: str | None, schemas: dict) -> tuple[str, list[dict]]:
    """Canonical JSON of a message's content, and its calls or its result."""
    body = _loads(text) if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{" else None
    if role == "tool" and isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
        return canonical(body.get("content")), [{"kind": "result", "id": sound(body["tool_call_id"]), "id_json": canonical(body["tool_call_id"])}]
    if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        calls = []
        for n, c in enumerate(body["tool_calls"]):
            c = c if isinstance(c, dict) else {}
            given = c.get("arguments")
            given = _loads(given) if isinstance(given, str) else given
            name = _text(c.get("name"))
            wrong = [sound(x) for x in problems(given, schemas[name])] if name in schemas else ["$: unknown tool"]
            needs = c.get("depends_on")
            needs = sorted({sound(x) for x in needs if isinstance(x, str)}) if isinstance(needs, list) else []
            called = _text(c.get("id"))
            calls.append({"kind": "call", "id": called, "id_json": canonical(called), "name_json": canonical(name), "seq": n, "name": name, "arguments": canonical(given), "needs": needs, "wrong": wrong})
        return canonical(body.get("content")), calls
    return canonical(text), []


_CALL = "kind string, id string, id_json string, name_json string, seq int, name string, arguments string, needs array<string>, wrong array<string>"


def messages(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``_row``, conv_id, turn, role, content, role_json and ``parts`` (calls or a result) of each row, written once.

    Here a conv_id is text. Messages without one form a conversation of their own, under the empty text.
    """
    known = SCHEMAS if schemas is None else schemas
    part = pa.struct([("kind", pa.string()), ("id", pa.string()), ("id_json", pa.string()), ("name_json", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("wrong", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            roles = b.column(3).to_pylist()
            made = [read_message(r, t, known) for r, t in zip(roles, b.column(4).to_pylist(), strict=True)]
            cols = [pa.array([m[0] for m in made], pa.string()), pa.array(map(canonical, roles), pa.string()), pa.array([m[1] for m in made], pa.list_(part))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], ["_row", "conv_id", "turn", "role", "content", "role_json", "parts"])

    c = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = with_row_id(c, "_row").select("_row", "conv_id", "turn", "role", "text")
    return settle(rows.mapInArrow(read, f"_row long, conv_id string, turn long, role string, content string, role_json string, parts array<struct<{_CALL.replace(' ', ':').replace(',:', ',')}>>"))


def peel(edges: pd.DataFrame) -> pd.DataFrame:
    """conv_id, id and level of the calls of one component, from its dependencies (conv_id, id, need)."""
    after: dict[tuple, list[tuple]] = {}
    open_needs: dict[tuple, int] = {}
    for conv, one, need in edges[["conv_id", "id", "need"]].itertuples(index=False, name=None):
        after.setdefault((conv, need), []).append((conv, one))
        open_needs[conv, one] = open_needs.get((conv, one), 0) + 1
    level = {n: 0 for n in after if n not in open_needs}
    ready = list(level)
    for n in ready:
        for x in after.get(n, ()):
            open_needs[x] -= 1
            level[x] = max(level.get(x, 0), level[n] + 1)
            if not open_needs[x]:
                ready.append(x)
    every = sorted({*after, *open_needs})
    return pd.DataFrame([(c, i, None if open_needs.get((c, i)) else level[c, i]) for c, i in every], columns=["conv_id", "id", "level"]).astype({"level": "Int32"})


def peel_rounds(edges: DataFrame) -> DataFrame:
    """The same for components of any size, a round of joins a level."""
    edges = settle(edges.select("conv_id", "id", "need"))
    nodes = edges.select("conv_id", "id").union(edges.select("conv_id", F.col("need").alias("id"))).distinct()
    left, level = edges.count(), 0
    done = out = settle(nodes.join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    while left:
        level += 1
        rest = settle(edges.join(done.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_anti"))
        if (now := rest.count()) == left:
            break
        freed = edges.select("conv_id", "id").distinct().join(rest.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
        done = settle(freed.withColumn("level", F.lit(level)))
        out, edges, left = out.union(done), rest, now
    return nodes.join(out, ["conv_id", "id"], "left")


def levels(calls: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, id and level of each owned call: 0 without dependencies, else one above the highest of them.

    A call on a cycle, or that depends on one, has no level. Dependencies on ids that the conversation never calls are void.
    """
    nodes = calls.select("conv_id", "id")
    edges = calls.select("conv_id", "id", F.explode("needs").alias("need")).join(nodes.withColumnRenamed("id", "need"), ["conv_id", "need"])
    edges = settle(edges.select("conv_id", "id", "need").distinct())
    if not (count := edges.count()):
        return nodes.withColumn("level", F.lit(0))
    edges = edges.withColumns({"a": F.xxhash64("conv_id", "id"), "b": F.xxhash64("conv_id", "need")})  # equal hashes only join components
    roots = components(edges.select("a", "b"), 2 * count)
    edges = settle(edges.join(roots, F.col("a") == F.col("node"), "left").select("conv_id", "id", "need", F.coalesce("root", "a").alias("root")))
    large = settle(edges.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root"), 1)
    here = edges if not large.count() else edges.join(large, "root", "left_anti")
    found = here.groupBy("root").applyInPandas(peel, "conv_id string, id string, level int")
    found = found if here is edges else found.unionByName(peel_rounds(edges.join(large, "root", "left_semi")))
    found = found.withColumn("linked", F.lit(True))
    return nodes.join(found, ["conv_id", "id"], "left").select("conv_id", "id", F.when(F.col("linked"), F.col("level")).otherwise(0).alias("level"))


def _linked(rows: DataFrame) -> DataFrame:
    parts = settle(rows.select("_row", "conv_id", "turn", F.explode("parts").alias("p")).select("_row", "conv_id", "turn", "p.*"))
    calls, results = parts.where("kind = 'call'"), parts.where("kind = 'result'")
    order = F.struct("turn", "_row", "seq")
    owner = settle(calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(order).alias("first"), F.min_by(F.struct("name", "name_json"), order).alias("own"), F.min_by("needs", order).alias("needs")))
    same = (F.col("p.conv_id") == F.col("o.conv_id")) & (F.col("p.id") == F.col("o.id"))
    later = F.col("o.first").isNotNull() & (F.struct("p.turn", "p._row") > F.struct(F.col("o.first.turn"), F.col("o.first._row")))
    answers = settle(results.alias("p").join(owner.alias("o"), same, "left").select("p.*", "o.own", F.coalesce(later, F.lit(False)).alias("later")))
    first = answers.where("later").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "_row")).alias("answer"))
    known = owner.select("conv_id", "id", "first").join(first, ["conv_id", "id"], "left").join(levels(owner.select("conv_id", "id", "needs")), ["conv_id", "id"], "left")
    owned = F.struct("p.turn", "p._row", "p.seq").eqNullSafe(F.col("o.first"))
    state = F.when(F.col("p.id").isNull(), "unnamed").when(~owned, "duplicate").when(F.col("o.answer").isNull(), "unanswered").otherwise("linked")
    columns = [F.col(f"p.{c}") for c in ("_row", "conv_id", "turn", "kind", "id", "id_json", "seq")]
    of_calls = calls.alias("p").join(known.alias("o"), same, "left").select(*columns, "p.name", "p.name_json", "p.arguments", "p.wrong", state.alias("state"), "o.level")
    chosen = F.struct("p.turn", "p._row").eqNullSafe(F.col("o.answer"))
    state = F.when(~F.col("p.later"), "orphan").when(chosen, "linked").otherwise("extra")
    of_results = answers.alias("p").join(first.alias("o"), same, "left").select(*columns, F.col("p.own.name").alias("name"), F.col("p.own.name_json").alias("name_json"), "p.arguments", "p.wrong", state.alias("state"), F.lit(None).cast("int").alias("level"))
    return of_calls.union(of_results)


def link(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row a call or result: what it belongs to and what is wrong with it, if anything.

    ``state`` of a call: ``linked`` (the first call of its id, answered by a later message), ``unanswered``,
    ``duplicate`` (its id was called before) or ``unnamed`` (no id); of a result: ``linked`` (the first later one for its id),
    ``extra`` (a further one) or ``orphan`` (none called before it). ``level`` is the place in dependency order, null on a cycle.
    Messages without conv_id form a conversation of their own; of messages with an equal turn, their order as read decides.
    """
    return _linked(messages(conversations, schemas)).withColumn("conv_id", F.nullif("conv_id", F.lit("")).cast("long")).drop("id_json", "name_json")


def format_messages(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, role, message (canonical JSON), n_calls, n_linked, n_wrong and state of each message row.

    A message's calls stand in dependency order, then as given, calls on a cycle last. Null texts and roles are
    JSON nulls; text that is not such an object stays plain content; repeated rows are formatted each by itself,
    the later ones' calls being duplicates; an empty table gives no row. ``state`` is a result's (see ``link``). Rows are
    read and written with an id once, so that an input whose rows come in another order each time is formatted whole.
    """
    rows = messages(conversations, schemas)
    parts = _linked(rows)
    call = F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), "id_json", F.lit(',"name":'), "name_json", F.lit("}"))
    order = F.struct(F.col("level").isNull().alias("cyclic"), F.col("level").alias("level"), F.col("seq").alias("seq"), call.alias("json"))
    is_call = F.col("kind") == "call"
    own = parts.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(is_call, order))).alias("calls"),
        F.sum(is_call.cast("long")).alias("n_calls"),
        F.sum((is_call & (F.col("state") == "linked")).cast("long")).alias("n_linked"),
        F.sum((is_call & (F.size("wrong") > 0)).cast("long")).alias("n_wrong"),
        F.max(F.when(~is_call, F.struct("id_json", "name", "name_json", "state"))).alias("result"),
    )
    joined = rows.drop("parts").join(own, "_row", "left")
    calls = F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", lambda c: c["json"]), ","), F.lit("]"))
    result = F.concat(F.lit(',"tool_call_id":'), "result.id_json")
    name = F.when(F.col("result.name").isNotNull(), F.concat(F.lit(',"name":'), "result.name_json")).otherwise("")
    message = F.concat(
        F.lit('{"content":'), "content", F.when(F.col("result").isNotNull(), name).otherwise(""), F.lit(',"role":'), "role_json",
        F.when(F.col("result").isNotNull(), result).otherwise(""), F.when(F.col("n_calls") > 0, calls).otherwise(""), F.lit("}"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = joined.select(F.nullif("conv_id", F.lit("")).cast("long").alias("conv_id"), "turn", "role", message.alias("message"), zero("n_calls"), zero("n_linked"), zero("n_wrong"), F.col("result.state").alias("state"))
    return as_many_parts(out, conversations)


#: For tables without tool calls, such as the test tables: each message as it stands.
ORACLE = """
select conv_id, turn, role, '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"role":' || coalesce(cast(to_json(role) as varchar), 'null') || '}' as message,
  0::bigint as n_calls, 0::bigint as n_linked, 0::bigint as n_wrong, null::varchar as state
from conversations
"""


def with_calls(conversations: DataFrame) -> DataFrame:
    """Conversations as calls and results, for the query on links: an assistant's turn calls one of three ids, a user's is a result.

    An id depends on the one before it, in every fifth conversation the first one on the last.
    """
    at = F.col("turn") % 3
    before = F.when(at > 0, at - 1).when(F.col("conv_id") % 5 == 0, 2)
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    arguments = F.struct(F.substring("text", 1, 20).alias("query"), (F.col("turn") - 1).alias("limit"))
    one = F.struct(name(at).alias("id"), F.lit("search").alias("name"), arguments.alias("arguments"), F.when(before.isNotNull(), F.array(name(before))).alias("depends_on"))
    text = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(one).alias("tool_calls")))).otherwise(F.to_json(F.struct(name(at).alias("tool_call_id"), F.col("text").alias("content"))))
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("tool").alias("role"), text.alias("text"))


LINKS_ORACLE = """
with m as (select conv_id, turn, role = 'assistant' as calls, 'c' || (turn % 3) as id, text from conversations),
own as (select conv_id, id, min(turn) as first from m where calls group by all),
ans as (select m.conv_id, m.id, min(turn) as answer from m join own using (conv_id, id) where not calls and turn > first group by all),
has as (select conv_id, bool_or(id = 'c0') as h0, bool_or(id = 'c1') as h1, bool_or(id = 'c2') as h2, conv_id % 5 = 0 as loops from own group by conv_id),
lev as (
  select conv_id, loops and h0 and h1 and h2 as cyclic,
    case when loops and h2 then case when h1 then 2 else 1 end else 0 end as l0,
    case when not h0 then 0 when loops and h2 then null else 1 end as l1,
    case when not h1 then 0 when h0 then 2 else 1 end as l2 from has)
select m.conv_id, m.turn, case when calls then 'call' else 'result' end as kind, m.id,
  case when calls then case when turn > first then 'duplicate' when answer is null then 'unanswered' else 'linked' end
    when first is null or turn < first then 'orphan' when turn = answer then 'linked' else 'extra' end as state,
  case when calls and not cyclic then case m.id when 'c0' then l0 when 'c1' then l1 else l2 end end::int as level,
  case when calls and turn < 2 then 1 else 0 end::int as n_wrong
from m left join own using (conv_id, id) left join ans using (conv_id, id) left join lev using (conv_id)
"""
