"""Tool calls of random conversations against a plain, row by row form."""

import json
import math
import random

import pytest

from strandweave.llm import tool_calls

ROWS = "conv_id long, turn long, role string, text string, level int, state string"
IDS = ["a", "b", "c", "d", "\ud800", "x\u2028\u0001", "", None, 5, ["l"]]


def random_rows(seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([1, 1.0, 2.5, 1e300, float("nan"), float("inf"), "s", "\udfff", None, True, [1, {"k": 2.0}], {"b": 1, "a": [None]}])
    rows = []
    for conv in [1, 2, 3, None, -(1 << 63)]:
        for turn in range(30):
            kind = rng.random()
            turn = rng.choice([turn, turn, turn, 7, None])
            if kind < 0.4:
                calls = [
                    {"id": rng.choice(IDS), "name": rng.choice(["search", "calculate", "fetch", "odd", ["search"], {}, None]), "arguments": rng.choice([{"query": "q"}, {"query": "q", "limit": rng.choice([0, 1, 2.0, 1.5])}, {"expression": value()}, '{"url": "u"}', "{bad", value()]), "depends_on": rng.choice([None, [], ["a"], ["b", "c", 4, "\ud800"], "a"])}
                    for _ in range(rng.randint(0, 3))
                ]
                rows.append((conv, turn, "assistant", json.dumps({"content": value(), "tool_calls": rng.choice([calls, calls, [*calls, 3]])})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(IDS), "content": value()})))
            else:
                rows.append((conv, turn, rng.choice(["user", None, "tool", "assistant"]), rng.choice(["hi", "", None, "{", "[1]", "{}", '{"content": 1e999}'])))
    return rows


def mend(value):
    """The value as it may be written."""
    if isinstance(value, str):
        return "".join("?" if 0xD800 <= ord(c) < 0xE000 else c for c in value)
    if isinstance(value, float) and value == int(value):
        return int(value) if abs(value) <= 2**53 else value
    if isinstance(value, list):
        return [mend(v) for v in value]
    return {mend(k): mend(v) for k, v in value.items()} if isinstance(value, dict) else value


def dump(value):
    return json.dumps(mend(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def finite(value):
    if isinstance(value, float):
        return math.isfinite(value)
    return all(map(finite, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list)) else True


def load(text):
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if finite(value) else None


def plain_messages(rows):
    """conv_id, turn, role, message, n_calls, n_linked, n_wrong and state of each row, in order."""
    name = lambda v: v if v is None else mend(v) if isinstance(v, str) else dump(v)
    read = []
    for n, (conv, turn, role, text) in enumerate(rows):
        body = load(text) if text and role in ("assistant", "tool") and text.startswith("{") else None
        at = (conv, (turn is not None, turn or 0, n))
        calls, result, content = [], None, text
        if role == "tool" and isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
            content, result = body.get("content"), mend(body["tool_call_id"])
        elif role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
            content = body.get("content")
            for c in body["tool_calls"]:
                c = c if isinstance(c, dict) else {}
                given = load(c["arguments"]) if isinstance(c.get("arguments"), str) else c.get("arguments")
                own = name(c.get("name"))
                needs = {mend(x) for x in c["depends_on"] if isinstance(x, str)} if isinstance(c.get("depends_on"), list) else set()
                wrong = tool_calls.problems(given, tool_calls.SCHEMAS[own]) if own in tool_calls.SCHEMAS else ["unknown"]
                calls.append((name(c.get("id")), own, dump(given), needs, bool(wrong)))
        read.append((at, role, content, calls, result))
    owner, answer, level = {}, {}, {}
    for (conv, at), _, _, calls, _ in read:
        for seq, c in enumerate(calls):
            if c[0] is not None and ((conv, c[0]) not in owner or (at, seq) < owner[conv, c[0]][:2]):
                owner[conv, c[0]] = (at, seq, c)
    for (conv, at), _, _, _, result in read:
        key = (conv, result)
        if key in owner and at[:2] + at[2:] > owner[key][0]:
            answer[key] = min(answer.get(key, at), at)
    while True:  # from those whose needs are all done
        ready = [k for k, (_, _, c) in owner.items() if k not in level and all((k[0], x) in level for x in c[3] if (k[0], x) in owner)]
        if not ready:
            break
        level |= {k: 1 + max((level[k[0], x] for x in owner[k][2][3] if (k[0], x) in owner), default=-1) for k in ready}
    out = []
    for ((conv, at), role, content, calls, result), (_, turn, _, _) in zip(read, rows, strict=True):
        shown, linked = [], 0
        for seq, (i, own, given, _, _) in enumerate(calls):
            text = f'{{"arguments":{given},"id":{dump(i)},"name":{dump(own)}}}'
            lv = level.get((conv, i)) if i is not None else None
            shown.append((lv is None, lv or 0, seq, text))
            linked += i is not None and owner[conv, i][:2] == (at, seq) and (conv, i) in answer
        key, state, parts = (conv, result), None, [f'"content":{dump(content)}']
        if result is not None:
            state = "orphan" if key not in owner or at < owner[key][0] else "linked" if answer[key] == at else "extra"
            if key in owner and owner[key][2][1] is not None:
                parts.append(f'"name":{dump(owner[key][2][1])}')
        parts.append(f'"role":{dump(role)}')
        parts += [f'"tool_call_id":{dump(result)}'] if result is not None else []
        parts += [f'"tool_calls":[{",".join(x[3] for x in sorted(shown))}]'] if shown else []
        out.append((conv, turn, role, "{" + ",".join(parts) + "}", len(calls), linked, sum(c[4] for c in calls), state))
    return out


@pytest.mark.parametrize("seed,most", [(0, None), (1, None), (2, 0)])
def test_messages_by_definition(spark, monkeypatch, seed, most):
    if most is not None:
        monkeypatch.setattr(tool_calls.levels, "__defaults__", (most,))
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).coalesce(1)
    got = sorted((tuple(r) for r in tool_calls.format_messages(df).collect()), key=str)
    assert got == sorted(plain_messages(rows), key=str)
    for r in got:
        json.loads(r[3], parse_constant=pytest.fail)


def test_numbers_that_are_equal_look_alike():
    assert tool_calls.canonical({"b": 1.0, "a": [1, -0.0, 2.5, 1e300, 2.0**53]}) == '{"a":[1,0,2.5,1e+300,9007199254740992],"b":1}'
    assert tool_calls.problems(1.0, {"type": "integer"}) == [] and tool_calls.problems(1.5, {"type": "integer"}) == ["$: not integer"]
    with pytest.raises(ValueError):
        tool_calls.canonical(float("nan"))
