"""The strict window reader against a plain version of its rules over random windows, and the text of a call."""

import json
import random

import pytest

from loomwright.operators import windows
from loomwright.sources import files


def plainly(text):
    """(status, number of the call, [(id, tool, arguments)]) by reading one value after another."""
    try:
        row = json.loads(text)
    except (TypeError, ValueError):
        row = None
    if not isinstance(row, dict):
        return "no_object", None, None
    uid = row.get("unit_id")
    for bad, fault in ((not isinstance(row.get("thought"), str), "thought_is_no_text"), (not isinstance(uid, str) or not uid.strip(), "unit_id_is_blank"), (not isinstance(row.get("actions"), list), "actions_are_no_list"), (not isinstance(row.get("window_complete"), bool), "window_complete_is_no_flag")):
        if bad:
            return fault, None, None
    out, seen = [], []
    for k, a in enumerate(row["actions"], 1):
        if not isinstance(a, dict):
            return "action_is_no_object", k, None
        call = a["raw_call"] if "raw_call" in a else a
        if not isinstance(call, dict):
            return "call_is_no_object", k, None
        tool = call["tool"] if "tool" in call else call.get("function")
        given = call["arguments"] if "arguments" in call else call.get("args")
        if isinstance(tool, dict):
            tool, given = tool.get("name"), tool.get("arguments")
        if isinstance(given, str):
            try:
                given = json.loads(given)
            except ValueError:
                return "arguments_are_no_json", k, None
        if not isinstance(tool, str) or not tool.strip():
            return "tool_is_blank", k, None
        if not isinstance(given, dict):
            return "arguments_are_no_object", k, None
        own = next((str(d[key]) for d, key in ((a, "action_id"), (a, "id"), (call, "id")) if key in d), f"A{k}")
        if not own or own in seen:
            return "action_id_repeats" if own else "action_id_is_empty", k, None
        seen.append(own)
        out.append((own, tool, given))
    return "valid", None, out


def some_windows(n, seed):
    rng = random.Random(seed)
    pick = rng.choice
    good = lambda: {k: pick([1, 2.5, "é\"\n", None, True, [1, {"b": 2, "a": 1}], {"y": 1, "x": []}]) for k in rng.sample(["zeta", "path", "cmd", "alpha", "url", "ключ"], rng.randrange(4))}
    rare = lambda good, *bad: pick(bad) if rng.random() < 0.06 else good

    def call():
        args = rare(pick([good(), json.dumps(good())]), None, [1], "{bad", "[1]", 3, "", "null")
        tool = rare("read", "", "  ", None, 5, ["x"])
        out = {pick(["tool", "function"]): {"name": tool, "arguments": args}} if rng.random() < 0.3 else {pick(["tool", "function"]): tool, pick(["arguments", "args"]): args}
        if rng.random() < 0.1:
            out["function"] = "other"
        if rng.random() < 0.2:
            out["id"] = pick(["c1", 7, None, True, "", "A2", -1])
        if rng.random() < 0.3:
            out = {"raw_call": rare(out, None, "x", [])}
        if rng.random() < 0.2:
            out[pick(["action_id", "id"])] = pick(["k1", "k2", 8, False, "A1", ""])
        return rare(out, None, 4, "call", [])

    for k in range(n):
        w = {"unit_id": rare(f"u{k}", "", " ", None, 3), "thought": rare("why", "", None, 1), "window_complete": rare(pick([True, False]), None, 1, "true"), "actions": rare([call() for _ in range(rng.randrange(5))], None, {}, "[]")}
        if rng.random() < 0.05:
            w.pop(pick(sorted(w)))
        yield json.dumps(w, ensure_ascii=pick([True, False]))
    yield from (None, "", "{", "[]", "3", "null", '{"unit_id": "u"} x')


def test_windows_against_a_plain_reader(spark):
    texts = list(some_windows(700, 11))
    d = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    got = {r["n"]: r for r in windows.with_model_texts(windows.checked_windows(d)).collect()}
    seen = set()
    for n, text in enumerate(texts):
        status, at, calls = plainly(text)
        seen.add(status)
        r = got[n]
        assert (r["status"], r["fault_at"]) == (status, at), text
        if status == "valid":
            assert [(c["action_id"], c["tool"], json.loads(c["arguments"]), c["model_text"]) for c in r["actions"]] == [(*c, windows.model_text(c[1], c[2])) for c in calls]
            assert [list(json.loads(c["arguments"])) for c in r["actions"]] == [list(c[2]) for c in calls]  # the order of the keys
            assert (r["unit_id"], r["window_complete"]) == (json.loads(text)["unit_id"], json.loads(text)["window_complete"])
        else:
            assert r["actions"] is None
    assert seen == {"valid", *windows.WINDOW_FAULTS, *windows.ACTION_FAULTS}


def test_model_text():
    assert windows.model_text("w", {"body": "é", "cmd": 1, "path": "a", "x": {"url": 1, "path": 2}}) == '[ACTION] {"function":"w","args":{"path":"a","cmd":1,"body":"é","x":{"url":1,"path":2}}}'
    assert windows.model_text('q"', {}) == '[ACTION] {"function":"q\\"","args":{}}'


def test_a_long_window_is_checked_without_pairs(spark):
    calls = [{"tool": "t", "arguments": {"n": k}, "id": f"i{k}"} for k in range(20_000)] + [{"tool": "t", "arguments": {}, "id": "i3"}]
    text = json.dumps({"unit_id": "u", "thought": "", "window_complete": True, "actions": calls})
    r = windows.checked_windows(spark.createDataFrame([(text,)], "value string")).select("status", "fault_at").first()
    assert tuple(r) == ("action_id_repeats", 20_001)


def test_files_of_windows(spark, tmp_path):
    path = tmp_path / "w.jsonl"
    good = {"unit_id": "a", "thought": "t", "window_complete": True, "actions": [{"tool": "x", "args": {"k": 1, "path": "p"}}], "test_type": "hard"}
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"unit_id": "b", "actions": []}) + "\n")
    got = {r["unit_id"]: (r["thought"], [c["model_text"] for c in r["actions"]], r["test_type"]) for r in files.read_windows(spark, str(path)).collect()}
    assert got == {"a": ("t", ['[ACTION] {"function":"x","args":{"path":"p","k":1}}'], "hard"), "b": ("t", [], "hard")}
    for rows, problem in (([good, good], "repeated unit_id: a"), ([], "no rows"), ([good | {"thought": 1}], "thought_is_no_text"), ([good, good | {"unit_id": "c", "actions": [{}]}], "window c: tool_is_blank in call 1")):
        path.write_text("\n".join(map(json.dumps, rows)) + "\n")
        with pytest.raises(Exception, match=problem):
            files.read_windows(spark, str(path)).collect()
