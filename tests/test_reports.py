"""Hints, reports and notes against plain Python."""

import json
import re

import numpy as np
from pyspark.sql import functions as F

from keepsake.operators import evaluate, hints, history, mutate, scans


def _front(content):
    found = re.match(r"---[ \t]*\r?\n([\s\S]*?)\r?\n---(?:[ \t]*\r?\n|[ \t]*\Z)", content[:20_000].removeprefix("\ufeff"))
    out, inside = {"name": None, "description": None, "kind": None}, False
    for raw in re.split(r"\r?\n", found[1]) if found else []:
        line = raw.strip(" \t\n\r\f\v")
        field = re.match(r"([A-Za-z0-9_.-]+)\s*:\s*(.*)$", line)
        if not line or line[0] == "#" or not field:
            continue
        key, value = field[1], field[2].strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1].strip()
        outer = not raw[:1].isspace()
        if outer:
            inside = key == "metadata" and value == ""
        if value and outer and key in ("name", "description"):
            out[key] = value
        if value and (key == "metadata.type" or (inside and key == "type")):
            out["kind"] = value
    return out


def test_front_matter_equals_a_line_by_line_reading(spark):
    rng = np.random.default_rng(8)
    lines = ["name: a", "name: 'b c'", 'description: "  d "', "description:", "metadata:", "  type: t1", "\ttype: 't2'", "type: top", "metadata.type: dotted", "# name: no",
             "", "no field", "  name: inner", "metadata: full", "name : \"'q'\"", "a-b_c.d: 1", "---x", "description: é世 : y", "name: '", "metadata: ''"]
    texts = ["", "---", "---\n---\n", "---\nname: x\n---", "--- \t\r\nname: x\r\n--- \r\nrest", "\ufeff---\nname: x\n---\n", " ---\nname: x\n---\n", "---\nname: x\n--- y\n", "---\nname: x\n" + "z" * 20_000 + "\n---\n"]
    for _ in range(250):
        texts.append("---\n" + str(rng.choice(["\n", "\r\n"])).join(rng.choice(lines, int(rng.integers(1, 9))).tolist()) + "\n---\nbody\n---\nname: late\n---\n")
    df = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    got = {r["n"]: r["f"].asDict() for r in df.select("n", hints.front_matter(F.col("content")).alias("f")).collect()}
    for n, text in enumerate(texts):
        assert {k: got[n][k] for k in ("name", "description", "kind")} == _front(text), text


def test_hints_are_bounded_and_bad_calls_go(spark):
    long = "x" * 13_000 + "END"
    calls = [
        (1, " s ", "t", json.dumps({"name": "n" * 1200, "content": long, "description": 7, "type": "low", "metadata": {"type": " high "}}), 5),
        (2, "s", "t", json.dumps({"content": "---\nname: f\n---\n", "path": "/p"}), 6),
        (3, "s", None, json.dumps({"path": "/p", "content": None}), 7),
        (4, "s", " ", "[1, 2]", 8),
        (5, "s", None, None, 9),
        (6, "s", None, "{broken", 9),
        (7, " ", "t", "{}", 10),
        (8, None, "t", "{}", 10),
        (9, "s", "t", "{}", -1),
        (10, "s", "t", "{}", 8_640_000_000_000_001),
        (11, "s", "t", "{}", None),
        (12, "s", None, json.dumps({"content": ""}), 0),
    ]
    df = spark.createDataFrame(calls, "n int, session_id string, tool_use_id string, tool_input string, ts_ms long")
    found = hints.write_hints(df)
    got = {r["n"]: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 12]
    first = got[1]
    assert (first["session"], first["name"], first["description"], first["kind"]) == ("s", "n" * 997 + "...", None, "high")
    assert first["truncated"] and first["content"] == long[:9981] + "\n...[truncated]...\n" + long[-2000:] and len(first["content"]) == 12_000
    assert [got[n]["name"] for n in (2, 3, 4, 5, 6, 12)] == ["f", "/p", "memory_write", "memory_write", "memory_write", "memory_write"]
    assert [got[n]["content"] for n in (3, 4, 5, 6, 12)] == [calls[2][3], "[1, 2]", "null", "null", ""]
    assert got[4]["tool_id"] is None
    assert sorted(r["n"] for r in hints.loaded(found).collect()) == [1, 3, 4, 5, 6, 12]
    assert hints.loaded(hints.write_hints(df.where("false"))).count() == 0


def test_percentiles_are_places_of_the_sorted_values(spark):
    rng = np.random.default_rng(2)
    data = [("a", int(v)) for v in rng.integers(0, 9, 137)] + [("b", 4)] + [("c", int(v)) for v in rng.permutation(100)]
    got = {r["arm"]: (r["p50"], r["p95"]) for r in evaluate.percentiles(spark.createDataFrame(data, "arm string, ms int"), "arm", "ms", [50, 95]).collect()}
    for arm in "abc":
        v = sorted(x for a, x in data if a == arm)
        assert got[arm] == (v[50 * len(v) // 100], v[95 * len(v) // 100])


def test_report_compares_only_prompts_that_both_arms_ran(spark):
    runs = spark.createDataFrame([("A", "p", 1), ("A", "q", 3), ("B", "p", 2), ("B", "r", 4), ("A", "e", 1), ("B", "e", 1)], "arm string, prompt string, ms int")
    injected = [("A", "p", "1", None, False), ("A", "p", "2", None, True), ("A", "q", "9", None, False),
                ("B", "p", "2", "relates_to", True), ("B", "p", "3", "shares_entity", True), ("B", "p", "4", None, True), ("B", "r", "5", None, True)]
    rows = spark.createDataFrame(injected, "arm string, prompt string, id string, via string, keyword boolean")
    verdicts = [("p", "1", "relevant"), ("p", "3", "relevant"), ("p", "4", "partially_relevant"), ("q", "9", "relevant"), ("r", "5", "relevant"), ("p", "2", "unknown")]
    judged = spark.createDataFrame(verdicts, "prompt string, id string, verdict string")
    gold = spark.createDataFrame([("p", "3", True), ("p", "1", False), ("r", "5", True)], "prompt string, id string, helped boolean")
    a, b = (r.asDict() for r in evaluate.eval_report(runs, rows, judged, gold, "A").orderBy("arm").collect())
    assert (a["prompts"], a["injected"], a["judged"], a["strict"], a["discoveries"], a["overlap"], a["gold_rate"]) == (3, 3, 3, 2 / 3, None, None, 0.0)
    assert (b["discoveries"], b["strict_found"], b["entity_found"], b["keyword_found"], b["displaced"], b["net"]) == (2, 1, 1, 1, 1, 0)
    assert (b["overlap"], b["per_100"], b["gold_judged"], b["gold_helped"], b["gold_found"], b["strict"], b["lenient"]) == ((1 / 4 + 1) / 2, 50.0, 2, 2, 1, 2 / 4, 3 / 4)
    empty = evaluate.eval_report(runs, rows.where("false"), judged, gold, "A").orderBy("arm").collect()
    assert [(r["injected"], r["strict"], r["overlap"]) for r in empty] == [(0, None, None), (0, None, 1.0)]


def test_two_result_lists(spark):
    asked = spark.createDataFrame([(q,) for q in "abcdef"], "query string")
    lists = lambda rows: spark.createDataFrame(rows, "query string, id string, rank int, similarity double")
    a = lists([("a", "1", 1, 0.9), ("a", "2", 2, 0.8), ("b", "1", 1, 0.9), ("b", "2", 2, 0.8), ("c", "1", 1, 0.9), ("d", "1", 1, 0.5), *[("f", str(i), i, 0.9) for i in range(1, 5)]])
    b = lists([("a", "1", 1, 0.9), ("a", "2", 2, 0.7), ("b", "2", 1, 0.8), ("b", "1", 2, 0.9), ("c", "3", 1, 0.9), ("f", "1", 1, 0.9), ("f", "2", 2, 0.9), ("f", "3", 3, 0.9)])
    got = {r["query"]: (r["overlap"], r["drifted"], r["verdict"]) for r in evaluate.compare_results(asked, a, b).collect()}
    assert got == {"a": (100, 1, "same"), "b": (100, 0, "order"), "c": (0, 0, "far"), "d": (0, 0, "far"), "e": (100, 0, "same"), "f": (75, 0, "near")}


def test_notes_by_place_and_use(spark):
    columns = "target string, id string, where string, what string, evidence string, project string, usage_count long, last_used long, ts_ms long"
    data = [("t", "1", " src\n x ", "one\n two", "seen\there", "p", 1, 5, 5), ("t", "2", "src x", "three", " ", "q ", 2, 1, 1), ("t", "3", None, "four", None, "Unknown", 1, 1, 1), ("u", "4", "", "five", None, None, 1, 1, 1)]
    got = {r["target"]: (r["n"], r["text"]) for r in scans.suggested_notes(spark.createDataFrame(data, columns)).collect()}
    assert got == {
        "t": (3, "Scope: Multiple projects\nProjects: p, q\n\n## General\n- four\n\n## src x\n- three\n- one two (Evidence: seen here)\n"),
        "u": (1, "Scope: Global\n\n## General\n- five\n"),
    }


def test_latest_injections_need_a_prompt(spark):
    data = [("a", 5, None, "1"), ("a", 4, " hi ", "1"), ("a", 4, None, "2"), ("a", 4, "hi", "1"), ("a", 3, "old", "3"), ("a", 4, "hi", ""), ("a", 4, "hi", None), ("b", 1, " \n", "1"), (None, 1, "x", "1")]
    got = history.latest_injections(spark.createDataFrame(data, "session string, ts_ms long, prompt string, id string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4, "hi", "1"), ("a", 4, "hi", "2")]


def test_delete_reports_what_was_not_there(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    left, report = mutate.delete_reported(df, spark.createDataFrame([("a",), ("z",), ("a",), (None,)], "id string"))
    assert sorted(tuple(r) for r in report.collect()) == [("a", "deleted"), ("z", "missing")]
    assert sorted(r["v"] for r in left.collect()) == [2, 3]
