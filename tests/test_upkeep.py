"""Command lines, JSON in texts, patches, trims, excerpts and gated merges against plain Python."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import commands
from keepsake.operators import upkeep
from keepsake.schema import PAYLOAD
from keepsake.settings import DAY_MS, Settings


def brute_segment(line):
    single = double = escaped = False
    for i, c in enumerate(line):
        if escaped:
            escaped = False
        elif c == "\\" and not single:
            escaped = True
        elif c == "'" and not double:
            single = not single
        elif c == '"' and not single:
            double = not double
        elif not single and not double and (c in ";|" or line[i : i + 2] == "&&"):
            return line[:i].strip(" ")
    return line.strip(" ")


def brute_program(line):
    tokens = [t[1:-1] if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'" else t for t in re.findall(r"\"[^\"]*\"|'[^']*'|\S+", brute_segment(line))]
    i, options = 0, False
    while i < len(tokens):
        t = tokens[i]
        if options and t.startswith("-"):
            i += 2 if t in ("-u", "-g", "-h", "-p", "-U") else 1
            continue
        options = t in ("sudo", "env")
        if t and not options and not re.match(r"[A-Za-z_][A-Za-z0-9_]*=", t):
            return t, [x for x in tokens[i + 1 :] if x]
        i += 1
    return None, []


LINES = [
    "", "   ", "ls", "A=1 B='x y' ls -l", "A='1 2' ls", "sudo -u root -E env -i X=1 'my prog' a \"\" b", "sudo -u", "env", "env -u A B=2 -c", "'' ls", "echo 'a;b' \"c|d\" e\\;f && rm",
    "a & b", "a&&b", "'open ; quote", '"open | quote', "x \\", "'it\\' ; rest", '"q\\" ; still" ; next', "=x ls", "1A=2 ls", "sudo sudo -p x -n cat; no", "sudo -g g -h h - cat", "\tls\t-a", "a\nb ; c", "'", "a'b c'd e",
]


def test_command_lines_equal_a_state_machine(spark):
    rng = np.random.default_rng(1)
    signs = list("ab=-u'\"\\;|& ") + ["sudo ", "env ", " -u ", "A=1 "]
    lines = LINES + ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r["i"]: (r["seg"], r["p"]["program"], list(r["p"]["args"])) for r in df.select("i", commands.first_segment(F.col("line")).alias("seg"), commands.parsed(F.col("line")).alias("p")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == (brute_segment(line), *brute_program(line)), line


def test_validity_by_a_table_of_programs(spark):
    rows = [("a", "command", "git status"), ("b", "command", "sudo nowhere -x"), ("c", "command", "./run.sh"), ("d", "command", "npx thing"), ("e", "command", "A=1"), ("f", "command", None), ("g", "error", "git")]
    df = spark.createDataFrame(rows, "id string, type string, exact_text string")
    got = {r["id"]: (r["valid"], r["reason"]) for r in upkeep.validity(df, spark.createDataFrame([("git",), ("git",)], "program string")).collect()}
    assert got == {"a": (True, None), "b": (False, "missing-command:nowhere"), "c": (True, None), "d": (True, None), "e": (False, "missing-command"), "f": (False, "missing-command")}


def brute_object(text):
    start = (text or "").find("{")
    if start < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text[start:])[0]
    except ValueError:
        return None


OBJECTS = [
    None, "", "none", '{"a": 1}', 'x {"a": {"b": [1, {"c": "}"}]}} y {"z": 2}', '{"s": "\\"}{"} }', '{"cut": {"a": 1}', "{}", "{bad} {\"ok\": 1}", '{"a": "\\\\"}"', "} {\"a\": \"ü😀\"}", '{"a": "un', '"quoted {" {"a": 1}',
    '```json\n{"verdict": "merge",\n "ids": ["a", "b"]}\n```',
]


def test_the_first_object_of_a_text(spark):
    df = spark.createDataFrame(list(enumerate(OBJECTS)), "i int, t string")
    got = {r["i"]: None if r["x"] is None else json.loads(r["x"]) for r in df.select("i", commands.json_object(F.col("t")).alias("x")).collect()}
    want = {i: brute_object(t) for i, t in enumerate(OBJECTS)}
    assert got == want and sum(v is not None for v in want.values()) >= 6


def test_patches_by_type(spark):
    fields = {
        "command": "c", "exitCode": "3", "outcome": "partial", "errorText": "t", "what": "w", "confidence": "verified", "name": "n", "steps": '["one", " ", " two "]', "avoid": "a", "severity": "odd",
        "reason": " r ", "id": "x", " verification ": "v", "context": '{"project": "p2", "cwd": "c2", "file": "f2", "tool": " "}', "resolution": "",
    }
    kinds = ["command", "error", "discovery", "procedure", "warning"]
    old = spark.createDataFrame([(k, k, {"context": {"project": "p1", "tool": "t1"}, "resolution": "old"}) for k in kinds], f"id string, type string, payload {PAYLOAD.simpleString()}")
    got = {r["id"]: r for r in upkeep.patched(old, spark.createDataFrame([(k, fields) for k in kinds], "id string, fields map<string, string>")).collect()}
    part = lambda k, *names: tuple(got[k]["payload"][n] for n in names)
    assert part("command", "command", "exitCode", "outcome", "resolution", "name") == ("c", 3, "partial", "old", None)
    assert got["command"]["payload"]["context"].asDict() == {"project": "p2", "cwd": "c2", "intent": None, "file": None, "tool": "t1"}
    assert got["error"]["payload"]["context"].asDict() == {"project": "p2", "cwd": None, "intent": None, "file": "f2", "tool": "t1"}
    assert part("discovery", "what", "confidence", "context") == ("w", "verified", got["discovery"]["payload"]["context"]) and got["discovery"]["payload"]["context"]["project"] == "p1"
    assert part("procedure", "name", "verification", "steps") == ("n", "v", ["one", "two"]) and got["procedure"]["payload"]["context"]["project"] == "p2"
    assert part("warning", "avoid", "severity", "reason") == ("a", None, "r")
    own = {k: {*upkeep.PATCHED[k], *(["context"] if k in upkeep.PATCHED_CONTEXT else [])} for k in kinds}
    for k in kinds:
        named = {n.strip() for n, v in fields.items() if v.strip()}
        assert set(got[k]["refused"]) == (named - own[k]) | ({"severity"} if k == "warning" else set()), k


def test_bad_values_are_refused(spark):
    old = spark.createDataFrame([("i", "command", None), ("j", "procedure", None)], f"id string, type string, payload {PAYLOAD.simpleString()}")
    new = spark.createDataFrame([("i", {"exitCode": "x1", "outcome": "great", "context": "no object"}), ("j", {"steps": "a\n\n b \n", "context": "{broken"})], "id string, fields map<string, string>")
    got = {r["id"]: r for r in upkeep.patched(old, new).collect()}
    assert got["i"]["refused"] == ["context", "exitCode", "outcome"] and got["i"]["payload"]["exitCode"] is None
    assert got["j"]["payload"]["steps"] == ["a", "b"]


def test_a_record_far_over_the_limit_loses_its_weakest_entity_edges(spark):
    rows = [("s", f"t{i:04}", "shares_entity", i % 50 / 50, 1) for i in range(1000)] + [("s", "other", "supersedes", 0.0, 1), ("q", "t", "shares_entity", 0.1, 1)]
    df = spark.createDataFrame(rows, "source string, target string, kind string, weight double, reinforcement long")
    sizes = spark.createDataFrame([("s", 3000)], "source string, size int")
    got = [r for r in upkeep.trimmed_edges(df, sizes).collect() if r["source"] == "s"]
    cost = lambda t, k, w: len(json.dumps({"target": t, "kind": k, "weight": w, "reinforcement": 1}, separators=(",", ":"))) + 1
    total, want = 3000 + cost("other", "supersedes", 0.0), []
    for _, t, k, w, _ in sorted(rows[:1000], key=lambda r: (-r[3], r[1])):
        total += cost(t, k, w)
        if total > 16_000:
            break
        want.append(t)
    assert sorted(r["target"] for r in got) == sorted([*want, "other"]) and 100 < len(want) < 1000
    assert upkeep.trimmed_edges(df, sizes.where("false")).where("source = 'q'").count() == 1


def brute_excerpt(events, at, most):
    pick = set(range(max(0, at - 3), min(len(events), at + 4)))
    kind, tool = events[at][2], events[at][3]
    other = {"tool_call": "tool_result", "tool_result": "tool_call"}.get(kind)
    pair = next((i for i, e in enumerate(events) if other and tool is not None and e[2] == other and e[3] == tool), None)
    places = sorted(pick | ({pair} if pair is not None else set()))
    blocks = [f"[{events[i][2]}]" + (f"\n{events[i][4].strip()}" if (events[i][4] or "").strip() else "") for i in places]
    a, b = 0, len(places) - 1
    while len("\n\n".join(blocks[a : b + 1])) > most and a < b:
        if abs(places[a] - at) >= abs(places[b] - at):
            a += 1
        else:
            b -= 1
    text = "\n\n".join(blocks[a : b + 1])
    return text if len(text) <= most else text[: most - 3] + "..."


@pytest.mark.parametrize("most", [8000, 120, 40])
def test_excerpts_with_paired_events(spark, most):
    rng = np.random.default_rng(7)
    kinds = ["user", "assistant", "tool_call", "tool_result"]
    events = [(k, t * 2, str(rng.choice(kinds)), None if rng.random() < 0.3 else f"t{rng.integers(4)}", rng.choice(["", "  ", "short", "a longer text here " * 3, None])) for k in (1, 2) for t in range(40)]
    events = [(k, t, kind, tool, None if text is None else str(text)) for k, t, kind, tool, text in events]
    df = spark.createDataFrame(events, "conv_id int, turn int, kind string, tool_id string, text string")
    finds = [(f"f{k}-{t}", k, t * 2) for k in (1, 2) for t in range(0, 40, 3)]
    got = {r["id"]: r["excerpt"] for r in upkeep.segments(df, spark.createDataFrame(finds, "id string, conv_id int, turn int"), most=most).collect()}
    assert got == {i: brute_excerpt([e for e in events if e[0] == k], t // 2, most) for i, k, t in finds}


def test_a_gated_run_fails_a_cluster_alone_and_a_dry_run_changes_nothing(spark):
    rows = [(c, f"{c}{i}") for c in "abcdef" for i in range(3)] + [("single", "x0")]
    clusters = spark.createDataFrame(rows, "cluster string, id string")
    df = spark.createDataFrame([(i, json.dumps({"t": i, "z": 1})) for _, i in rows], "id string, content string")
    keys = {r["cluster"]: r for r in upkeep.verdict_keys(clusters, df, "m").collect()}
    assert "single" not in keys and len({k["key"] for k in keys.values()}) == 6
    now, s = 1000 * DAY_MS, Settings(no_merge_backoff_days=10)
    held = [(keys["a"]["key"], keys["a"]["content_hash"], now - 9 * DAY_MS, "r"), (keys["b"]["key"], "other content", now, "r"), (keys["c"]["key"], keys["c"]["content_hash"], now - 10 * DAY_MS, "r"), ("elsewhere", "h", now, "r")]
    verdicts = spark.createDataFrame(held, "key string, content_hash string, checked_at long, reason string")
    said = [("a", "merge", "a0", "q"), ("b", "no_merge", None, "q"), ("c", "merge", "c1", "q"), ("d", "merge", "a0", "q"), ("e", "nonsense", None, "q")]
    answers = spark.createDataFrame([(keys[c]["key"], *x) for c, *x in said], "key string, verdict string, keeper string, reason string")
    outcomes, actions, kept = upkeep.gated(clusters, df, verdicts, answers, s, now, "m")
    assert {r["cluster"]: (r["outcome"], r["problem"], r["checked"]) for r in outcomes.collect()} == {
        "a": ("cached", None, False), "b": ("rejected", None, True), "c": ("merged", None, True), "d": ("failed", "keeper is no member", False),
        "e": ("failed", "unknown verdict", False), "f": ("failed", "no answer", False)}
    assert sorted((r["id"], r["superseding"]) for r in actions.collect()) == [("c0", "c1"), ("c2", "c1")]
    assert sorted(tuple(r) for r in kept.collect()) == sorted([held[0], held[3], (keys["b"]["key"], keys["b"]["content_hash"], now, "q")])
    outcomes, actions, kept = upkeep.gated(clusters, df, verdicts, answers, s, now, "m", dry_run=True)
    assert actions.count() == 0 and sorted(tuple(r) for r in kept.collect()) == sorted(held) and not any(r["checked"] for r in outcomes.collect())
