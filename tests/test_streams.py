"""Streams with state and streamed ingest, each against its batch form."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from keepsake.operators import runs, writes
from keepsake.settings import Settings
from keepsake.streaming import ingesting, sessions

EVENTS = "session string, seq long, kind string, ids array<string>, embedding array<double>, expected long, ts timestamp"


def started(spark, rows, schema, parts, folder):
    for part in parts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ran(stream, out):
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows").collect()


def replay(rows, window, threshold):
    """One session after another, in plain Python."""
    state, out = {}, {}
    for session, seq, kind, ids, e, expected, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        s = state.setdefault(session, {"ids": [], "prev": None, "v": 0})
        ok, near, cleared = expected is None or expected == s["v"], None, 0
        if kind == "inject":
            if ok:
                for i in dict.fromkeys(x.strip() for x in ids if x and x.strip()):
                    s["ids"] = [x for x in s["ids"] if x != i] + [i]
                s["ids"], s["v"] = s["ids"][-window:], s["v"] + 1
        else:
            if s["prev"] is not None and e is not None:
                near = float(np.dot(e, s["prev"]) / (np.linalg.norm(e) * np.linalg.norm(s["prev"])))
                if near < threshold:
                    cleared, s["ids"], s["v"] = len(s["ids"]), [], s["v"] + 1
            if ok and e is not None:
                s["prev"], s["v"] = e, s["v"] + 1
        out[session, seq] = (ok, s["v"], None if near is None else round(near, 9), cleared, list(s["ids"]))
    return out


def session_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        kind = "inject" if rng.random() < 0.6 else "prompt"
        ids = [str(rng.choice(["a", " a ", "b", "c", "d", "e", "", None])) if rng.random() < 0.9 else None for _ in range(rng.integers(0, 4))]
        expected = int(rng.integers(0, 12)) if rng.random() < 0.4 else None
        rows.append((f"s{rng.integers(3)}", i, kind, ids if kind == "inject" else None, rng.normal(size=3).tolist() if kind == "prompt" else None, expected, datetime(2024, 1, 1) + timedelta(minutes=i)))
    return rows


def test_session_states_equal_a_replay(spark, tmp_path):
    rows = session_rows()
    s = Settings(recently_injected_window=3, topic_change_threshold=0.2)
    stream = started(spark, rows, EVENTS, [range(25), range(25, 26), range(26, 60)], str(tmp_path / "in"))
    got = {(r.session, r.seq): (r.accepted, r.version, None if r.similarity is None else round(r.similarity, 9), r.cleared, list(r.ids)) for r in ran(sessions.session_states(stream, s), str(tmp_path))}
    want = replay(rows, 3, 0.2)
    assert got == want
    assert any(not x[0] for x in want.values()) and any(x[3] for x in want.values()), "stale writes and topic shifts are hit"


def test_a_session_is_forgotten_after_its_time(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [("s", 1, "inject", ["a"], None, None, day(0)), ("t", 2, "inject", ["b"], None, None, day(40)), ("t", 3, "inject", ["c"], None, None, day(41)), ("s", 4, "inject", ["d"], None, None, day(42))]
    stream = started(spark, rows, EVENTS, [[0], [1], [2], [3]], str(tmp_path / "in"))
    got = {r.seq: (r.version, list(r.ids)) for r in ran(sessions.session_states(stream, Settings(), ttl_ms=30 * 86_400_000), str(tmp_path))}
    assert got == {1: (1, ["a"]), 2: (1, ["b"]), 3: (2, ["b", "c"]), 4: (1, ["d"])}


def test_sessions_of_a_bucket_share_a_state_and_are_told_apart(spark, tmp_path, monkeypatch):
    """One bucket: each session has its own list, version and end of life, and one state row is held for all."""
    monkeypatch.setattr(sessions, "BUCKETS", 1)
    rows = session_rows()
    s = Settings(recently_injected_window=3, topic_change_threshold=0.2)
    stream = started(spark, rows, EVENTS, [range(25), range(25, 26), range(26, 60)], str(tmp_path / "in"))
    got = {(r.session, r.seq): (r.accepted, r.version, None if r.similarity is None else round(r.similarity, 9), r.cleared, list(r.ids)) for r in ran(sessions.session_states(stream, s), str(tmp_path))}
    assert got == replay(rows, 3, 0.2)
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() == 1
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [("s", 1, "inject", ["a"], None, None, day(0)), ("t", 2, "inject", ["b"], None, None, day(40)), ("t", 3, "inject", ["c"], None, None, day(41)), ("s", 4, "inject", ["d"], None, None, day(42))]
    stream = started(spark, rows, EVENTS, [[0], [1], [2], [3]], str(tmp_path / "in2"))
    got = {r.seq: (r.version, list(r.ids)) for r in ran(sessions.session_states(stream, Settings(), ttl_ms=30 * 86_400_000), str(tmp_path / "timed"))}
    assert got == {1: (1, ["a"]), 2: (1, ["b"]), 3: (2, ["b", "c"]), 4: (1, ["d"])}


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_growing_events_equal_the_batch_form(spark, tmp_path, overlap):
    rng = np.random.default_rng(overlap)
    rows = [(k, i, str(rng.choice(["user", "assistant", "tool"])), f"{k}{i}") for i in range(14) for k in "xyz"]
    cuts = [rows[:12], [r for r in rows[12:24] if r[0] != "z"], rows[24:]]
    order = [r for c in cuts for r in c]
    schema = "key string, seq long, role string, text string"
    parts, at = [], 0
    for c in cuts:
        parts.append(range(at, at + len(c)))
        at += len(c)
    got = ran(sessions.growing_events(started(spark, order, schema, parts, str(tmp_path / "in")), overlap), str(tmp_path))
    want, done, times = set(), [], {}
    for c in cuts:
        consumed = pd.DataFrame(done, columns=["key", "seq", "role", "text"]).groupby("key").size().reset_index(name="n") if done else pd.DataFrame({"key": ["none"], "n": [0]})
        done += c
        found = runs.new_events(spark.createDataFrame(done, schema), spark.createDataFrame(consumed), overlap, "key", "seq").collect()
        for k in {r.key for r in found}:
            times[k] = times.get(k, 0) + 1
        want |= {(r.key, times[r.key], r.seq, r.role, r.text, r.is_new) for r in found}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


TABLE = "id string, project string, type string, scope string, embedding array<double>, same_as string, success_count long, failure_count long, deprecated boolean, seq long"


def record(i, rng, seq):
    return (f"r{i:03}", None if i % 7 == 0 else "ab"[i % 2], "x", "global" if i % 5 == 0 else "project", rng.normal(size=3).tolist(), f"h{i % 3}", i % 3, i % 2, False, seq)


def test_streamed_ingest_equals_one_run_and_a_replay_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(8)
    old = spark.createDataFrame([record(i, rng, None) for i in range(15)], TABLE)
    rows = [record(i, rng, i) for i in range(15, 60)]
    s, path = Settings(dedup_threshold=0.8), str(tmp_path / "table")
    stream = started(spark, rows, TABLE, [range(15), range(15, 30), range(30, 45)], str(tmp_path / "in"))
    ingesting.ingest_stream(stream, old, path, str(tmp_path / "cp"), s).awaitTermination()
    seen = lambda: sorted((r.id, r.action, r.target, None if r.similarity is None else round(r.similarity, 9)) for r in ingesting.actions(spark, path).collect())
    got = seen()
    one = writes.ingest(spark.createDataFrame(rows, TABLE), old, s).collect()
    assert got == sorted((r.id, r.action, r.target, None if r.similarity is None else round(r.similarity, 9)) for r in one)
    assert {a for _, a, _, _ in got} >= {"insert", "update"}
    before = sorted(ingesting.as_of(old, path, 3).select("id", "project", "scope", "success_count", "failure_count").collect())
    ingesting.ingest_batch(spark.createDataFrame(rows[15:30], TABLE), old, path, 1, s)
    assert seen() == got and sorted(ingesting.as_of(old, path, 3).select("id", "project", "scope", "success_count", "failure_count").collect()) == before
    counts = {r.id: r.success_count for r in old.collect()} | {r[0]: r[6] for r in rows if (r[0], "insert") in {(i, a) for i, a, *_ in got}}
    for i, a, t, _ in got:
        if a == "update":
            counts[t] += next(r[6] for r in rows if r[0] == i)
    assert {r[0]: r[3] for r in before} == counts
    assert ingesting.as_of(old, str(tmp_path / "none"), 2).count() == 15
