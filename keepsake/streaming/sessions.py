"""Streams with state: a session's retrieval state, and new events of growing transcripts."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keepsake.settings import Settings

SESSION_STATE = "sessions array<string>, ids array<array<string>>, previous array<array<double>>, version array<long>, at array<long>"
BUCKETS = 2**12  # groups of sessions that share a state: a call costs milliseconds, however few sessions it has
Row = namedtuple("Row", ["session", "seq", "kind", "ids", "embedding", "expected", "ts_ms"])
EVENTS_STATE = "emissions long, last long, seqs array<long>, roles array<string>, texts array<string>"
SESSION_OUT = "session string, seq long, kind string, accepted boolean, version long, similarity double, cleared int, ids array<string>"
EVENTS_OUT = "key string, emission long, seq long, role string, text string, is_new boolean"


def refreshed(ids: list[str], new: list[str], window: int) -> list[str]:
    """The last `window` ids once `new` ones, trimmed and without blanks, are moved to the end."""
    if window <= 0:
        return []
    new = list(dict.fromkeys(x.strip() for x in new if x and x.strip()))
    return [*[x for x in ids if x not in set(new)], *new][-window:]


def likeness(a: list[float] | None, b: list[float] | None) -> float | None:
    """Cosine; 0 for zero vectors and different lengths, None without either."""
    if a is None or b is None or not len(a) or not len(b):
        return None
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(x) * np.linalg.norm(y) if len(x) == len(y) else 0.0
    return float(x @ y / size) if size else 0.0


def step(held: tuple, r: object, window: int, threshold: float) -> tuple[tuple, tuple]:
    """(state, (accepted, similarity, cleared)) after one event. The state: ids, embedding of the prompt before, version."""
    ids, previous, version = held
    expected = None if pd.isna(r.expected) else int(r.expected)
    accepted, near, cleared = expected is None or expected == version, None, 0
    if r.kind == "inject":
        if accepted:
            ids, version = refreshed(ids, [] if r.ids is None else list(r.ids), window), version + 1
        return (ids, previous, version), (accepted, near, cleared)
    near = likeness(r.embedding, previous) if window > 0 else None
    if near is not None and near < threshold:
        cleared, ids, version = len(ids), [], version + 1
    if accepted and r.embedding is not None:
        previous, version = [float(x) for x in r.embedding], version + 1
    return (ids, previous, version), (accepted, near, cleared)


def session_states(events: DataFrame, s: Settings, ttl_ms: int | None = None, late: str = "1 day") -> DataFrame:
    """Each event with the session's state after it. `events`: session, seq, kind (inject or prompt), ids, embedding, expected.

    An `inject` moves its ids to the end of the list. A `prompt` is compared with the one before: below the threshold
    the list is cleared; then its embedding is kept. A write that expects another version than there is is refused (a
    topic shift clears the list all the same). With `ttl_ms`, `events` has their time `ts` too, and a session is forgotten
    once the watermark, `late` behind the newest event, is so far past its last one; events before the watermark are lost.
    Times are those of events, as a stream that waits for the clock never ends over all there is. The states of the
    sessions of a bucket are held as one, as a call a session costs more than its events do.
    """
    window, threshold = s.recently_injected_window, s.topic_change_threshold

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = {x[0]: (list(x[1]), None if x[2] is None else list(x[2]), int(x[3]), int(x[4])) for x in zip(*state.get, strict=True)} if state.exists else {}
        out, came = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["session", "seq", "kind"])
            for r in map(Row._make, zip(*[rows[c].to_numpy(object) for c in Row._fields], strict=True)):
                *held, at = states.get(r.session, ([], None, 0, 0))
                held, said = step(tuple(held), r, window, threshold)
                states[r.session] = (*held, max(at, int(r.ts_ms)))
                came.add(r.session)
                out.append((r.session, r.seq, r.kind, said[0], held[2], said[1], said[2], held[0]))
        if ttl_ms is not None:  # sessions with new events stay, as the clock is looked at after them
            gone = state.getCurrentWatermarkMs()
            states = {k: x for k, x in states.items() if k in came or x[3] + ttl_ms >= gone}
        if not states:
            state.remove()
            return
        state.update(tuple(list(c) for c in zip(*[(k, *x) for k, x in states.items()], strict=True)))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(min(x[3] for x in states.values()) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session", "seq", "kind", "accepted", "version", "similarity", "cleared", "ids"])

    timed = events if ttl_ms is None else events.withWatermark("ts", late)
    rows = timed.select("session", "seq", "kind", "ids", "embedding", "expected", *([] if ttl_ms is None else ["ts"]), (F.lit(0) if ttl_ms is None else F.unix_millis("ts")).alias("ts_ms"))
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout
    bucket = F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(run, SESSION_OUT, SESSION_STATE, "append", timeout)


def growing_events(events: DataFrame, overlap: int) -> DataFrame:
    """New events of each key with the last `overlap` user turns before them; nothing where none are new.

    `events`: key, seq, role, text, in rising `seq` a key over the batches; what came already is not new again. A turn is
    held whole, so the buffer is as long as `overlap` turns.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        emissions, last, *buffer = state.get if state.exists else (0, None, [], [], [])
        tail = list(zip(*[list(b) for b in buffer], strict=True))
        new = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        new = [(int(r.seq), r.role, r.text) for r in new.itertuples() if last is None or r.seq > last]
        if not new:
            return
        out = [(key[0], emissions + 1, *x, False) for x in tail] + [(key[0], emissions + 1, *x, True) for x in new]
        every = tail + new
        users = [i for i, x in enumerate(every) if x[1] == "user"]
        start = len(every) if overlap <= 0 else users[-overlap] if len(users) >= overlap else 0
        state.update((emissions + 1, every[-1][0], *[[x[i] for x in every[start:]] for i in range(3)]))
        yield pd.DataFrame(out, columns=["key", "emission", "seq", "role", "text", "is_new"])

    rows = events.select("key", "seq", "role", "text")
    return rows.groupBy("key").applyInPandasWithState(run, EVENTS_OUT, EVENTS_STATE, "append", GroupStateTimeout.NoTimeout)
