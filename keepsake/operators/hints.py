"""Hints that a session leaves when it writes a note of its own: fields of bounded length, some out of a front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the bounds of a stored hint, in characters
CONTENT, TAIL, MARKER = 12_000, 2_000, "\n...[truncated]...\n"
SESSION, NAME, DESCRIPTION, KIND, TOOL_ID = 1_000, 1_000, 4_000, 500, 1_000
HEAD = 20_000  # a front matter begins a text and ends within so many characters
LATEST_MS = 8_640_000_000_000_000
FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---(?:[ \t]*\r?\n|[ \t]*\z)"
FIELD = r"^([A-Za-z0-9_.-]+)\s*:\s*(.*)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def bounded(text: Column, most: int) -> Column:
    """The stripped text, its end cut to three dots where it is longer than `most`; null where nothing is left."""
    t = stripped(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).when(F.char_length(t) > 0, t)


def both_ends(text: Column) -> Column:
    """A text of at most `CONTENT` characters: head, marker and the last `TAIL` of a longer one."""
    head = CONTENT - len(MARKER) - TAIL
    return F.when(F.char_length(text) <= CONTENT, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(MARKER), F.substring(text, -TAIL, TAIL)))


def scalar(text: Column) -> Column:
    """A stripped value without a pair of equal quotes around it."""
    t = stripped(text)
    quoted = (F.char_length(t) >= 2) & (t.rlike(r'^".*"\z') | t.rlike(r"^'.*'\z"))
    return F.when(quoted, stripped(F.substr(t, F.lit(2), F.char_length(t) - 2))).otherwise(t)


def front_matter(content: Column) -> Column:
    """struct(name, description, kind) of the front matter that begins a text; nulls where there is none.

    Name and description count on the outer level only, the kind as `metadata.type` or as `type` in a block `metadata:`.
    Of repeated fields the last one that isn't empty counts; blank lines, remarks and what is no field are skipped.
    """
    text = F.regexp_replace(F.substring(content, 1, HEAD), "^\ufeff", "")
    lines = F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n")
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("inside"), none.alias("name"), none.alias("description"), none.alias("kind"))

    def step(state: Column, raw: Column) -> Column:
        line, outer = stripped(raw), ~raw.rlike(r"^\s")
        known = line.rlike(FIELD)
        key, value = F.regexp_extract(line, FIELD, 1), scalar(F.regexp_extract(line, FIELD, 2))
        inside = F.when(known & outer, (key == "metadata") & (value == "")).otherwise(state["inside"])
        kept = lambda name, here: F.when(known & here & (value != ""), value).otherwise(state[name]).alias(name)
        return F.struct(
            inside.alias("inside"), kept("name", outer & (key == "name")), kept("description", outer & (key == "description")),
            kept("kind", (key == "metadata.type") | (inside & (key == "type"))),
        )

    return F.aggregate(lines, start, step)


def write_hints(calls: DataFrame) -> DataFrame:
    """(session, ts_ms, tool_id, name, description, kind, content, truncated) of the calls that write a note.

    `calls`: session_id, tool_use_id, tool_input (JSON), ts_ms; further columns stay. The input's own strings come before those
    of the front matter of its `content`, the path is the last choice for a name and `memory_write` the name of what has none.
    Without a string `content` the input's JSON is the content. Values that are no strings count as missing, a
    tool_input that is missing or no JSON gives `null` as content. Calls without a session, or with no time between 0
    and the last one a calendar can hold, are left out. Lengths are code points.
    """
    v = F.expr("try_parse_json(tool_input)")
    own = lambda path: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(__v, '$.{path}', 'variant')) = 'STRING' THEN try_variant_get(__v, '$.{path}', 'string') END")
    rows = calls.withColumn("__v", v).withColumn("__text", own("content"))
    rows = rows.withColumn("__front", front_matter(F.coalesce("__text", F.lit(""))))
    first = lambda most, *found: F.coalesce(*[bounded(c, most) for c in found])
    front = lambda c: F.col(f"__front.{c}")
    raw = F.coalesce(F.col("__text"), F.when(F.col("__v").isNotNull(), F.col("tool_input")), F.lit("null"))
    fields = {
        "session": bounded(F.col("session_id"), SESSION),
        "tool_id": bounded(F.col("tool_use_id"), TOOL_ID),
        "name": F.coalesce(first(NAME, own("name"), front("name"), own("path")), F.lit("memory_write")),
        "description": first(DESCRIPTION, own("description"), front("description")),
        "kind": first(KIND, own("metadata.type"), own("nativeMemoryType"), own("type"), front("kind")),
        "content": both_ends(raw),
        "truncated": F.char_length(raw) > CONTENT,
    }
    given = ("session_id", "tool_use_id", "tool_input")
    more = [c for c in calls.columns if c not in given and c not in fields]
    return rows.select(*more, *[value.alias(name) for name, value in fields.items()]).where(F.col("session").isNotNull() & F.col("ts_ms").between(0, LATEST_MS))


def loaded(hints: DataFrame) -> DataFrame:
    """A session's hints with one row a tool call, the earliest (ts_ms, name, content); those without a call all stay."""
    named = hints.where("tool_id is not null")
    first = named.groupBy("session", "tool_id").agg(F.min_by(F.struct(*hints.columns), F.struct("ts_ms", "name", "content")).alias("x"))
    return first.select("x.*").unionByName(hints.where("tool_id is null"))
