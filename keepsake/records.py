"""Payload parsing, validity, derived texts, rendering and small record functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.schema import PAYLOAD

MAX_ENTRY_CHARS, MAX_STEPS, MAX_STEP_CHARS = 1500, 5, 400


def parse_payload(df: DataFrame, content: str = "content") -> DataFrame:
    """`payload` from JSON; a payload that can't be read is null."""
    return df.withColumn("payload", F.from_json(content, PAYLOAD, {"mode": "PERMISSIVE"}))


def present(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value)) > 0, F.lit(False))


def is_valid(kind: Column, payload: Column) -> Column:
    """Whether the fields that a record of this type needs are there."""
    p = payload
    steps = F.coalesce(F.exists(p["steps"], present), F.lit(False))
    return (
        F.when(kind == "command", present(p["command"]) & p["exitCode"].isNotNull() & p["outcome"].isin("success", "failure", "partial") & p["context"].isNotNull())
        .when(kind == "error", present(p["errorText"]) & present(p["errorType"]) & present(p["resolution"]) & p["context"].isNotNull())
        .when(kind == "discovery", present(p["what"]) & present(p["where"]) & present(p["evidence"]) & present(p["confidence"]))
        .when(kind == "procedure", present(p["name"]) & steps & p["context"].isNotNull())
        .when(kind == "warning", present(p["avoid"]) & present(p["useInstead"]) & present(p["reason"]) & present(p["severity"]))
        .otherwise(False)
    )


def exact_text(kind: Column, payload: Column) -> Column:
    p, lines = payload, lambda *c: F.concat_ws("\n", *c)
    return (
        F.when(kind == "command", p["command"]).when(kind == "error", p["errorText"]).when(kind == "discovery", lines(p["what"], p["where"]))
        .when(kind == "procedure", lines(p["name"], F.array_join(p["steps"], "\n"))).when(kind == "warning", lines(p["avoid"], p["useInstead"], p["reason"]))
    )


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def rendered(kind: Column, payload: Column) -> Column:
    """One line a record, by type, at most MAX_ENTRY_CHARS long."""
    p = payload

    def part(name: str, value: Column) -> Column:
        return F.when(present(value), F.concat(F.lit(f"{name}: "), one_line(value)))

    steps = F.array_join(F.transform(F.slice(p["steps"], 1, MAX_STEPS), lambda s: cut(one_line(s), MAX_STEP_CHARS)), "; ")
    text = (
        F.when(kind == "command", F.concat_ws(" | ", part("command", p["command"]), part("outcome", p["outcome"]), part("exit", p["exitCode"].cast("string")), part("last result", p["resolution"])))
        .when(kind == "error", F.concat_ws(" | ", part("error", p["errorText"]), part("resolution", p["resolution"]), part("cause", p["cause"])))
        .when(kind == "discovery", F.concat_ws(" | ", part("discovery", p["what"]), part("where", p["where"]), part("confidence", p["confidence"])))
        .when(kind == "procedure", F.concat_ws(" | ", part("procedure", p["name"]), F.concat(F.lit("steps: "), steps), part("verify", p["verification"])))
        .when(kind == "warning", F.concat_ws(" | ", F.concat(F.lit("warning: Don't "), one_line(p["avoid"])), part("use instead", p["useInstead"]), part("reason", p["reason"])))
    )
    return cut(text, MAX_ENTRY_CHARS)


def relative_age(ms: Column, now: int) -> Column:
    """mo, w, d, h, m (over five minutes) or 'just now'; null for 0, null and future times."""
    minutes = F.floor((F.lit(now) - ms) / 60_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(ms.isNull() | (ms == 0) | (ms > now), F.lit(None).cast("string"))
        .when(days >= 30, ago(F.floor(days / 30), "mo")).when(days >= 7, ago(F.floor(days / 7), "w")).when(days > 0, ago(days, "d"))
        .when(hours > 0, ago(hours, "h")).when(minutes > 5, ago(minutes, "m")).otherwise("just now")
    )


def usage_ratio(usage: Column, retrieval: Column) -> Column:
    return F.when(usage <= 0, 0.0).otherwise(F.least(usage / F.greatest(retrieval, F.lit(1)), F.lit(1.0)))


def tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null and empty."""
    return F.coalesce(F.ceil(F.char_length(text) / 4), F.lit(0)).cast("long")
