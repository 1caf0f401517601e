"""Predicates over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_filter(
    project: str | None = None, ancestors: list[str] | None = None, with_global: bool = False, kind: str | None = None,
    but: str | None = None, active: bool = False,
) -> Column:
    """Project (or its ancestors, or global scope), type, not this id, not deprecated: all that are given hold."""
    parts = []
    if project is not None:
        own = F.col("project").isin([project, *(ancestors or [])])
        parts.append(own | (F.col("scope") == "global") if with_global else own)
    if kind is not None:
        parts.append(F.col("type") == kind)
    if but is not None:
        parts.append(F.col("id") != but)
    if active:
        parts.append(~F.col("deprecated"))
    return reduce(Column.__and__, parts, F.lit(True))


def has_keyword(text: str, needles: list[str]) -> Column:
    """Whether any non-blank needle is in the text, whatever its case; without needles every row passes."""
    wanted = [n for n in needles if n.strip()]
    found = [F.lower(F.col(text)).contains(F.lower(F.lit(n))) for n in wanted]
    return reduce(Column.__or__, found) if found else F.lit(True)


def like_pattern(needle: str) -> str:
    """A LIKE pattern (escape character: backslash) for any text with the needle in it."""
    for sign in ("\\", "%", "_"):
        needle = needle.replace(sign, "\\" + sign)
    return f"%{needle}%"


def due(checked: Column, cutoff: int) -> Column:
    """Never checked, or checked before the cutoff."""
    return (checked == 0) | (checked < cutoff)


def ancestors(project: str, roots: list[str]) -> list[str]:
    """Known roots that are strict path prefixes of the project, nearest first."""
    above = [r for r in roots if project.startswith(r.rstrip("/") + "/")]
    return sorted(above, key=len, reverse=True)


def parents(path: Column) -> Column:
    """All strict parents of a path, nearest first, without the root."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def known_ancestors(projects: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, ancestor, place): the strict parents of each project that are known roots, nearest first."""
    rows = projects.select("project").distinct().select("project", F.posexplode(parents(F.col("project"))).alias("depth", "ancestor"))
    found = rows.join(roots.select(F.col("root").alias("ancestor")).distinct(), "ancestor", "left_semi")
    place = F.row_number().over(Window.partitionBy("project").orderBy("depth"))
    return found.select("project", "ancestor", place.alias("place"))
