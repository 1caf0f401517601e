"""Command lines: first segment, tokens, program and arguments; a JSON object out of free text. All as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tools that are taken to be there or to run what a project brings along, and options with a value
PACKAGE_MANAGERS = "npm pnpm yarn bun".split()
PROJECT_LOCAL = "npx tsx node python python3 uv uvx".split()
VALUE_OPTIONS = "-u -g -h -p -U".split()

# an escaped sign, a quoted run (to its end where it isn't closed), an operator, or plain signs
SHELL_PIECES = r"""(?s)\\.|'[^']*(?:'|$)|"(?:\\.|[^"\\])*+(?:"|\\?$)|&&|[;|]|[^;|&\\'"]++|."""
TOKENS = r"""(?s)"[^"]*"|'[^']*'|\S+"""
JSON_PIECES = r"""(?s)"(?:\\.|[^"\\])*+"|[{}]|[^"{}]++|\""""


def first_segment(line: Column) -> Column:
    """A command line up to its first ;, | or && outside quotes and escapes."""
    pieces = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(SHELL_PIECES), F.lit(0))
    ends = F.filter(F.transform(pieces, lambda x, i: F.when(x.isin(";", "|", "&&"), i)), lambda i: i.isNotNull())
    return F.trim(F.array_join(F.slice(pieces, 1, F.coalesce(F.array_min(ends), F.size(pieces))), ""))


def unquoted(token: Column) -> Column:
    return F.when((F.char_length(token) >= 2) & (token.rlike(r"""(?s)^".*"$""") | token.rlike(r"(?s)^'.*'$")), F.substr(token, F.lit(2), F.char_length(token) - 2)).otherwise(token)


def parsed(line: Column) -> Column:
    """A struct: `program` (null without one) and `args` of a command line's first segment.

    Assignments, sudo and env, and the options of these two (with the value of those that take one), are skipped.
    """
    tokens = F.transform(F.regexp_extract_all(first_segment(line), F.lit(TOKENS), F.lit(0)), unquoted)
    state = lambda at, found, options, skip: F.struct(at.alias("at"), found.alias("found"), options.alias("options"), skip.alias("skip"))

    def move(s: Column, t: Column) -> Column:
        option = s["options"] & t.startswith("-")
        passed = (t == "") | t.isin("sudo", "env") | t.rlike(r"(?s)^[A-Za-z_][A-Za-z0-9_]*=")
        found = F.when((s["found"] >= 0) | s["skip"] | option | passed, s["found"]).otherwise(s["at"])
        return state(
            s["at"] + 1, found, F.when(s["skip"] | option, s["options"]).otherwise(t.isin("sudo", "env")), ~s["skip"] & option & t.isin(VALUE_OPTIONS)
        )

    at = F.aggregate(tokens, state(F.lit(0), F.lit(-1), F.lit(False), F.lit(False)), move)["found"]
    rest = F.filter(F.slice(tokens, at + 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: t != "")
    return F.struct(F.when(at >= 0, F.get(tokens, at)).alias("program"), F.when(at >= 0, rest).otherwise(F.array().cast("array<string>")).alias("args"))


def project_local(program: Column) -> Column:
    """Whether a program is a path, or a tool that runs what the project brings along."""
    return F.coalesce(program.contains("/") | program.isin(PACKAGE_MANAGERS + PROJECT_LOCAL), F.lit(False))


def json_object(text: Column) -> Column:
    """The first whole JSON object of a free text, as JSON; null where the first { begins none.

    Braces inside strings don't count. A text is cut into strings, braces and what lies between, and the depth
    followed over these.
    """
    start = F.instr(text, "{")
    pieces = F.regexp_extract_all(F.substr(text, start, F.char_length(text)), F.lit(JSON_PIECES), F.lit(0))
    state = lambda n, depth, done: F.struct(n.alias("n"), depth.alias("depth"), done.alias("done"))

    def move(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return state(F.when(s["done"], s["n"]).otherwise(s["n"] + 1), F.when(s["done"], s["depth"]).otherwise(depth), s["done"] | (depth == 0))

    end = F.aggregate(pieces, state(F.lit(0), F.lit(0), F.lit(False)), move)
    whole = F.array_join(F.slice(pieces, 1, F.greatest(end["n"], F.lit(1))), "")
    return F.when((start > 0) & end["done"] & F.json_object_keys(whole).isNotNull(), F.get_json_object(whole, "$"))
