"""Text functions as Columns: keywords, entities, snippets, slugs, commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no meaning as keywords
STOPWORDS = (
    "a about advice an and anything are as at be but by can check code command config continue could data did do does e.g error "
    "explain file find for from get got had has have help how i i.e if in into is it issue know make me my need needs no of ok "
    "okay on or our output please problem project remember run save should skill status stuff tell that the their them then "
    "there these they thing things this those to use used using was we were what whats when where which who why with without "
    "would yes you your"
).split()
SHORT_TECH = "api dns ip jq k8s sql ssh tcp udp".split()
# fixed values: entities that tell nothing, and the pattern of a token
GENERIC_ENTITIES = "git npm pnpm node npx bash zsh shell linux file server error command config json http https".split()
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}._:/@+-]*[\p{L}\p{N}\p{M}])?"


def composed(text: Column) -> Column:
    """A text in Unicode's composed form (NFC), by the library in Spark's own jars."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def keywords(text: Column) -> Column:
    """Lower-cased distinct tokens worth searching for, in order of appearance."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def worth(t: Column) -> Column:
        low, n = F.lower(t), F.char_length(t)
        capital = (n >= 3) & t.rlike(r"^\p{Lu}")
        return ~low.isin(STOPWORDS) & (
            low.isin(SHORT_TECH) | capital | t.rlike(r"\d") | t.rlike(r"[/:\\]") | t.rlike(r"\.[A-Za-z0-9]+") | (t.rlike(r"^[\p{Ll}\p{M}]+$") & (n >= 4))
        )

    return F.array_distinct(F.transform(F.filter(tokens, worth), lambda t: F.lower(t)))


def entity(raw: Column) -> Column:
    """A canonical entity: outer quotes and trailing marks off, lower case, 3 to 120 characters, with a letter; else null."""
    bare = F.lower(F.regexp_replace(raw, r"^[\s\"'`]+|[\s\"'`.,:;]+$", ""))
    return F.when(F.char_length(bare).between(3, 120) & bare.rlike(r"\p{L}") & ~bare.isin(GENERIC_ENTITIES), bare)


def entity_of_token(token: Column) -> Column:
    """`entity` of a token of TOKEN, which begins and ends with no sign that comes off."""
    low = F.lower(token)
    return F.when(F.char_length(low).between(3, 120) & low.rlike(r"\p{L}") & ~low.isin(GENERIC_ENTITIES), low)


def long_words(text: Column, n: int = 8) -> Column:
    """Distinct lower-case words of at least n letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}]{{{n},}}"), F.lit(0)))


def snippet(text: Column, n: int = 120) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(one) <= n, one).otherwise(F.concat(F.substring(one, 1, n - 3), F.lit("...")))


def head_and_tail(text: Column, n: int) -> Column:
    """Both ends of a text that is longer than n."""
    head = (n + 1) // 2
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, head), F.substring(text, -(n - head), n - head)))


def slug(text: Column, n: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, n)


def executable(command: Column) -> Column:
    """The program of a command line's first part: leading assignments, sudo and env (and their options) are skipped."""
    first = F.trim(F.regexp_replace(F.split(command, r"&&|\|\||[;|]").getItem(0), r"^\s*(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|sudo|env)\s+(?:-\S+\s+)*)*", ""))
    return F.regexp_extract(first, r"^[\"']?([^\s\"']+)", 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 1 for two empty arrays."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def canonical_needles(raw: Column, planned: Column) -> Column:
    """Planned needles that no raw needle equals (whatever its case), once each."""
    low = F.transform(raw, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(F.transform(planned, lambda x: F.trim(x)), lambda x: (x != "") & ~F.array_contains(low, F.lower(x))))


def without_noise(text: Column) -> Column:
    """A prompt without fenced code, markup tags and addresses; runs of white space are one blank."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"<[^<>]{1,200}>", " "), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def step(text: Column) -> Column:
    """A step without its number or bullet."""
    return F.trim(F.regexp_replace(text, r"^\s*(?:step\s+\d+\s*[:.)-]|\d+\s*[.):-]|[-*•])\s*", ""))


def yaml_quoted(text: Column) -> Column:
    """A YAML scalar in double quotes."""
    safe = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), F.regexp_replace(safe, r"\r?\n", " "), F.lit('"'))


def path_key(path: Column) -> Column:
    """A path as a file name: every sign but letters, digits, dot, underscore and dash becomes a dash."""
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]", "-")
