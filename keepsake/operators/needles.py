"""Needles: which words of a prompt to look for, and many of them against many texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.runtime import written

GRAM, FREQUENT = 3, 100_000  # texts with a trigram beyond which it is used together with another one only
LITERAL = 32  # needles up to which each text is simply searched for all
RUN_GRAM, SOUGHT = 6, 500_000  # code points of the runs of letters that pieces are looked up by; grams of needles that may be broadcast
LETTERS, OTHERS = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
FIRST, GROWTH, SAMPLE = 8192, 8, 4096  # texts in the first part that the first matches are looked for in, its growth, and ids that tell where parts end
ENTITY_NEEDLES = 3


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n code points of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def pieces(low: Column) -> Column:
    """The maximal runs of letters and digits of a text, and those of other signs."""
    return F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in (LETTERS, OTHERS)])


def matches(texts: DataFrame, needles: DataFrame, text: str = "exact_text", frequent: int = FREQUENT, literal: int = LITERAL, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, needle, by): each text with each needle it holds, whatever the case. `texts`: id, text, by; `needles`: needle, by.

    With `by`, needles are looked for only in texts that are equal in these columns. A text is cut into its runs of letters
    and digits and of other signs; a run of a needle lies inside one of them. So each distinct run of all texts, not each
    text, is looked at for the needles' runs, and what is found goes back to the texts by the posting lists of the runs.
    Only runs as long as the shortest of the needles' longest runs are listed, and needles that are more than one run go by
    the run that the fewest texts hold and are verified whole. Needles whose runs are all shorter than three code points meet
    the texts themselves, by the trigrams (or shorter, by the runs of one or two code points) they hold. Null and blank
    needles match nothing. As few as `literal` needles are looked for in each text where it is read, without any list.
    """
    wanted = needles.where(F.trim("needle") != "").select("needle", F.lower("needle").alias("low"), *by).distinct()
    longest = F.array_max(F.transform(pieces(F.col("low")), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("piece"))))
    wanted = written(wanted.withColumn("x", longest).select("needle", "low", "x.n", "x.piece", *by), "needles")
    known = wanted.agg(F.min(F.when(F.col("n") >= GRAM, F.col("n"))), F.count(F.when(F.col("n") < GRAM, 1)), F.count(F.when((F.col("n") >= GRAM) & (F.col("low") != F.col("piece")), 1))).first()
    least, short, mixed = known
    low = texts.select("id", F.lower(text).alias("low"), *by)
    if (few := _few(wanted, literal, by)) is not None:
        return _read_for(low, few, by)
    parts = []
    if short:
        shortest = wanted.where(F.col("n") < GRAM).select("needle", "low", *by)
        few = _few(shortest, literal, by)
        parts.append(_containing(low, shortest, GRAM, frequent, by) if few is None else _read_for(low, few, by))
    if least is not None:
        long = wanted.where(F.col("n") >= GRAM)
        of_least = lambda x: F.array_distinct(F.filter(pieces(x), lambda y: F.char_length(y) >= least))
        postings = written(low.select("id", F.explode(of_least(F.col("low"))).alias("run"), *by), "runs")
        each = written(postings.groupBy("run", *by).agg(F.count("*").alias("df")), "distinct-runs")
        chosen = long.where(F.col("low") == F.col("piece")).select("needle", "low", "piece", *by)
        several = long.where(F.col("low") != F.col("piece")).select("needle", "low", F.explode(of_least(F.col("low"))).alias("piece"), *by)
        sought = chosen.unionByName(several).select(F.col("piece").alias("needle"), F.col("piece").alias("low"), *by).distinct()
        inside = _containing(each.select(F.col("run").alias("id"), F.col("run").alias("low"), *by), sought, RUN_GRAM, frequent, by)
        inside = inside.select(F.col("id").alias("run"), F.col("needle").alias("piece"), *by)
        if mixed:
            inside = written(inside, "inside")
            held_by = inside.join(several.select("piece", *by).distinct(), ["piece", *by], "left_semi").join(each, ["run", *by]).groupBy("piece", *by).agg(F.sum("df").alias("df"))
            every = several.join(held_by, ["piece", *by], "left").groupBy("needle", "low", *by).agg(F.min(F.struct("df", "piece")).alias("x"))
            # a run that no text holds comes first, as null
            rarest = every.where(F.col("x.df").isNotNull()).select("needle", "low", "x.piece", *by)
            chosen = written(chosen.unionByName(rarest), "chosen")
            inside = inside.join(chosen.select("piece", *by).distinct(), ["piece", *by], "left_semi")
        held = postings.join(inside, ["run", *by]).select("id", "piece", *by).distinct()
        held = written(held, "held") if mixed else held
        parts.append(held.join(chosen.where(F.col("low") == F.col("piece")).select("piece", "needle", *by), ["piece", *by]).select("id", "needle", *by))
        if mixed:
            # written first, so that texts are not shuffled where few are to be verified
            maybe = held.join(chosen.where(F.col("low") != F.col("piece")).select("piece", "needle", F.col("low").alias("wanted"), *by), ["piece", *by])
            maybe = written(maybe.select("id", "needle", "wanted", *by), "candidates")
            parts.append(maybe.join(low, ["id", *by]).where(F.contains("low", "wanted")).select("id", "needle", *by))
    return reduce(DataFrame.unionByName, parts, low.select("id", F.lit("").alias("needle"), *by).where("false"))


def _few(wanted: DataFrame, literal: int, by: tuple[str, ...]) -> dict[str, list[Row]] | None:
    """The rows of each needle, if these are at most `literal` needles and there are few rows of each."""
    rows = wanted.select("needle", *by).limit(8 * literal + 1).collect()
    needles = {r["needle"]: [x for x in rows if x["needle"] == r["needle"]] for r in rows}
    return needles if needles and len(needles) <= literal and len(rows) <= 8 * literal else None


def _read_for(low: DataFrame, few: dict[str, list[Row]], by: tuple[str, ...]) -> DataFrame:
    """(id, needle, by): a few needles looked for in each text (id, low, by) where it is read."""
    there = lambda rows: reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == F.lit(r[c]) for c in by]) for r in rows]) if by else F.lit(True)
    held = [F.when(there(rows) & F.contains("low", F.lower(F.lit(needle))), F.lit(needle)) for needle, rows in few.items()]
    return low.select("id", F.explode(F.array_compact(F.array(*held))).alias("needle"), *by)


def _containing(texts: DataFrame, wanted: DataFrame, gram: int, frequent: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, needle, by): texts (id, low, by) that hold needles (needle, low, by) and equal them in `by`, all in lower case and distinct.

    Each needle meets only texts with its rarest run of `gram` code points (a shorter needle: with itself), and, where
    more than `frequent` texts have that one, with its second rarest too; those are verified whole, unless the run is the
    needle. Posting lists hold only what some needle has, once a text.
    """
    wanted = written(wanted.withColumn("n", F.least(F.char_length("low"), F.lit(gram))), "wanted")
    one_of = lambda low, n: F.coalesce(*[F.when(n == i, grams(low, i)) for i in range(1, gram + 1)])
    of_needle, key = wanted.withColumn("gram", F.explode(one_of(F.col("low"), F.col("n")))), ["gram", *by]
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most `gram` numbers
    every = texts.select("id", F.explode(F.concat(*[grams(F.col("low"), n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("gram"), *by)
    sought = of_needle.select(*key).distinct()
    few = sought.limit(SOUGHT + 1).count() <= SOUGHT
    postings = written(every.join(F.broadcast(sought) if few else sought, key, "left_semi"), "postings")

    counted = of_needle.join(postings.groupBy(*key).agg(F.count("*").alias("df")), key, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("df", "gram"))), 1, 2)  # a needle is short
    keyed = counted.groupBy("needle", "low", *by).agg(rarest.alias("r")).select("needle", "low", F.col("r")[0]["gram"].alias("gram"), F.col("r")[0]["df"].alias("df"), F.get("r", F.lit(1))["gram"].alias("second"), *by)
    keyed = written(keyed.where("df > 0"), "needle-grams")
    itself = F.col("gram") == F.col("low")
    sure = keyed.where(itself).join(postings, key).select("id", "needle", *by)
    alone = (F.col("df") <= frequent) | F.col("second").isNull()
    one = keyed.where(~itself & alone).join(postings, key).select("id", "needle", "low", *by)
    pairs = keyed.where(~itself & ~alone).select(*key, "second").distinct()
    both = pairs.join(postings, key).join(postings.select("id", F.col("gram").alias("second"), *by), ["id", "second", *by], "left_semi")
    two = keyed.where(~itself & ~alone).join(both, [*key, "second"]).select("id", "needle", "low", *by)
    maybe = one.unionByName(two)
    if lengths and lengths[-1] == gram:  # else all needles are their own runs
        sure = sure.unionByName(maybe.join(texts.withColumnRenamed("low", "whole"), ["id", *by]).where(F.contains("whole", "low")).select("id", "needle", *by))
    return sure


def first_matches(texts: DataFrame, needles: DataFrame, most: int, text: str = "exact_text", literal: int = LITERAL) -> DataFrame:
    """(needle, group, id): of each needle and each group it is wanted in the first `most` texts by id that hold it.

    `texts`: id, group, text, one row for each group that a text is in; `needles`: needle, group. Texts are looked at in
    ascending order of id, in parts that are each GROWTH - 1 times as large as all before. A needle that has its `most` texts
    of a group is not looked for in that group any more, so a frequent needle meets few texts, and one that goes on is
    so rare that a part of texts in mixed order holds it about GROWTH * most times. As few as `literal` needles are looked for in one part.
    """
    left = written(needles.where(F.trim("needle") != "").where(F.col("group").isNotNull()).select("needle", "group").distinct(), "needles-of-groups")
    ends = _ends(texts) if left.select("needle").distinct().limit(literal + 1).count() > literal else []
    place = F.row_number().over(Window.partitionBy("needle", "group").orderBy("id"))
    first = lambda rows: rows.withColumn("__place", place).where(F.col("__place") <= most).select("needle", "group", "id")
    parts: list[DataFrame] = []
    for after, end in zip([None, *ends], [*ends, None], strict=True):
        inside = (F.lit(True) if after is None else F.col("id") >= F.lit(after)) & (F.lit(True) if end is None else F.col("id") < F.lit(end))
        parts.append(written(first(matches(texts.where(inside), left, text, literal=literal, by=("group",))), "first-matches"))
        if end is not None:
            full = reduce(DataFrame.unionByName, parts).groupBy("needle", "group").agg(F.count("*").alias("n")).where(F.col("n") >= most)
            left = written(left.join(full, ["needle", "group"], "left_anti"), "needles-of-groups")
    return parts[0] if len(parts) == 1 else first(reduce(DataFrame.unionByName, parts))


def _ends(texts: DataFrame) -> list:
    """Ids at which the parts of `first_matches` but the last end: about those of row FIRST, FIRST * GROWTH and so on, by some SAMPLE of the ids."""
    rows = texts.count()
    if rows <= 2 * FIRST:
        return []
    some = sorted(r["id"] for r in texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // SAMPLE))) == 0).select("id").collect())
    at, ends = FIRST, []
    while 2 * at < rows and some:
        ends.append(some[at * len(some) // rows])
        at *= GROWTH
    return sorted(set(ends))


def entity_needles(prompts: DataFrame, vocabulary: DataFrame | None = None, most: int = ENTITY_NEEDLES, text: str = "text") -> DataFrame:
    """(prompt, needle, tier, place): entities of each prompt, at most `most`, by tier and place. `vocabulary`: entity.

    Tiers: paths and dotted names; acronyms and proper nouns; compounds with hyphen or underscore; tokens with a
    digit; other words that are entities of some record, which a join with the vocabulary tells. The first token of an
    entity that any tier takes counts. Texts are read in Unicode's composed form.
    """
    tokens = F.regexp_extract_all(tx.composed(F.coalesce(F.col(text), F.lit(""))), F.lit(tx.TOKEN), F.lit(0))
    t, n = F.col("token"), F.char_length("token")
    tier = (
        F.when(~t.rlike(r"[^\p{Ll}]"), None)  # most tokens: small letters alone
        .when(t.rlike(r"[/:\\]|\.[A-Za-z0-9]"), 0).when((n >= 3) & t.rlike(r"^\p{Lu}"), 1).when(t.rlike(r"\p{L}[-_]\p{L}"), 2).when(t.rlike(r"[0-9]"), 3)
    )
    rows = prompts.select("prompt", F.posexplode(tokens).alias("at", "token")).select("prompt", "at", tx.entity_of_token(t).alias("entity"), tier.alias("tier"))
    # texts are read once: where an entity first stands, and with which tier, as at * 8 + tier, which hash aggregation can hold.
    # What is no entity goes by the group of null, as a filter of rows would work out entities twice.
    place_of = F.when(F.col("entity").isNotNull(), F.col("at").cast("long") * 8 + F.coalesce("tier", F.lit(4)))
    first = rows.groupBy("prompt", "entity").agg(F.min(F.when(F.col("tier").isNotNull(), place_of)).alias("shaped"), F.min(place_of).alias("any"))
    first = first.where(F.col("any").isNotNull() if vocabulary is not None else F.col("shaped").isNotNull())
    at = F.col("shaped")
    if vocabulary is not None:
        known = vocabulary.select("entity").where("entity is not null").distinct().withColumn("known", F.lit(True))
        first, at = first.join(known, "entity", "left"), F.when(F.col("known"), F.col("any")).otherwise(F.col("shaped"))
    first = first.select("prompt", "entity", F.struct(F.floor(at / 8).alias("at"), (at % 8).cast("int").alias("tier")).alias("x")).where(at.isNotNull())
    place = F.row_number().over(Window.partitionBy("prompt").orderBy("x.tier", "x.at"))
    return first.select("prompt", F.col("entity").alias("needle"), "x.tier", place.alias("place")).where(F.col("place") <= most)


def budgeted(errors: Column, commands: Column, fallback: Column, most: int = 6, most_errors: int = 3, most_commands: int = 3) -> Column:
    """A prompt's own needles: its first errors and commands, and only without any the words of the prompt; at most `most`."""
    signals = F.concat(F.slice(F.coalesce(errors, F.array().cast("array<string>")), 1, most_errors), F.slice(F.coalesce(commands, F.array().cast("array<string>")), 1, most_commands))
    return F.slice(F.when(F.size(signals) > 0, signals).otherwise(F.coalesce(fallback, F.array().cast("array<string>"))), 1, most)


def with_entities(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """(prompt, needle, place, entity): a prompt's own needles, then its entity needles that none of them equals in lower case.

    `raw`: prompt, needle, place; `entities`: prompt, needle, place. Entity needles have a budget of their own, so they displace nothing.
    """
    had = raw.select("prompt", F.lower("needle").alias("needle")).distinct()
    own = raw.select("prompt", "needle", "place", F.lit(False).alias("entity"))
    after = raw.groupBy("prompt").agg(F.max("place").alias("__last"))
    more = entities.select("prompt", "needle", "place").join(had, ["prompt", "needle"], "left_anti").join(after, "prompt", "left")
    return own.unionByName(more.select("prompt", "needle", (F.col("place") + F.coalesce("__last", F.lit(0))).cast("int").alias("place"), F.lit(True).alias("entity")))
