"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a hashed order and cut into blocks of `block_docs`. A source of weight w (its share of
all weights, exact: the decimal number the given weight prints as) gives its block k the release time floor(k / w) and the
deadline ceil((k + 1) / w); one block is placed a slot, always the released one of earliest deadline (ties: the source's
name). Shares sum to 1, so every block is placed inside its window, and after any slot each source is less than one block
from its target, however many slots there are. When a source has no block left, a new phase begins with the weights of
those that have; the bound holds within each phase. Sources of weight 0 come after all others, in equal shares.

The order of blocks depends on the weights and the numbers of blocks alone, and is worked out by the driver in whole
numbers, a step a block. Weights of few digits come round: after as many slots as their whole numbers sum to, every source
is exactly at its target, and the slots that follow are the same again. Of a phase's equal periods only the first is
worked out, and the others are found by arithmetic on the block's number. Where no weights are given, a source's target
is its share of the tempered sizes (documents to the power TEMPER), rounded to a whole number of SHARES and at least 1:
such a period has about SHARES slots however many documents there are, and a target is at most half a share (1 for a
source smaller than that) from the tempered size. The bound of one block holds against the targets. Given weights of
very many digits may not come round within a phase: there it is one step for `block_docs` documents. At most `period`
slots and one open run a source are held at a time; runs go to files in the shared folder, which documents are joined to.

No document is dropped or repeated. Ranks inside a source come from hash buckets and their running counts, so a
source that holds most rows is still ordered by many tasks.

Defined cases: a null source is a source of its own, named ''; repeated rows keep all their places; an empty table gives
an empty result; sources without a given weight get the mean of the given ones; further columns pass through `mix`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.runtime import shared_folder, table

PERIOD, BLOCK_DOCS, BUCKETS, TEMPER, SHARES = 250_000, 16, 1024, 0.7, 10_000
RUN = 64  # blocks of one source in a row of the files
REPEATS = "__s string, first long, blocks long, times long, slots long"
RUNS = "__s string, __run long, __phases array<int>, __slots array<long>, __releases array<long>, __deadlines array<long>"


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    scale = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * scale) for s, w in exact.items()}


def tempered(totals: dict[str, int]) -> dict[str, int]:
    """The target of each source where none is given, in whole numbers that sum to about SHARES."""
    every = sum(n**TEMPER for n in totals.values())
    return {s: max(1, round(n**TEMPER * SHARES / every)) for s, n in totals.items()}


def turns(blocks: dict[str, int], weights: dict[str, int], repeats: list[tuple] | None = None) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline) by slot: earliest deadline first among released blocks.

    Into a list `repeats` go, by source, the first block of a period, its blocks, how often more it comes, and its slots;
    the blocks of those further times are then left out.
    """
    left, done, at, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, 0
    while live := [s for s in left if left[s]]:
        parts = {s: weights[s] for s in live if weights[s]} or dict.fromkeys(live, 1)
        common = math.gcd(*parts.values())
        parts = {s: w // common for s, w in parts.items()}
        total, first, t, going = sum(parts.values()), {s: done[s] for s in parts}, 0, True
        ready: list[tuple] = [(-(-total // w), s, 0, 0) for s, w in parts.items()]
        waiting: list[tuple] = []
        heapify(ready)
        while going:
            if t == total and repeats is not None and (times := min((left[s] - 1) // w for s, w in parts.items())):
                repeats += [(s, first[s], w, times, total) for s, w in parts.items()]
                waiting, t = [(total * (1 + times), s, w * (1 + times)) for s, w in parts.items()], total * (1 + times)
                heapify(waiting)
                for s, w in parts.items():
                    done[s] += w * times
                    left[s] -= w * times
            while waiting and waiting[0][0] <= t:
                release, s, k = heappop(waiting)
                heappush(ready, (-(-(k + 1) * total // parts[s]), s, k, release))
            deadline, s, k, release = heappop(ready)
            yield s, first[s] + k, phase, at + t, at + release, at + deadline
            heappush(waiting, ((k + 1) * total // parts[s], s, k + 1))
            done[s] += 1
            left[s] -= 1
            t, going = t + 1, left[s] > 0
        at, phase = at + t, phase + 1


def write_turns(spark: SparkSession, found: Iterator[tuple], period: int) -> DataFrame:
    """`found` in rows of RUN blocks of a source, written every `period` slots and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/turns-{uuid.uuid4().hex}"
    rows: list[tuple] = []
    runs: dict[str, tuple[int, list[tuple]]] = {}
    close = lambda s: rows.append((s, runs[s][0], *[[x[i] for x in runs[s][1]] for i in range(4)]))
    write = lambda: spark.createDataFrame(rows, RUNS).write.mode("append").parquet(path)
    for s, block, *turn in found:
        if s not in runs or runs[s][0] != block // RUN:
            if s in runs:
                close(s)
            runs[s] = (block // RUN, [])
        run = runs[s][1]
        run += [(None,) * 4] * (block % RUN - len(run))  # blocks of further times of a period
        run.append(tuple(turn))
        if len(rows) * RUN >= period:
            write()
            rows.clear()
    for s in runs:
        close(s)
    write()
    return spark.read.schema(RUNS).parquet(path)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD, seed: int = 11) -> DataFrame:
    """`docs` with mix_phase, mix_block, mix_slot, mix_release, mix_deadline and mix_place (in the block).

    Without `weights` a source's target is its share of the tempered sizes.
    """
    spark = docs.sparkSession
    added = ["mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_place"]
    docs = docs.drop(*added)
    rows = docs.withColumn("__s", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("__b", F.pmod("__h", F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__s", "__b", "n", F.coalesce(before, F.lit(0)).alias("__before"))  # sources x BUCKETS rows
    totals = {r["__s"]: r["n"] for r in counts.groupBy("__s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    given = {s: Fraction(str(w)) for s, w in (weights or tempered(totals)).items()}
    mean = sum(given.values()) / max(1, len(given))
    parts = whole({s: given.get(s, mean) for s in totals})
    repeats: list[tuple] = []
    runs = write_turns(spark, turns({s: -(-n // block_docs) for s, n in totals.items()}, parts, repeats), period)
    periods = F.collect_list(F.struct("first", "blocks", "times", "slots")).alias("__periods")
    periods = spark.createDataFrame(repeats, REPEATS).groupBy("__s").agg(periods)  # at most one a phase in a row
    holds = lambda p, low, high: (p["first"] + p["blocks"] <= high) & (low < p["first"] + p["blocks"] * (1 + p["times"]))
    low, high = F.floor(F.col("__before") / block_docs), F.floor((F.col("__before") + F.col("n")) / block_docs)
    buckets = counts.join(periods, "__s", "left").withColumn("__periods", F.filter("__periods", lambda p: holds(p, low, high))).drop("n")
    w = Window.partitionBy("__s", "__b").orderBy("__h", "doc_id")
    ranked = rows.withColumn("__rank", F.row_number().over(w)).join(buckets, ["__s", "__b"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before")).withColumn("mix_block", F.floor(F.col("__rank") / block_docs))
    ranked = ranked.withColumn("__period", F.get(F.filter("__periods", lambda p: holds(p, F.col("mix_block"), F.col("mix_block"))), F.lit(0)))
    ranked = ranked.withColumn("__times", F.coalesce(F.expr("(mix_block - __period.first) div __period.blocks"), F.lit(0)))
    shift = F.coalesce(F.col("__times") * F.col("__period.slots"), F.lit(0))
    ranked = ranked.withColumn("__like", F.coalesce(F.col("mix_block") - F.col("__times") * F.col("__period.blocks"), "mix_block"))
    ranked = ranked.withColumn("__run", F.expr(f"__like div {RUN}"))
    placed, at = ranked.join(runs, ["__s", "__run"]), F.pmod("__like", F.lit(RUN)).cast("int")
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.get("__phases", at).alias("mix_phase"), "mix_block", (F.get("__slots", at) + shift).alias("mix_slot"),
        (F.get("__releases", at) + shift).alias("mix_release"), (F.get("__deadlines", at) + shift).alias("mix_deadline"),
        F.pmod("__rank", F.lit(block_docs)).cast("int").alias("mix_place"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs`, all of them, in the order of the mixture: files of ascending ranges of slots, sorted inside."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = schedule(docs, weights).repartitionByRange(parts, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns])


def places_of_files(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """`docs`, read from files that `mix` wrote, with mix_slot and mix_place, which the order of the rows in these files tells.

    Rows of one source in a row are whole blocks, of which the source's last one may be shorter: a block begins where the
    source changes and after every `block_docs` rows. What a file needs of those before it are sums and the last row of each.
    """
    source, of_file = F.coalesce(F.col("source").cast("string"), F.lit("")), Window.partitionBy("__f").orderBy("__i")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*kept, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"), source.alias("__s"))
    upto = of_file.rowsBetween(Window.unboundedPreceding, 0)

    def first_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__start", F.coalesce(F.lag("__s").over(of_file) != F.col("__s"), F.lit(True)))

    spans = first_of(rows.select("__f", "__i", "__s")).groupBy("__f").agg(
        F.count("*").alias("n"), F.min_by("__s", "__i").alias("first"), F.max_by("__s", "__i").alias("last"), F.max(F.when(F.col("__start"), F.col("__i"))).alias("at")
    )
    known, files, n, last, start, slots = sorted(spans.collect()), [], 0, None, 0, 0  # a row a file
    for r in known:
        goes_on = r["first"] == last
        files.append((r["__f"], n, goes_on, start))
        start = n + r["at"] if r["at"] or not goes_on else start
        n, last = n + r["n"], r["last"]
    spark = docs.sparkSession
    bases = spark.createDataFrame(files, "__f string, __n long, __on boolean, __before long")
    placed = first_of(rows).join(F.broadcast(bases), "__f")
    begins = F.when(F.col("__start") & ~((F.col("__i") == 0) & F.col("__on")), F.col("__n") + F.col("__i"))
    placed = placed.withColumn("__at", F.coalesce(F.max(begins).over(upto), "__before"))
    placed = placed.withColumn("mix_place", ((F.col("__n") + F.col("__i") - F.col("__at")) % block_docs).cast("int"))
    heads = {r["__f"]: r["heads"] for r in placed.where("mix_place = 0").groupBy("__f").agg(F.count("*").alias("heads")).collect()}
    sums = []
    for f, *_ in files:
        sums.append((f, slots))
        slots += heads.get(f, 0)
    sums = spark.createDataFrame(sums, "__f string, __slots long")
    slot = F.col("__slots") + F.sum((F.col("mix_place") == 0).cast("long")).over(upto) - 1
    return placed.join(F.broadcast(sums), "__f").select(*kept, slot.alias("mix_slot"), "mix_place")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))
