"""Phrase collocations, counted by generalised suffix automata.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and the pieces into words. Texts are dealt
to groups of bounded size, and a group's pieces make one generalised suffix automaton of bounded depth: a state stands
for the phrases that end at the same places, and holds its longest phrase, the length of its shortest, how often they
end (endpos) and a suffix link. It is built by refining the classes of end positions by one more word to the left a
round, in whole arrays, which gives the same states and links as adding word by word.

Phrases of one and two words are counted first: groups send hashes and counts to shards, which sum them and answer which
are frequent. A phrase can be frequent only if all its word pairs are, so a group then breaks its pieces at pairs that
aren't, builds the automaton to the full depth and emits its states. Their phrases, as strings, are summed
over all groups; hashes only filter, so counts are exact.

Scores are worked out by joins of the frequent phrases alone. A candidate is subsumed by a longer one that holds it and
is nearly as frequent; as counts fall along a chain of links, it is enough to look at candidates one word longer: those
whose suffix link (the phrase without its first word), or prefix link, is the candidate.

Defined cases: a null text has no words; a null lang counts as 'und'; empty strings of lang are a language of their own; repeated rows count each;
phrases of one score and frequency are ranked by their bytes; texts are read whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.batches import release
from keepsake.llm.numerics import ragged
from keepsake.llm.words import BASE, GROUP_BYTES, Words, group_of, groups_and_bits, pack, run_numbers, runs, shard_slices, table_of, unpack
from keepsake.runtime import table, written

DEPTH, LEAST, SCALE, SUBSUMED, TOP = 4, 30, 2_000_000, 80, 2000
UNKNOWN = "und"
SLICE = 100_000  # phrases put together at a time
MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D])
BREAKS = MARKS | np.isin(np.arange(256), [0x20, 0x09])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SENT = "shard long, part long, counts binary"
ANSWERS = "part long, shard long, frequent binary"
PHRASES = "lang string, phrase string, least int, length int, n long"


class Automaton:
    """States of the generalised suffix automaton of pieces, for phrases of at most `depth` words.

    `words` are numbers of words and `piece` tells which piece each is in. A state's phrases end at `end` (among other
    places) and have `least` to `length` words; `count` is how often they end, `link` the state of the longest
    phrase that is a suffix of them and ends at more places (-1: the empty phrase).
    """

    def __init__(self, words: np.ndarray, piece: np.ndarray, depth: int):
        levels, at, at_class = [], np.arange(len(words)), np.zeros(len(words), np.int64)
        width = int(words.max(initial=0)) + 1
        for k in range(1, depth + 1):
            if k > 1:
                inside = at >= k - 1
                inside[inside] = piece[at[inside] - (k - 1)] == piece[at[inside]]
                at, at_class = at[inside], at_class[inside]
            if not len(at):
                break
            _, first, now, count = np.unique(at_class * width + words[at - (k - 1)], return_index=True, return_inverse=True, return_counts=True)
            parent = at_class[first]
            same = count == levels[-1]["count"][parent] if levels else np.zeros(len(count), bool)
            level = {"count": count, "end": at[first], "heir": np.zeros(len(count), bool), "least": np.full(len(count), k), "above": parent}
            if levels:
                was = levels[-1]
                was["heir"][parent[same]] = True  # ends wherever its longer form ends: the same state
                level["least"][same], level["above"][same] = was["least"][parent[same]], was["above"][parent[same]]
            levels.append(level)
            at_class = now
        states = [np.flatnonzero(~level["heir"]) for level in levels]
        base = np.cumsum([0] + [len(s) for s in states])
        number = []
        for s, level, b in zip(states, levels, base[:-1], strict=True):
            own = np.full(len(level["count"]), -1)
            own[s] = b + np.arange(len(s))
            number.append(own)
        gather = lambda name: np.concatenate([level[name][s] for s, level in zip(states, levels, strict=True)] or [np.zeros(0, np.int64)])
        self.count, self.end, self.least = gather("count"), gather("end"), gather("least")
        self.length = np.concatenate([np.full(len(s), k + 1) for k, s in enumerate(states)] or [np.zeros(0, np.int64)])
        above, self.link = gather("above"), np.full(len(self.count), -1)
        for k, own in enumerate(number):
            mine = self.least == k + 2
            self.link[mine] = own[above[mine]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, length, count) of every phrase."""
        each = self.length - self.least + 1
        state = np.repeat(np.arange(len(each)), each)
        return state, self.least[state] + np.arange(len(state)) - np.repeat(np.cumsum(each) - each, each), self.count[state]


class Group:
    """A group's words, numbered by language and word, and their pieces."""

    def __init__(self, rows: pa.Table):
        self.words = Words(rows.column("text"), BREAKS, LOWER)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        lang = langs.indices.to_numpy().astype(np.int64)[self.words.doc] if len(self.words) else np.zeros(0, np.int64)
        self.known = max(1, len(self.words.distinct))
        self.ids = lang * self.known + self.words.ids
        self.lang = lang
        # words of one piece have the same number of marks (each text ends with one) in front of them
        self.piece = np.cumsum(MARKS[self.words.data])[self.words.starts]

    def hashes(self) -> np.ndarray:
        """A hash of each word and its language."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        salt = np.array([hash_of(x) for x in self.langs], np.uint64)
        return self.words.hashes()[0][self.words.ids] ^ salt[self.lang]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the pair of words that ends at each word, and whether there is one."""
        h = self.hashes()
        before = np.concatenate((h[:1], h[:-1]))
        return before * BASE + h + np.uint64(1), np.diff(self.piece, prepend=-1) == 0


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def short_phrases(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the group's phrases of one and two words, and their counts."""
    automaton = Automaton(group.ids, group.piece, 2)
    state, length, count = automaton.phrases()
    end = automaton.end[state]
    h = np.where(length == 1, group.hashes()[end], group.pairs()[0][end]) if len(end) else np.zeros(0, np.uint64)
    order, starts = runs(h, np.zeros(len(h), np.uint8))
    return h[order[starts]], np.add.reduceat(count[order], starts) if len(starts) else count


def frequent_in_shard(blobs: list[bytes], least: int) -> list[np.ndarray]:
    parts = [unpack(b, "u4") for b in blobs]
    h, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order, starts = runs(h, np.zeros(len(h), np.uint8))
    total = np.add.reduceat(n[order].astype(np.int64), starts)
    frequent = np.empty(len(h), bool)
    frequent[order] = total[run_numbers(len(h), starts)] >= least
    return np.split(frequent, np.cumsum([len(p[0]) for p in parts])[:-1])


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(lang, phrase, length, n): phrases of up to `depth` words that occur `least` times in pieces of a language.

    Single words are there where a frequent pair can hold them; the phrase '' of length 0 counts all words.
    """
    groups, bits = groups_and_bits(docs, group_bytes)
    id_ = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id")
    rows = docs.select(id_, "text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    dealt = rows.select(group_of(groups).alias("part"), "text", "lang")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        h, n = short_phrases(Group(rows))
        cuts = shard_slices(h, bits)
        blobs = [pack(h[a:b], n[a:b].astype("u4")) for _, a, b in cuts]
        release()
        return table_of(SENT, shard=[s for s, _, _ in cuts], part=[key[0].as_py()] * len(cuts), counts=blobs)

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        frequent = frequent_in_shard(rows.column("counts").to_pylist(), least)
        found = [(p, zstandard.ZstdCompressor(level=1).compress(f.tobytes())) for p, f in zip(rows.column("part").to_pylist(), frequent, strict=True) if f.any()]
        release()
        return table_of(ANSWERS, part=[p for p, _ in found], shard=[key[0].as_py()] * len(found), frequent=[f for _, f in found])

    def emit(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(rows)
        h, _ = short_phrases(g)
        frequent = np.zeros(len(h), bool)
        places = {s: a for s, a, _ in shard_slices(h, bits)}
        for shard, blob in zip(answers.column("shard").to_pylist(), answers.column("frequent").to_pylist(), strict=True):
            found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), bool)
            frequent[places[shard] : places[shard] + len(found)] = found
        h = h[frequent]
        pair, inside = g.pairs()
        goes_on = inside & np.isin(pair, h)
        word = np.isin(g.hashes(), h)
        # infrequent words and pairs break the pieces; a single word has all its places still
        ids, piece = g.ids[word], np.cumsum(~goes_on)[word]
        found = Automaton(ids, piece, depth)
        at = np.flatnonzero(word)[found.end]
        phrase = join_words(g.words, at - found.length + 1, at)
        total = np.bincount(g.lang, minlength=len(g.langs))
        seen = np.flatnonzero(total)
        langs = pa.DictionaryArray.from_arrays(np.concatenate((g.lang[at], seen)).astype("i4"), pa.array(g.langs, pa.string())).cast(pa.string())
        nought = np.zeros(len(seen), int)
        out = table_of(
            PHRASES, lang=langs, phrase=pa.concat_arrays([phrase, pa.array([""] * len(seen), pa.string())]),
            least=np.concatenate((found.least, nought)), length=np.concatenate((found.length, nought)), n=np.concatenate((found.count, total[seen])),
        )
        release()
        return out

    by_group = dealt.groupBy("part")
    sent = by_group.applyInArrow(count, SENT)
    answers = sent.groupBy("shard").applyInArrow(answer, ANSWERS)
    states = by_group.cogroup(answers.groupBy("part")).applyInArrow(emit, PHRASES)
    # a state's phrases are the endings of its longest one
    each = states.withColumn("k", F.explode(F.sequence("least", "length")))
    each = each.select("lang", F.expr("substring_index(phrase, ' ', -k)").alias("phrase"), F.col("k").alias("length"), "n")
    return each.groupBy("lang", "phrase", "length").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("length") == 0))


def join_words(words: Words, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words from `first` to `last` of each phrase, joined by one space."""
    sizes = words.ends - words.starts + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    line = np.append(words.data[ragged(words.starts, sizes)], np.uint8(32))  # all words, each with the byte that follows it
    line[at[1:] - 1] = 32
    lengths = at[last + 1] - 1 - at[first]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    values = np.empty(int(offsets[-1]), np.uint8)
    for a in range(0, len(lengths), SLICE):
        b = min(a + SLICE, len(lengths))
        values[offsets[a] : offsets[b]] = line[ragged(at[first[a:b]], lengths[a:b])]
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(values)).cast(pa.string())


def collocations(docs: DataFrame, top: int = TOP, depth: int = DEPTH, least: int = LEAST, subsumed: int = SUBSUMED, scale: int = SCALE) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = written(phrase_counts(docs, depth, least), "phrases")
    whole = counts.where("length = 0").select("lang", F.col("n").alias("total"))
    counts = counts.where("length > 0")
    candidates = counts.where("length > 1").withColumnRenamed("n", "a")
    # links: one word less at either end. A phrase ranks low if a candidate linked to it is about as frequent
    links = candidates.where("length > 2").select(
        "lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - length)"), F.expr("substring_index(phrase, ' ', length - 1)"))).alias("phrase"),
    )
    longer = links.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR decimal(100) * longer < decimal({subsumed}) * a")).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - length)").alias("tail"),
    )
    heads, tails = (counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(c[0])) for c in ("head", "tail"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # in decimals, whose integral division is exact beyond 64 bits
    scored = scored.withColumn("score", F.expr(f"(cast({scale} as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(h as decimal(19, 0)) + cast(t as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "h", "t")).alias("cut"))
    ranked = best.select("lang", "phrase", "a", F.col("cut.h").alias("l"), F.col("cut.t").alias("r"), "cut.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(whole), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


OP12_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
sized AS (SELECT lang, ws, i, unnest([1, 2, 3, 4]) AS m FROM places),
found AS (SELECT lang, m, ws[i : i + m - 1] AS p FROM sized WHERE i + m - 1 <= len(ws)),
counts AS (SELECT lang, m, p, count(*) AS f FROM found GROUP BY lang, m, p HAVING count(*) >= 30),
candidates AS (SELECT lang, m, p, f AS a FROM counts WHERE m >= 2),
inner_phrases AS (SELECT lang, a, unnest([p[1 : m - 1], p[2 : m]]) AS p FROM candidates WHERE m > 2
    UNION ALL SELECT lang, a, unnest([p[1:2], p[2:3], p[3:4]]) AS p FROM candidates WHERE m = 4),
longer AS (SELECT lang, p, max(a) AS b FROM inner_phrases GROUP BY lang, p),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, p) WHERE b IS NULL OR 100 * b < 80 * a),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
scored AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1 : c.k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : c.m]),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM scored),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM lowest WHERE o = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
