"""Substring dedup, collocations and fill-in-middle against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.llm import collocations, fill_in_middle, substring_dedup
from keepsake.llm.words import Words, pack, runs, unpack

DOCS = "doc_id long, text string, lang string, n_words string, part int, key string, c0 double"


def prose(n, seed, vocabulary=6, length=60):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]
    out = []
    for _ in range(n):
        words = [f"W{rng.integers(vocabulary)}é" for _ in range(rng.integers(0, length))]
        out.append("".join(w + str(rng.choice(marks)) for w in words))
    return out


def frame(spark, texts, langs=("en", "de", None)):
    rows = [(i * 3 + 1, t, langs[i % len(langs)], "x", 7, "k", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- words


def test_words_of_awkward_texts():
    texts = pa.chunked_array([["", None, " a\tb", "b"], ["\n\n", "éa  a"]], pa.string())
    w = Words(texts, substring_dedup.BREAKS)
    found = [(int(d), w.distinct[i].decode()) for d, i in zip(w.doc, w.ids, strict=True)]
    assert found == [(2, "a"), (2, "b"), (3, "b"), (5, "éa"), (5, "a")]
    assert len(Words(pa.chunked_array([[]], pa.string()), substring_dedup.BREAKS)) == 0


def test_packed_columns_come_back():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    c, n = np.arange(500, dtype="u2"), np.arange(500, dtype="i8") - 250
    back = unpack(pack(h, c, n), "u2", "i8")
    assert all((a == b).all() for a, b in zip(back, (h, c, n), strict=True))


def test_runs_of_colliding_hashes_are_told_apart_by_the_check():
    h, c = np.array([5, 5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 1, 9], np.uint64)
    order, starts = runs(h, c)
    assert [(int(h[i]), int(c[i])) for i in order] == [(1, 9), (5, 1), (5, 1), (5, 2), (5, 2)] and starts.tolist() == [0, 1, 3]
    assert order.tolist() == [4, 1, 3, 0, 2]


# ---- substring dedup


def brute_repeats(rows, size=13, min_docs=2):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first, docs = {}, Counter()
    for i, ws in words:
        i = -(2**63) if i is None else i
        for w in {tuple(ws[a : a + size]) for a in range(len(ws) - size + 1)}:
            first[w] = min(i, first.get(w, i))
            docs[w] += 1
    out = []
    for i, ws in words:
        gone = set()
        for a in range(len(ws) - size + 1):
            w = tuple(ws[a : a + size])
            if docs[w] >= min_docs and first[w] < (-(2**63) if i is None else i):
                gone |= set(range(a, a + size))
        spans, kept = [], " ".join(w for p, w in enumerate(ws) if p not in gone)
        for p in sorted(gone):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((i, len(ws), len(gone), kept, spans))
    return out


def found_repeats(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text, [[s.start, s.end] for s in r.removed]) for r in df.collect()]


@pytest.mark.parametrize("size,min_docs", [(13, 2), (2, 2), (3, 4), (1, 2)])
def test_repeats_equal_brute_force(spark, size, min_docs):
    shared = " ".join(f"s{i}" for i in range(40))
    texts = prose(40, 3) + [f"a b {shared} c", shared, f"x {shared[:80]} y {shared[60:]}", shared, "", None, "one\x0btwo"]
    df = frame(spark, texts)
    got = substring_dedup.drop_repeats(df, size, min_docs, group_bytes=500)
    want = brute_repeats([(r.doc_id, r.text) for r in df.collect()], size, min_docs)
    assert sorted(found_repeats(got), key=repr) == sorted(want, key=repr)
    assert got.columns == [c for c in df.columns if c != "n_words"] + ["n_words", "n_removed", "removed", "kept_text"]


def test_repeats_of_ties_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    rows = [(None, t), (None, t), (4, t), (4, t), (4, f"z {t}"), (9, "w1 w2"), (9, None), (2, t[4:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.drop_repeats(df)
    assert sorted(found_repeats(got), key=repr) == sorted(brute_repeats(rows), key=repr)


def test_one_passage_in_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(f" {passage} e"), F.col("id").cast("string")).alias("text"))
    got = substring_dedup.drop_repeats(df, group_bytes=20_000)
    assert got.groupBy("n_words", "n_removed").count().orderBy("n_removed").collect() == [(52, 0, 1), (52, 50, 2999)]


def test_a_very_long_text_is_read_whole(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, long), (2, " ".join(f"v{i}" for i in range(199_980, 200_000))), (3, long + " end")]
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text[:3]) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()} == {
        (1, 200_000, 0, "v0 "), (2, 20, 20, ""), (3, 200_001, 200_000, "end")}


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.drop_repeats(frame(spark, ["x"]).where("false")).count() == 0


def test_texts_cross_one_shuffle_for_both_passes(spark):
    df = substring_dedup.drop_repeats(frame(spark, prose(5, 1)))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


# ---- collocations


def brute_states(words, pieces, depth):
    places = defaultdict(set)
    for e in range(len(words)):
        for k in range(1, depth + 1):
            if e - k + 1 >= 0 and pieces[e - k + 1] == pieces[e]:
                places[tuple(words[e - k + 1 : e + 1])].add(e)
    states = defaultdict(list)
    for p, ends in places.items():
        states[frozenset(ends)].append(p)
    return places, states


@pytest.mark.parametrize("seed", range(6))
def test_automaton_has_the_states_and_links_of_end_positions(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 3 + seed, 80)
    piece = np.cumsum(rng.random(80) < 0.15)
    a = collocations.Automaton(words, piece, 4)
    places, states = brute_states(words.tolist(), piece.tolist(), 4)
    longest = [tuple(words[e - n + 1 : e + 1].tolist()) for e, n in zip(a.end, a.length, strict=True)]
    want = {max(ps, key=len): (len(ends), min(map(len, ps))) for ends, ps in states.items()}
    assert {p: (c, s) for p, c, s in zip(longest, a.count.tolist(), a.least.tolist(), strict=True)} == want
    for p, s, link in zip(longest, a.least.tolist(), a.link.tolist(), strict=True):
        suffix = p[len(p) - s + 1 :]
        assert link == -1 if not suffix else longest[link] == suffix and places[suffix] > places[p]
    state, length, count = a.phrases()
    got = {tuple(words[a.end[s] - n + 1 : a.end[s] + 1].tolist()): c for s, n, c in zip(state, length.tolist(), count.tolist(), strict=True)}
    assert got == {p: len(e) for p, e in places.items()}


def brute_collocations(rows, least, top, depth=4):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang, t = lang if lang is not None else "und", (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in range(1, depth + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for q, b in cand.items():
            for p in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                held[p] = max(held[p], b)
        rows = []
        for p, a in cand.items():
            if 100 * held[p] >= 80 * a:
                continue
            score, _, x, y = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("seed,vocabulary,least,top", [(1, 6, 3, 2000), (2, 3, 5, 20), (3, 40, 2, 2000)])
def test_collocations_equal_brute_force(spark, seed, vocabulary, least, top):
    texts = prose(60, seed, vocabulary) + [None, "", "A.b,A\x0bb", "a b " * 50, "Ünd ÜND\tund"]
    df = frame(spark, texts)
    got = [tuple(r) for r in collocations.collocations(df, top=top, least=least).collect()]
    want = brute_collocations([(r.text, r.lang) for r in df.collect()], least, top)
    assert sorted(got) == sorted(want) and len(want) > 20


def test_collocations_of_an_empty_table_and_of_repeated_rows(spark):
    df = frame(spark, ["a b c"] * 2, ("en",))
    assert collocations.collocations(df.where("false"), least=1).count() == 0
    same = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert [tuple(r) for r in collocations.collocations(same, least=2).collect()] == [("en", 1, "a b c", 2, 2, 2, 6, 1_000_000)]


def test_a_score_whose_product_passes_64_bits(spark):
    scale = 2_000_000 * 10**12
    df = frame(spark, ["x y"] * 7 + ["x z"] * 4, ("en",))
    rows = collocations.collocations(df, least=2, scale=scale).orderBy("rank").collect()
    assert [(r.phrase, r.score) for r in rows] == [("x y", 7 * scale // 18), ("x z", 4 * scale // 15)]


# ---- fill in the middle


def brute_middle(i, t, percent=90, spm=20):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return i, n, "plain", None, None, t
    return (i, n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (i, n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


AWKWARD = ["", None, "a", "\x01", "\x02", "\x020\x021\x01\x01a\x02", "<P", "<<S>", "<P>x", "a<", "日本語 text 😀😀\n\r\n", "x" * 5000, "0\x021", "$1\\", "é́ Ωmega_9 ", "<" * 40, "P>S>M>" * 9]


@pytest.mark.parametrize("percent,spm", [(90, 20), (100, 50), (0, 20)])
def test_middles_equal_brute_force_and_texts_come_back(spark, percent, spm):
    rng = np.random.default_rng(5)
    signs = list("ab<>PSM \n01\x01\x02é😀")
    texts = AWKWARD * 3 + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(150)]
    rows = [(i, t, f"f{i}", "kept?") for i, t in enumerate(texts)] + [(None, "no id at all", "f", "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, marked string")
    made = fill_in_middle.transform(df, percent, spm)
    assert made.columns == ["doc_id", "text", "marked", "n", "form", "prefix", "middle", "suffix", "output"]
    made = made.withColumn("back", fill_in_middle.rebuild(F.col("output"), F.col("form"))).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in made], key=repr) == sorted([brute_middle(i, t, percent, spm) for i, t, *_ in rows], key=repr)
    assert all(r.back == (r.text or "") and r.marked in ("kept?", "k") for r in made)
    assert fill_in_middle.transform(df.where("false")).count() == 0


def test_middles_run_without_python(spark):
    plan = fill_in_middle.transform(frame(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
