"""Similarity joins on awkward vectors, needles from tables, and the settings sweep."""

import re
import time
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepsake.operators import needles, packing, vectors
from keepsake.plans import sweep
from keepsake.settings import Settings

ROWS = "id string, project string, scope string, type string, embedding array<double>"


def unit_cosine(a, b):
    if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in [*a, *b]):
        return None
    a, b = np.array(a), np.array(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return None if n == 0 else float(a @ b / n)


def brute_neighbours(rows, k, threshold, same=(), differ=None, or_global=False):
    out = []
    for s in rows:
        found = []
        for p in rows:
            c = unit_cosine(s["embedding"], p["embedding"])
            if s["id"] == p["id"] or c is None or c < threshold:
                continue
            if differ and s[differ] == p[differ]:
                continue
            first = not same or s[same[0]] == p[same[0]] or (or_global and (p["scope"] == "global" or (s["scope"] == "global" and or_global != "pool")))
            if first and all(s[c] == p[c] for c in same[1:]):
                found.append((-round(c, 9), p["id"]))
        out += [(s["id"], other, rank + 1) for rank, (_, other) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(2)
    rows = [
        {"id": f"r{i:03}", "project": "ab"[i % 2], "scope": "global" if i % 5 == 0 else "project", "type": "xyz"[i % 3], "embedding": rng.normal(size=4).round(1).tolist()}
        for i in range(40)
    ]
    bad = [None, [], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 4.0], [1.0] * 5]
    rows += [{"id": f"bad{i}", "project": "a", "scope": "global", "type": "x", "embedding": v} for i, v in enumerate(bad)]
    rows += [rows[3] | {"id": "copy1"}, rows[3] | {"id": "copy2"}]
    return rows, spark.createDataFrame([tuple(r[c] for c in ("id", "project", "scope", "type", "embedding")) for r in rows], ROWS)


@pytest.mark.parametrize(
    "how", [{}, {"same": ("project",)}, {"same": ("project", "type")}, {"differ": "type"}, {"same": ("project",), "or_global": True}, {"same": ("project", "type"), "or_global": "pool"}]
)
def test_neighbours_with_bad_vectors(awkward, how, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 16)
    monkeypatch.setattr(vectors, "BLOCK", 5)
    rows, df = awkward
    got = sorted((r["id"], r["other"], r["rank"]) for r in vectors.neighbours(df, df, 3, 0.1, **how).collect())
    assert got == brute_neighbours(rows, 3, 0.1, **how)


def test_best_of_each_row_takes_the_leftmost_of_ties():
    close = np.array([[1, 2, 2, 2, 0], [-np.inf, 3, -np.inf, -np.inf, -np.inf], [5, 5, 5, 5, 5.0]])
    rows, cols = vectors.best_of_each_row(close, 2)
    assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (2, 0), (2, 1)]


def test_a_full_cell_without_threshold_is_quick(spark):
    x = np.random.default_rng(0).normal(size=(4096, 16))
    df = spark.createDataFrame(pd.DataFrame({"id": [f"i{i:05}" for i in range(4096)], "embedding": x.tolist()})).repartition(4).cache()
    df.count()
    began = time.time()
    assert vectors.neighbours(df, df, 8, -1.0).count() == 8 * 4096
    assert time.time() - began < 20


def vectors_and_ids(spark, x, ids=None):
    ids = [f"i{i:05}" for i in range(len(x))] if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"id": ids, "type": ["xyz"[i % 3] for i in range(len(x))], "embedding": x.tolist()})).repartition(4)


def test_a_large_pool_gives_few_rows_a_seed(spark):
    df = vectors_and_ids(spark, np.random.default_rng(4).normal(size=(9000, 8)))
    seeds, pool = (d.select(*[F.col(c).alias(c) for c in df.columns], F.lit(8).alias("dims")) for d in (df.where("id < 'i00005'"), df))
    assert vectors._grid(seeds, pool, 2, -1.0, (), ("type",)).count() == 5 * 2  # one group of the pool, not three


@pytest.mark.parametrize("how", [{"k": 3}, {"k": 3, "differ": "type"}, {"k": 2**31 - 1, "same": ("project",)}])
def test_neighbours_with_seeds_dealt_further(awkward, how, monkeypatch):
    for name, value in {"SEEDS": 20, "PAIRS": 200, "SPREAD": 5, "GROUP": 16, "SMALL": 9, "BLOCK": 7}.items():
        monkeypatch.setattr(vectors, name, value)
    rows, df = awkward
    k, how = how["k"], {c: v for c, v in how.items() if c != "k"}
    got = sorted((r["id"], r["other"], r["rank"]) for r in vectors.neighbours(df, df, k, 0.1, **how).collect())
    assert got == brute_neighbours(rows, k, 0.1, **how)


@pytest.mark.parametrize("k", [1, 3, 12, 2**31 - 1])
@pytest.mark.parametrize("threshold", [-2.0, 0.3, 0.9999999])
def test_best_in_cell_equals_double_precision(k, threshold, monkeypatch):
    """Also with copies, and with vectors that single precision can't tell apart."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    y = np.concatenate((base, base[:50], base[:1] + rng.normal(size=(200, 16)) * 1e-9, base[:1].repeat(100, 0)))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    mine = [np.arange(len(y)), np.arange(len(y)) % 4]
    close = np.stack([vectors.cosines(y, y, np.full(len(y), i), np.arange(len(y))) for i in range(len(y))])
    close[(close < threshold) | (mine[1][:, None] == mine[1][None])] = -np.inf
    rows, cols = vectors.best_of_each_row(close, k)
    want = list(zip(rows.tolist(), cols.tolist(), close[rows, cols].tolist(), strict=True))
    assert sorted(zip(*(p.tolist() for p in vectors.best_in_cell(y, y, mine, mine, k, threshold)), strict=True)) == want and want


def test_many_copies_meet_those_of_the_smallest_ids(spark):
    x = np.concatenate((np.ones((6000, 8)), np.random.default_rng(6).normal(size=(50, 8))))
    kept = vectors.first_copies(x, [np.arange(len(x)), np.arange(len(x)) % 3], 4)
    assert kept.tolist() == [*range(15), *range(6000, 6050)]
    df = vectors_and_ids(spark, x)
    got = {r["id"]: [n[1] for n in sorted(r["n"])] for r in vectors.neighbours(df, df, 4, 0.999, differ="type").groupBy("id").agg(F.collect_list(F.struct("rank", "other")).alias("n")).collect()}
    want = {t: [f"i{i:05}" for i in range(8) if i % 3 != t][:4] for t in range(3)}
    assert got == {f"i{i:05}": want[i % 3] for i in range(6000)}


def test_neighbours_of_very_small_and_very_large_vectors(spark):
    df = vectors_and_ids(spark, np.array([[1e300, 2e300], [1e-300, 2e-300], [1.0, 2.0], [5e-324, 0.0]]))
    got = {(r["id"], r["other"]): round(r["similarity"], 9) for r in vectors.neighbours(df, df, 3, 0.0).collect()}
    assert got == {(f"i0000{a}", f"i0000{b}"): round(5**-0.5, 9) if 3 in (a, b) else 1.0 for a in range(4) for b in range(4) if a != b}


# ---- needles

TEXTS = ["Straße am Fluß", "ABC abc", "a", "", None, "x%y_z\\", "日本語のテキスト", "😀 smile 😀😀", "line\nbreak", "needle in a haystack", "NEEDLE", "nee dle", "aaaa", "İstanbul"]
WANTED = ["needle", "Needle", "abc", "a", "ab", "  ", None, "%y_", "\\", "日本語", "本", "😀", "😀😀", "e\nb", "aaa", "aaaaa", "nothing here", "hay", "ß am", "x%y_z\\"]


@pytest.mark.parametrize("frequent", [0, 1, 100_000])
def test_matches_equal_contains(spark, frequent):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    wanted = spark.createDataFrame([(w,) for w in WANTED * 2], "needle string")
    got = sorted((r["id"], r["needle"]) for r in needles.matches(texts, wanted, "text", frequent).collect())
    plain = texts.join(wanted.where("trim(needle) <> ''").distinct(), F.contains(F.lower("text"), F.lower("needle")))
    assert got == sorted((r["id"], r["needle"]) for r in plain.collect()) and len(got) > 15
    assert needles.matches(texts, wanted.where("false"), "text").count() == 0 and needles.matches(texts.where("false"), wanted, "text").count() == 0


def test_matches_has_no_nested_loop(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    plan = needles.matches(texts, spark.createDataFrame([("abc",)], "needle string"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("frequent", [0, 1, 100_000])
def test_matches_by_lists_equal_contains(spark, frequent):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    wanted = spark.createDataFrame([(w,) for w in WANTED * 2], "needle string")
    got = sorted((r["id"], r["needle"]) for r in needles.matches(texts, wanted, "text", frequent, literal=0).collect())
    plain = texts.join(wanted.where("trim(needle) <> ''").distinct(), F.contains(F.lower("text"), F.lower("needle")))
    assert got == sorted((r["id"], r["needle"]) for r in plain.collect()) and len(got) > 15


def test_few_needles_shuffle_no_texts(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    plan = needles.matches(texts, spark.createDataFrame([("abc",)], "needle string"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_many_texts_are_looked_up_by_their_distinct_runs(spark, monkeypatch):
    """Posting lists of grams grow with the distinct runs of letters, not with the texts; needles of several runs are verified."""
    sizes, keep = {}, needles.written

    def counted(df, name="step"):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(needles, "written", counted)
    texts = spark.range(400).select("id", F.concat(F.lit("configuration, reload-server "), F.col("id").cast("string")).alias("text"))
    wanted = spark.createDataFrame([(w,) for w in ["figura", "reload", "load-serv", "server 7", "server 39", "reload server"]], "needle string")
    got = sorted((r["id"], r["needle"]) for r in needles.matches(texts, wanted, "text", literal=0).collect())
    plain = texts.join(wanted, F.contains(F.lower("text"), F.lower("needle")))
    assert got == sorted((r["id"], r["needle"]) for r in plain.collect()) and len(got) > 1200
    assert sizes["postings"] < 20


def test_needles_of_several_runs_go_by_the_rarest(spark, monkeypatch):
    sizes, keep = {}, needles.written

    def counted(df, name="step"):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(needles, "written", counted)
    texts = spark.range(300).select("id", F.concat(F.lit("mail to u"), F.col("id").cast("string"), F.lit("@example.com")).alias("text"))
    wanted = spark.createDataFrame([(f"u{i}@example.com",) for i in range(40, 90)] + [("u9@nowhere.com",), ("to",), ("nil",)], "needle string")
    got = sorted((r["id"], r["needle"]) for r in needles.matches(texts, wanted, "text").collect())
    assert got == sorted([(i, f"u{i}@example.com") for i in range(40, 90)] + [(i, "to") for i in range(300)])
    assert sizes["candidates"] <= 2 * 50


@pytest.mark.parametrize(("most", "first", "literal"), [(2, 30, 0), (100, 40, 0), (2, 8192, 32)])
def test_first_matches_equal_contains(spark, monkeypatch, most, first, literal):
    for name, value in {"FIRST": first, "GROWTH": 2}.items():
        monkeypatch.setattr(needles, name, value)
    texts = spark.createDataFrame([(i, g, t) for i, t in enumerate(TEXTS * 4) for g in ("a" if i % 3 else "b", "all")[: 1 + i % 2]], "id long, group string, text string")
    wanted = spark.createDataFrame([(w, g) for w in [*WANTED, "e\nb", "İstanbul"] for g in ("b", "all", "c", None)], "needle string, group string")
    got = sorted(tuple(r) for r in needles.first_matches(texts, wanted, most, "text", literal).select("needle", "group", "id").collect())
    plain = texts.join(wanted.where("trim(needle) <> ''").distinct(), "group").where(F.contains(F.lower("text"), F.lower("needle"))).select("needle", "group", "id").collect()
    held = {}
    for needle, group, i in sorted(map(tuple, plain)):
        held.setdefault((needle, group), []).append(i)
    assert got == sorted((*key, i) for key, ids in held.items() for i in ids[:most]) and len(got) > 20


def test_first_matches_by_needle_lists_of_few_needles(spark):
    texts = spark.createDataFrame([(i, f"g{i % 50}", "one two") for i in range(200)], "id long, group string, text string")
    wanted = spark.createDataFrame([("one", f"g{g}") for g in range(50)] + [("two", "g3")], "needle string, group string")
    got = sorted(tuple(r) for r in needles.first_matches(texts, wanted, 2, "text").select("needle", "group", "id").collect())
    assert got == sorted([("one", f"g{g}", i) for g in range(50) for i in (g, g + 50)] + [("two", "g3", 3), ("two", "g3", 53)])


PROMPTS = [
    "see src/lib/a.ts and Foo.Bar on k8s with claude-memory",
    "phantom runs sha256 on NASA's phantom-host, and on git",
    "a bb 123 4.5 v1.2 HTTP ERROR x_y under_score phantom",
    "",
    None,
    "Café café Cafe lower lower.case lower",
    "Config config.json Git GIT",
]
STOP = "git npm pnpm node npx bash zsh shell linux file server error command config json http https".split()


def brute_needles(text, vocabulary, most):
    tiers, seen = [[] for _ in range(5)], set()
    for token in re.findall(r"[^\W_](?:[\w.:/@+̀-ͯ-]*[^\W_]|[\w.:/@+̀-ͯ-]*[̀-ͯ])?", unicodedata.normalize("NFC", text or "")):
        entity = token.lower()
        if not 3 <= len(entity) <= 120 or not re.search(r"[^\W\d_]", entity) or entity in STOP or entity in seen:
            continue
        if re.search(r"[/:\\]|\.[A-Za-z0-9]", token):
            tier = 0
        elif token[0].isupper():
            tier = 1
        elif re.search(r"[^\W\d_][-_][^\W\d_]", token):
            tier = 2
        elif re.search(r"[0-9]", token):
            tier = 3
        elif entity in vocabulary:
            tier = 4
        else:
            continue
        seen.add(entity)
        tiers[tier].append((entity, tier))
    return [x for t in tiers for x in t][:most]


@pytest.mark.parametrize("most,vocabulary", [(3, ["phantom", "lower"]), (20, ["phantom", "under", None]), (20, None)])
def test_entity_needles_by_tier(spark, most, vocabulary):
    prompts = spark.createDataFrame(list(enumerate(PROMPTS)), "prompt long, text string")
    words = None if vocabulary is None else spark.createDataFrame([(v,) for v in vocabulary * 2], "entity string")
    got = needles.entity_needles(prompts, words, most).orderBy("prompt", "place").collect()
    want = [(i, n, t) for i, p in enumerate(PROMPTS) for n, t in brute_needles(p, set(vocabulary or []), most)]
    assert [(r["prompt"], r["needle"], r["tier"]) for r in got] == want
    if vocabulary and most > 3:
        assert {r["tier"] for r in got} == {0, 1, 2, 3, 4}


def test_entity_needles_read_texts_once(spark):
    words = spark.createDataFrame([("phantom",)], "entity string")
    found = needles.entity_needles(spark.createDataFrame(list(enumerate(PROMPTS)), "prompt long, text string"), words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_a_budget_keeps_signals_before_words(spark):
    rows = [(1, ["e1", "e2", "e3", "e4"], ["c1"], ["w"]), (2, [], None, ["w1", "w2"]), (3, None, ["c1", "c2", "c3", "c4"], []), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, e array<string>, c array<string>, w array<string>")
    got = {r["id"]: r["x"] for r in df.select("id", needles.budgeted(F.col("e"), F.col("c"), F.col("w"), 4).alias("x")).collect()}
    assert got == {1: ["e1", "e2", "e3", "c1"], 2: ["w1", "w2"], 3: ["c1", "c2", "c3"], 4: []}


def test_entity_needles_come_after_and_displace_nothing(spark):
    raw = spark.createDataFrame([("p", "Abc", 1), ("p", "x", 2)], "prompt string, needle string, place int")
    more = spark.createDataFrame([("p", "abc", 1), ("p", "new", 2), ("q", "only", 1)], "prompt string, needle string, place int")
    got = sorted(tuple(r) for r in needles.with_entities(raw, more).collect())
    assert got == [("p", "Abc", 1, False), ("p", "new", 4, True), ("p", "x", 2, False), ("q", "only", 1, True)]


# ---- sweep

RECORDS = "id string, project string, scope string, exact_text string, embedding array<double>, usage_count int, retrieval_count int, deprecated boolean"


def store(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[: n // 2] += 2
    rows = [
        (f"r{i:03}", "ab"[i % 2], "global" if i % 9 == 0 else "project", f"text {i} word{i % 7} {'long ' * (i % 5)}", x[i].tolist(), int(i % 4), int(i % 6), bool(i % 11 == 0))
        for i in range(n)
    ]
    prompts = [(f"p{j}", "ab"[j % 2], ["b"] if j == 0 else None, (x[3 * j + 1] + 0.1).tolist()) for j in range(6)]
    wanted = [(f"p{j}", f"word{j}", j % 2 == 0) for j in range(6)] + [("p1", "text 5", False), ("p5", "nowhere", False)]
    edges = [(f"r{rng.integers(n):03}", f"r{rng.integers(n):03}", float(rng.uniform(0.2, 1)), "shares_entity" if rng.random() < 0.3 else "relates_to") for _ in range(400)] + [("r001", "gone", 1.0, "relates_to")]
    return (
        spark.createDataFrame(rows, RECORDS), spark.createDataFrame(edges, "source string, target string, weight double, kind string"),
        spark.createDataFrame(prompts, "prompt string, project string, ancestors array<string>, embedding array<double>"), spark.createDataFrame(wanted, "prompt string, needle string, entity boolean"),
        rows, edges, prompts, wanted,
    )


def brute_sweep(rows, edges, prompts, wanted, s):
    live = {r[0]: r for r in rows if not r[7]}
    ratio = lambda r: 0 if r[5] <= 0 else min(r[5] / max(r[6], 1), 1)
    pool, out = 3 * s.max_records, []
    for pid, project, ancestors, e in prompts:
        cos = {i: unit_cosine(e, r[4]) for i, r in live.items()}
        like = [i for i in sorted(live, key=lambda i: (-cos[i], i))[:pool] if cos[i] >= s.min_semantic_similarity and cos[i] + ratio(live[i]) * s.usage_ratio_weight >= s.min_semantic_only_score]
        mine, words = {project, *(ancestors or [])}, set()
        for p, w, entity in wanted:
            if p == pid and (s.enable_entity_keywords or not entity):
                words |= set([i for i in sorted(live) if w.lower() in live[i][3].lower() and (live[i][1] in mine or live[i][2] == "global")][:pool])
        words = set(sorted(words, key=lambda i: (-ratio(live[i]), i))[:pool])
        found = []
        for i in {*like, *words}:
            sim = cos[i] if i in like and cos[i] != 0 else max(0.0, cos[i])
            part = lambda x, w: x * s.semantic_weight + (min(x / s.min_semantic_similarity, 1) * s.keyword_bonus if w else 0) + ratio(live[i]) * s.usage_ratio_weight + (s.project_match_bonus if live[i][1] == project else 0)  # noqa: E731, B023
            q = part(cos[i], True) if i in words else None
            score = max(part(sim, i in words), q if q is not None else -9)
            if score >= s.min_score:
                found.append([i, score, sim, q])
        found = sorted(found, key=lambda f: (-f[1], -f[2], f[0]))[:pool]
        if found and s.semantic_anchor_threshold > 0 and max(max(cos[f[0]], 0) for f in found) < s.semantic_anchor_threshold:
            found = [f for f in found if f[3] is not None and f[3] >= s.min_score and (live[f[0]][1] in mine or live[f[0]][2] == "global")]
        known = {f[0] for f in found}
        front, extra = [(f[0], f[1], f[2], 1.0) for f in found], []
        for hop in range(1, s.max_relation_hops + 1):
            best = {}
            for i, root, sim, walked in front:
                for a, b, weight, kind in edges:
                    if a == i and b not in known and b in live and (kind != "shares_entity" or s.enable_entity_edges):
                        w = walked * weight
                        key = (-root * w * s.relation_hop_decay**hop, i)
                        if b not in best or key < best[b][0]:
                            best[b] = (key, root, sim, w)
            front = []
            for b, (key, root, sim, w) in sorted(best.items(), key=lambda x: (x[1][0][0], x[0])):
                if len(extra) < s.max_relation_expansions and -key[0] > 0:
                    known.add(b)
                    extra.append((b, -key[0], key[1], hop))
                    front.append((b, root, sim, w))
        rows_ = [(f[0], f[1], None, 0) for f in found] + [x for x in extra if s.min_expanded_score <= 0 or x[1] >= s.min_expanded_score]
        rows_.sort(key=lambda x: (-x[1], x[0]))
        chosen, used, place = [], 0, 0
        while rows_ and len(chosen) < s.max_records:
            near = lambda x: max(unit_cosine(live[x[0]][4], live[c[0]][4]) for c in chosen)  # noqa: E731, B023
            pick = rows_[0] if not chosen else max(rows_, key=lambda x: (s.mmr_lambda * x[1] - (1 - s.mmr_lambda) * near(x), -rows_.index(x)))  # noqa: B023
            rows_.remove(pick)
            chosen.append(pick)
        for x in chosen:
            used += -(-len(live[x[0]][3]) // 4)
            place += 1
            if used > s.max_tokens:
                break
            out.append((pid, place, x[0], round(x[1], 6), x[2], x[3]))
    return out


def test_sweep_equals_one_prompt_at_a_time(spark):
    df, ed, pr, wa, *plain = store(spark)
    base = Settings(min_semantic_similarity=0.3, min_score=0.25, min_semantic_only_score=0.35, min_expanded_score=0.0, semantic_anchor_threshold=0.9, max_records=4, max_tokens=30)
    arms = {
        "one": base, "two": base.using(max_relation_hops=2, max_relation_expansions=7, min_expanded_score=0.2, semantic_anchor_threshold=0.0),
        "words": base.using(enable_entity_edges=True, enable_entity_keywords=True, mmr_lambda=0.4, max_records=7, semantic_anchor_threshold=0.97), "none": base.using(enable_relation_expansion=False, max_tokens=9),
    }
    got = sweep.sweep(df, ed, pr, wa, arms).collect()
    for arm, s in arms.items():
        mine = sorted((r["prompt"], r["place"], r["id"], round(r["score"], 6), r["parent"], r["hop"]) for r in got if r["arm"] == arm)
        settings = s if s.enable_relation_expansion else s.using(max_relation_hops=0)
        assert mine == sorted(brute_sweep(*plain, settings)), arm
    assert sweep.sweep(df, ed, pr.where("false"), wa, arms).count() == 0


def test_mmr_by_several_keys_and_column_limits(spark):
    rows = [(a, p, f"{p}{i}", 1.0 - i / 10, [1.0, float(i)], n, 0.7) for a, n in (("x", 1), ("y", 3)) for p in "pq" for i in range(4)]
    df = spark.createDataFrame(rows, "arm string, prompt string, id string, score double, embedding array<double>, most int, w double")
    got = packing.maximal_marginal_relevance(df, "most", "w", ["arm", "prompt"]).groupBy("arm", "prompt").count().collect()
    assert sorted(tuple(r) for r in got) == [("x", "p", 1), ("x", "q", 1), ("y", "p", 3), ("y", "q", 3)]


def test_frequent_needles_of_prompts_meet_few_records(spark, monkeypatch):
    """Every record holds every needle: prompts take their first records without the pairs of all records and needles."""
    rows, keep = [], needles.matches

    def counted(*args, **how):
        out = keep(*args, **how)
        rows.append(out.count())
        return out

    monkeypatch.setattr(needles, "matches", counted)
    monkeypatch.setattr(needles, "FIRST", 50, raising=False)
    monkeypatch.setattr(needles, "GROWTH", 2, raising=False)
    words = [f"word{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50)]
    x = np.random.default_rng(1).normal(size=(600, 4))
    records = [(f"r{i:03}", "ab"[i % 2], "global" if i % 9 == 0 else "project", " ".join(words), x[i].tolist(), i % 4, i % 6, i % 11 == 0) for i in range(600)]
    prompts = [(f"r{j:03}", "ab"[j % 2], ["b"] if j == 0 else None, x[j].tolist()) for j in range(10)]
    wanted = [(f"r{j:03}", w, i == 4) for j in range(10) for i, w in enumerate(words[5 * j : 5 * j + 5])]
    base = Settings(min_score=0.0, min_semantic_only_score=5.0, semantic_anchor_threshold=0.0, max_records=4, enable_entity_keywords=True)
    found = sweep.candidates(
        spark.createDataFrame(records, RECORDS), spark.createDataFrame(prompts, "prompt string, project string, ancestors array<string>, embedding array<double>"),
        spark.createDataFrame(wanted, "prompt string, needle string, entity boolean"), {"a": base},
    )
    got = sorted((r["prompt"], r["id"]) for r in found.where("keyword_match").collect())
    for pid, project, ancestors, _ in prompts:
        mine = [r[0] for r in records if not r[7] and r[0] != pid and (r[1] in {project, *(ancestors or [])} or r[2] == "global")]
        assert [i for p, i in got if p == pid] == mine[:12]
    assert sum(rows) < 600 * 50 / 4
