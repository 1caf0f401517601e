import hashlib
import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keepsake.llm import byte_pairs, chunks, fingerprints, language_id, licenses, line_dedup, mixing, near_dedup, quality, token_files, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = [f"w{i}x" for i in range(400)]


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def awkward(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows and a column with a name that operators use."""
    long = "\n".join(f"line {i} " + words(i, 12) for i in range(400))
    base = words(1, 60)
    data = [
        (1, base, "en", "a", 1, "x"), (2, base, "en", "a", 1, None), (3, base + " tail", "de", "b", 1, "x"), (4, "", "en", None, 0, "x"), (5, None, None, "a", None, None),
        (6, long, "en", "a", 1, "x"), (7, "Café  au\tLAIT", "fr", "a", 1, "x"), (8, "café au lait", "fr", "b", 1, "x"), (8, "café au lait", "fr", "b", 1, "x"),
        (None, "nobody knows", "en", "a", 1, "x"), (10, "\n\n  \n", "en", "c", 1, "x"), (11, "!!! ###", "en", "c", 1, "x"), (12, "日本語 \U0001f600 àè", "en", "c", 1, "x"),
    ]
    return spark.createDataFrame(data, DOCS).withColumnRenamed("extra", "ids")


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def real(spark, n=200):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(n)


# op1


def test_fingerprints_of_awkward_documents(spark):
    got = fingerprints.fingerprint_documents(awkward(spark)).collect()
    assert len(got) == 13
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] != by[3][0]["fingerprint"]
    assert by[7][0]["fingerprint"] == by[8][0]["fingerprint"], "NFKC, case and white space are folded"
    assert by[4][0]["fingerprint"] == by[5][0]["fingerprint"], "null counts as empty"
    assert by[8][0]["group_size"] == 3 and by[8][0]["group_id"] == 7
    assert by[2][0]["near_next"] == 1.0 and by[3][0]["near_next"] == 0.0
    assert all(len(r["fingerprint"]) == 64 for r in got)


def test_edited_texts_follow_descending_ids(spark):
    docs = real(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    want = {}
    for i, (k, t) in enumerate(rows):
        half = len(t) // 2
        want[k] = hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest()
    got = fingerprints.fingerprint_documents(docs).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").upper().lower().split())
    groups = Counter(fold(t) for _, t in rows)
    assert sorted(r["group_size"] for r in got) == sorted(groups[fold(t)] for _, t in rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], "doc_id long, text string")
    groups = fingerprints.exact_groups(docs, digest=lambda canon: F.unhex(F.lit("00")) if canon is not None else canon)
    assert sorted((r["key"], r["group_key"], r["group_size"]) for r in groups.collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_no_fingerprints_of_no_documents(spark):
    assert fingerprints.fingerprint_documents(nothing(spark)).count() == 0


# op2


def test_language_is_learnt_and_held_out_rows_score(spark):
    docs = real(spark)
    found = language_id.identify(docs, language_id.train(docs, 60)).where(language_id.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_language_of_awkward_documents(spark):
    docs = awkward(spark)
    got = language_id.identify(docs.withColumn("lang_score", F.lit("clash")), language_id.train(docs)).collect()
    assert len(got) == 13
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["lang_score"] <= 1
    assert language_id.identify(nothing(spark), language_id.train(nothing(spark))).count() == 0
    assert language_id.decode(language_id.train(nothing(spark)), language_id.features("abc"))[0] == "und"


def test_language_equals_brute_force(spark):
    """Features counted n-gram by n-gram, and the loss of each codeword summed bit by bit."""
    docs = real(spark, 60)
    model = language_id.train(real(spark), 60)
    for r in language_id.identify(docs, model).collect():
        text = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        text = " " + " ".join(text.split()) + " "
        counts = Counter()
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                h = ord(text[i]) * 0x9E3779B1 % 2**32
                for c in text[i + 1 : i + n]:
                    h = (h * 31 + ord(c) * 0x85EBCA6B) % 2**32
                counts[((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32) >> 20] += 1
        length = math.sqrt(sum(counts.values()))
        bits = [sum(math.sqrt(v) / length * float(model["w"][k, b]) for k, v in counts.items()) + float(model["b"][b]) for b in range(model["code"].shape[1])]
        loss = [sum(t * math.log1p(math.exp(-c * x)) for t, c, x in zip(trust, code, bits, strict=True)) for trust, code in zip(model["trust"], model["code"], strict=True)]
        best = min(range(len(loss)), key=lambda k: loss[k])
        score = 1 / sum(math.exp(-(x - loss[best]) * len(bits)) for x in loss)
        second = sorted(loss)[1]
        assert r["lang_pred"] == model["names"][best] and abs(r["lang_score"] - score) < 1e-3
        assert r["lang_ambiguous"] == (second - loss[best] < language_id.AMBIGUOUS) or abs(second - loss[best] - language_id.AMBIGUOUS) < 1e-3


def test_codewords_differ():
    for n in (2, 4, 7, 12):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n


# op3


def brute_lines(rows):
    keys, last = defaultdict(set), {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    for i, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                keys[key(line)].add(i)
                last[key(line)] = max(last.get(key(line), -(2**63)), -(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if d is None else d
        keep = [x for x in lines if not (len(keys.get(key(x), ())) >= 3 and last[key(x)] != own)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [real, awkward, nothing])
def test_lines_equal_brute_force(spark, make):
    docs = make(spark)
    extra = spark.createDataFrame([(100 + i, f"own {i}\n  A Line That Many Documents SHARE \nA LINE that many documents share\nshort", "en", "a", 1, "x") for i in range(4)], DOCS).toDF(*docs.columns) if make is awkward else docs.limit(0)
    docs = docs.unionByName(extra) if make is awkward else docs
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.drop_lines(docs).collect()), key=repr)
    assert got == brute_lines(rows)


def test_lines_of_more_than_255_documents(spark):
    docs = spark.createDataFrame([(i, f"a line that all of the documents hold\nown {i}") for i in range(310)], "doc_id long, text string")
    for least, dropped in ((300, 309), (310, 309), (311, 0)):
        assert line_dedup.drop_lines(docs, min_docs=least).agg(F.sum("n_dropped")).first()[0] == dropped


def test_perfect_hash_is_minimal():
    hashes = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    levels, order = line_dedup.build_index(hashes)
    tail = order[sum(int(b.sum()) for b in levels) :]
    assert sorted(line_dedup.look_up(levels, tail, hashes)) == list(range(5000))
    assert (order[line_dedup.look_up(levels, tail, hashes)] == hashes).all()


# op4


def test_license_places(spark):
    pad = words(3, 50)
    docs = spark.createDataFrame(
        [(1, f"{pad} RELEASED under*** the MIT-license. {pad}"), (2, "This work is licensed under the GNU General Public License, version 2. more"), (3, pad), (4, None), (5, ""), (6, "under the MIT License")],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["license"]): (round(r["containment"], 3), r["first_word"]) for r in licenses.scan(docs).collect()}
    assert got == {(1, "MIT"): (1.0, 50), (2, "GPL-3.0"): (0.875, 0)}
    assert licenses.scan(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, (("x", "too short"),))


def license_by_hand(rows, templates):
    """Containment of every template in every window of its class, by sets of word 5-shingles."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for doc, text in rows:
        g = grams(split(text))
        for name, notice in templates:
            t = set(grams(split(notice)))
            c = 2 ** math.ceil(math.log2(len(t)))
            step, width = max(1, c // 2), c + c // 2 - 1 if c > 1 else 1
            for k in range(0, len(g), step):
                held = g[k : k + width]
                share = len(t & set(held)) / len(t)
                if share >= 0.8:
                    place = k + next(i for i, x in enumerate(held) if x in t)
                    best = out.get((doc, name), (0.0, 10**9))
                    out[doc, name] = (max(best[0], round(share, 6)), min(best[1], place))
    return out


def test_license_scan_equals_brute_force(spark, monkeypatch):
    """Whole and damaged texts, repeats, long documents, a clashing column, and templates from a table in small groups."""
    monkeypatch.setattr(licenses, "TEMPLATE_GROUP", 4)
    rng, rows = np.random.default_rng(6), []
    for i in range(60):
        name, notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = notice.split()
        for _ in range(int(rng.integers(0, 1 + len(w) // 25))):
            w[int(rng.integers(0, len(w)))] = "damaged"
        rows.append((i, words(i, int(rng.integers(0, 400))) + " " + " ".join(w) + " " + words(i + 1, 60)))
    rows += [rows[3], (60, words(7, 9000) + " " + licenses.TEMPLATES[11][1]), (61, None), (62, ""), (None, licenses.TEMPLATES[0][1])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license string")
    templates = spark.createDataFrame(list(licenses.TEMPLATES), "license string, notice string")
    got = {(r["doc_id"], r["license"]): (round(r["containment"], 6), r["first_word"]) for r in licenses.scan(docs, templates).collect()}
    assert got == license_by_hand(rows, licenses.TEMPLATES) and len(got) > 50


# op5


def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("make", [real, awkward, nothing])
def test_token_files_round_trip(spark, tmp_path, make):
    docs = make(spark)
    if make is awkward:  # an added token's string, alone, after blanks and inside words, and one id with several texts
        odd = ["<|endoftext|>", "end  <|endoftext|> x", "a <|endoftext|>b   <|endoftext|>\n <|endoftext| >", "tail  ", "it's, 'tis. (x)\n\ny\u3000 z \u00a0q", "other text"]
        more = [(8 if i % 2 else 30 + i, text, "en", "a", 1, "x") for i, text in enumerate(odd)]
        docs = docs.unionByName(spark.createDataFrame(more, DOCS).toDF(*docs.columns))
    model = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    back, freq = token_files.token_files(docs, model, 50258, 2, str(tmp_path / "f"))
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, str(tmp_path / "f"), back).collect()]
    encode, start, want = reference_ids(), 0, []
    packer = token_files.Packer("<u2")
    key = lambda r: (-(2**63) if r[0] is None else r[0], zlib.crc32(packer.pack(np.array(encode(r[1])))))
    for d, t in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key):
        ids = encode(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_changed_block_is_noticed():
    ids = np.random.default_rng(1).zipf(1.5, 5000).clip(0, 99)
    raw = token_files.scale(np.bincount(ids, minlength=100)).astype("<i8").tobytes()
    block = token_files.encode_blocks([ids], raw)[0]
    assert (token_files.decode_blocks([block], raw)[0] == ids).all()
    with pytest.raises(ValueError):
        token_files.decode_blocks([block[:-4] + b"\1\2\3\4"], raw)


# op6


def test_mixture_is_pfair(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(900)], "doc_id long, source string")
    got = mixing.schedule(docs, {"big": 0.5, "mid": 0.3, "": 0.2}, block_docs=4, period=100).collect()
    assert len(got) == 900
    blocks = {(r["source"], r["mix_block"]): r for r in got}
    slots = sorted(r["mix_slot"] for r in blocks.values())
    assert slots == list(range(len(slots))), "one block a slot, without gaps"
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in blocks.values())
    first = sorted((r["mix_slot"], s) for (s, _), r in blocks.items() if r["mix_phase"] == 0)
    seen, weight = Counter(), {"big": 0.5, "mid": 0.3, None: 0.2}
    for t, s in first:
        seen[s] += 1
        assert all(abs(seen[x] - weight[x] * (t + 1)) < 1 for x in weight)
    assert mixing.schedule(nothing(spark)).count() == 0


def mixture_by_hand(blocks, weights):
    """(source, block) by slot, with exact fractions of the weights: the released block of earliest deadline."""
    left, first, order = dict(blocks), dict.fromkeys(blocks, 0), []
    while live := {s: Fraction(str(weights[s])) for s in left if left[s]}:
        total, done, t = sum(live.values()), dict.fromkeys(live, 0), 0
        share = {s: w / total for s, w in live.items()}
        while all(left.get(s, 0) for s in live):
            ready = [s for s in live if math.floor(done[s] / share[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
            order.append((s, first[s] + done[s]))
            done[s] += 1
            left[s] -= 1
            t += 1
        for s in live:
            first[s] += done[s]
    return order


@pytest.mark.parametrize("weights", [{"a": 0.97, "b": 0.01, "c": 0.01, "d": 0.01}, {"a": 40013**0.7, "b": 977**0.7, "c": 311**0.7, "d": 7**0.7}])
def test_mixture_keeps_to_uneven_weights_over_long_runs(weights):
    exact = mixing.whole(weights)
    total, seen = sum(exact.values()), Counter()
    assert all(Fraction(exact[s], total) == Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items())
    found = mixing.turns(dict.fromkeys(weights, 10**9), exact)
    for t, (s, k, _, slot, release, deadline) in zip(range(30_000), found, strict=False):
        assert slot == t and k == seen[s] and release <= t < deadline
        seen[s] += 1
        assert all(abs(seen[x] * total - exact[x] * (t + 1)) < total for x in exact)
    assert list(mixing.turns({"a": 3, "b": 2}, {"a": 1, "b": 0}))[3][:4] == ("b", 0, 1, 3)


def test_mixture_equals_brute_force(spark):
    """Uneven weights, more sources than 500, and blocks of one document, so that every slot of a long run is seen."""
    docs = spark.createDataFrame([(i, "hot" if i % 4 else f"s{i % 2400}") for i in range(6000)], "doc_id long, source string")
    weights = {"hot": 0.937} | {f"s{i}": 0.0001 + i / 1e7 for i in range(0, 2400, 4)}
    got = mixing.schedule(docs, weights, block_docs=1, period=500).collect()
    sizes = Counter(r["source"] for r in got)
    assert len(sizes) == 601 and len(got) == 6000
    order = [x[:2] for x in mixing.turns(sizes, mixing.whole(weights))]
    assert [(r["source"], r["mix_block"]) for r in sorted(got, key=lambda r: r["mix_slot"])] == order
    small = docs.where("doc_id < 400").withColumn("source", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.when(F.col("doc_id") % 20 < 17, 1).when(F.col("doc_id") % 20 < 19, 2).otherwise(3)))
    given = {"a": 0.97, "b": 0.02, "c": 0.01}
    got = mixing.schedule(small, given, block_docs=1, period=64).collect()
    order = mixture_by_hand(Counter(r["source"] for r in got), given)
    assert [(r["source"], r["mix_block"]) for r in sorted(got, key=lambda r: r["mix_slot"])] == order


def test_mixture_of_weights_that_come_round_is_worked_out_once(spark):
    """Periods found by arithmetic: every slot equals the plain schedule, through four phases and a weight of 0."""
    docs = spark.createDataFrame([(i, "a" if i % 10 < 5 else "b" if i % 10 < 8 else "c" if i % 10 < 9 else "d" if i % 4 else "zero") for i in range(7000)], "doc_id long, source string")
    weights = {"a": 0.4, "b": 0.35, "c": 0.15, "d": 0.1, "zero": 0}
    got = mixing.schedule(docs, weights, block_docs=2).collect()
    sizes = {s: -(-n // 2) for s, n in Counter(r["source"] for r in got).items()}
    parts, repeats = mixing.whole(weights), []
    steps = sum(1 for _ in mixing.turns(sizes, parts, repeats))
    assert steps < 300 and steps + sum(blocks * times for _, _, blocks, times, _ in repeats) == sum(sizes.values())
    want = {x[:2]: x[2:] for x in mixing.turns(sizes, parts)}
    found = {(r["source"], r["mix_block"]): tuple(r[c] for c in ("mix_phase", "mix_slot", "mix_release", "mix_deadline")) for r in got}
    assert found == want and len(got) == 7000
    assert max(x[2] for x in mixing.turns(sizes, parts)) >= 3


def test_mix_keeps_all_documents(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


# op7


def test_byte_pairs_equal_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    v = byte_pairs.Vocabulary(open(path, "rb").read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    cache = chunks.ChunkCache(v.encode_chunks, limit=5000)
    rng = np.random.default_rng(5)
    signs = list("ab T'sré  \n\t\x1c\x85日本12٣!?.-_\U0001f600ßİ'll\r\v\f　")
    for _ in range(300):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(4)]
        ids, n = cache.ids(texts)
        assert [ids[a - k : a].tolist() for a, k in zip(np.cumsum(n), n, strict=True)] == [library.encode_ordinary(t) for t in texts]
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH"), 20_000))
    for text in ("a" * 5000, " " * 3000, "éà" * 2000, noise, "ab" * 700 + noise[:900] * 3, "日本語" * 900, "".join(rng.choice(list("the and ing ion"), 9000)).replace(" ", "")):
        assert cache.ids([text])[0].tolist() == library.encode_ordinary(text)
    docs = awkward(spark)
    out = byte_pairs.decode(byte_pairs.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    for r in out:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_pairs.round_trip(nothing(spark), path, public_tokenizers.PATTERN).count() == 0


# op8


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(rng.normal(0, 0.2, (300, 16)))]
    data += [(300 + i, data[7][1], "tie") for i in range(60)] + [(400, None, "x"), (420, [1.0, float("nan")], "x"), (440, [None, 1.0], "x"), (None, [1.0] * 16, "x"), (460, [], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    vectors = {i: np.floor(np.array(v, np.float32).astype(float) * 64) for i, v, _ in data[:360]}
    want = []
    for q in vectors:
        if q % 20 == 0:
            scored = sorted(((-int(vectors[q] @ v), c) for c, v in vectors.items() if c != q))[:20]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_few_survivors_get_the_same_products():
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (40, 8)), rng.normal(0, 1, (50, 8))
    for share in (0.01, 0.9):
        alive = rng.random((40, 50)) < share
        assert np.allclose(topk.products(a, b, alive)[alive], (a @ b.T)[alive])


@pytest.mark.parametrize("width", [1, 3, 5])
def test_top_k_of_short_vectors(spark, width):
    rng = np.random.default_rng(width)
    data = [(i, rng.normal(0, 1, width).tolist()) for i in range(90)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()]
    v = {i: np.floor(np.array(x) * 64) for i, x in data}
    want = [(q, r + 1, c, -s) for q in v if q % 20 == 0 for r, (s, c) in enumerate(sorted((-int(v[q] @ x), c) for c, x in v.items() if c != q)[:20])]
    assert sorted(got) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(0, 30, (50, 64))), np.floor(rng.normal(0, 30, (60, 64)))
    for s in topk.LEVELS:
        bound = topk.segment_statistics(a, s) @ topk.segment_statistics(b, s).T
        assert (bound + 1e-6 >= a @ b.T).all()


# op9


def test_quality_scores_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.with_statistics(docs)
    found = quality.score_documents(stats, quality.fit(quality.moments(stats, labels))).join(labels, "doc_id").where(language_id.held_out())
    assert found.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_quality_equals_brute_force(spark):
    """Class means and covariances from the rows themselves, and densities by determinant and solve."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("text", F.repeat(F.lit("long text, very. "), 40_000)))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    stats = quality.with_statistics(docs)
    model = quality.fit(quality.moments(stats, labels))
    got = stats.join(quality.score_documents(stats, model).distinct(), "doc_id").collect()
    known = defaultdict(list)
    for r in labels.where("quality in (0, 1)").collect():
        known[r["doc_id"]].append(r["quality"])
    read = lambda r: np.frombuffer(bytes(r["stats"]), "<f4").astype(float)
    rows = [(read(r), q) for r in stats.collect() for q in known[r["doc_id"]] if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    scale = np.sqrt(np.maximum(x.var(0), 1e-8))
    z = (x - x.mean(0)) / scale
    cov = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    own = {k: (1 - quality.POOLED) * cov[k] + quality.POOLED * pooled for k in (0, 1)}
    own = {k: (1 - quality.SPHERE) * c + quality.SPHERE * np.trace(c) / len(c) * np.eye(len(c)) for k, c in own.items()}
    single = Counter(r["doc_id"] for r in got)
    for r in got:
        if single[r["doc_id"]] > 1:
            continue
        v = (read(r) - x.mean(0)) / scale
        density = {}
        for k in (0, 1):
            gap = v - z[y == k].mean(0)
            density[k] = -0.5 * (gap @ np.linalg.solve(own[k], gap) + np.linalg.slogdet(own[k])[1]) + math.log((y == k).mean())
        assert abs(r["score"] - 1 / (1 + math.exp(min(500, density[0] - density[1])))) < 1e-5


def test_quality_of_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (6, None), (7, 0), (7, 0), (99, 5), (None, 1), (12, 0), (11, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(docs)
    for model in (quality.fit(quality.moments(stats, labels)), quality.fit(quality.moments(stats, labels.limit(0)))):
        got = [r["score"] for r in quality.score_documents(stats, model).collect()]
        assert len(got) == 13 and all(0 <= s <= 1 for s in got)
    assert quality.fit(quality.moments(quality.with_statistics(nothing(spark)), labels)) == {"constant": 0.5}


# op10


def shingles_of(text):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    if len(w) >= 5:
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return Counter([tuple(w)]) if w else Counter([(text or "").strip()])


def brute_classes(rows):
    sets = [shingles_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= 0.8 - 1e-12:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def test_near_classes_equal_brute_force(spark):
    base = words(9, 200).split()
    data = [(r["doc_id"], r["text"]) for r in real(spark).collect()]
    for i in range(40):  # chains of small edits: ends are far apart
        base = base[:i * 5] + [f"new{i}"] + base[i * 5 + 1:]
        data.append((10_000 + i, " ".join(base)))
    data = sorted(data)
    got = near_dedup.classify(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["key"]: r["class_id"] for r in got} == brute_classes(data)


def test_texts_of_one_doc_id(spark):
    """A doc_id with two texts links both, and neither is lost; equal rows stay once, the least of them."""
    a, b = words(21, 80), words(22, 80)
    data = [(1, a, "x"), (1, b, "x"), (2, a + " tail", "x"), (3, b + " tail", "x"), (4, words(23, 50), "z"), (4, words(23, 50), "y"), (5, words(24, 50), "x"), (5, words(25, 50), "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, node string")
    assert {r["key"]: (r["class_id"], r["class_size"]) for r in near_dedup.classify(docs).collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1)}
    kept = sorted(map(tuple, near_dedup.keep_first(docs).collect()))
    assert kept == sorted([data[0], data[1], data[5], data[6], data[7]])


def test_near_pairs_are_found_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.83, the hardest, against exact weighted Jaccard similarity: all but few are linked."""
    rng, data = np.random.default_rng(12), []
    for i in range(400):
        w = [f"p{i}q{k}" for k in range(120)]
        v = list(w)
        for at in rng.choice(np.arange(3), 2, replace=False):
            v[10 + 40 * at + int(rng.integers(0, 20))] = "changed"
        data += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v[: 119 - int(rng.integers(0, 2))]))]
    sets = [shingles_of(t) for _, t in data]
    alike = [sum((a & b).values()) / sum((a | b).values()) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    hard = [i for i, s in enumerate(alike) if 0.8 <= s]
    assert len(hard) > 300 and min(alike[i] for i in hard) < 0.83
    got = {r["key"]: r["class_id"] for r in near_dedup.classify(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in hard) >= 0.99 * len(hard)
    assert all(got[2 * i] != got[2 * i + 1] for i, s in enumerate(alike) if s < 0.8)


def test_near_dedup_of_awkward_documents(spark):
    docs = awkward(spark)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert [i for i in ids if i in (1, 2, 3)] == [1]
    assert sum(i in (7, 8) for i in ids) == 2 and sum(i in (4, 5, 10) for i in ids) == 1 and None in ids
    assert near_dedup.classify(nothing(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    a = "one two three four five six seven " * 30
    texts = [a, a + words(4, 60)]
    doc, hashed, count = near_dedup.shingles(texts)
    m = 4000
    values = near_dedup.bag_minhash(2, doc, hashed, count, m)
    x, y = shingles_of(texts[0]), shingles_of(texts[1])
    exact = sum((x & y).values()) / sum((x | y).values())
    assert abs((values[0] == values[1]).mean() - exact) < 0.04


# the pipeline


@pytest.mark.parametrize("make", [awkward, nothing])
def test_stages_of_awkward_documents(spark, make):
    """Nulls, empty texts, repeats, and columns with the names that the operators use keep their values."""
    import corpus_pipeline

    docs = make(spark).withColumns({c: F.lit(f"own {c}") for c in ("lang_pred", "kept_text", "n_lines", "mix_slot", "row", "key")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in ("lang_pred", "kept_text", "n_lines", "mix_slot", "row", "key")), name
        if name in ("line_dedup", "mix_sources"):
            assert len(rows) == docs.count()
        if name == "language_id":
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
        docs = spark.createDataFrame(rows, out.schema)
    last = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert sorted((r["doc_id"] for r in last), key=str) == sorted((r["doc_id"] for r in docs.collect()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = real(spark, 120)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 80 < docs.count() <= 120


def test_pipeline_result_holds_the_mixture(spark, tmp_path):
    """run() against brute force: every text left after stage 3, the library's ids of it, and its place in the mixture."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = real(spark, 150).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "hot").when(F.col("doc_id") % 10 < 9, "b"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = spark.createDataFrame((out := stage(spark, left, str(tmp_path))).collect(), out.schema)
    rows = left.withColumn("h", F.xxhash64(F.lit(11), "doc_id")).collect()
    assert set(got) == {r["doc_id"] for r in rows}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    queues = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["h"] % mixing.BUCKETS, r["h"], r["doc_id"])):
        queues[r["source"] or ""].append(r["doc_id"])
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert bytes(got[r["doc_id"]]["ids"]) == np.array(ids, "<u4").tobytes()
    order = mixture_by_hand({s: -(-len(q) // mixing.BLOCK_DOCS) for s, q in queues.items()}, {s: len(q) ** mixing.TEMPER for s, q in queues.items()})
    expected = {}
    for slot, (s, k) in enumerate(order):
        for place, doc in enumerate(queues[s][k * mixing.BLOCK_DOCS : (k + 1) * mixing.BLOCK_DOCS]):
            expected[doc] = (slot, place)
    assert {d: (r["mix_slot"], r["mix_place"]) for d, r in got.items()} == expected


def test_token_ids_follow_the_order_that_mix_sources_wrote(spark, tmp_path):
    import corpus_pipeline

    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    found = []
    for name, rows in (("mixed", mixed), ("plain", docs.coalesce(2))):
        rows.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        found.append({r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in corpus_pipeline.to_token_ids(spark, read, "").collect()})
    assert found[0] == {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixing.schedule(docs).collect()}
    assert found[1] != found[0]  # without the stage the places are others


# op8: pruning


def brute_best(q_ids, q, ids, c, k):
    out = []
    for i, v in zip(q_ids, q, strict=True):
        scores = sorted((-int(v @ w), int(j)) for j, w in zip(ids, c, strict=True) if j != i)
        out += [(int(i), j, -s) for s, j in scores[:k]]
    return sorted(out)


@pytest.mark.parametrize("n,share", [(2000, 0.5), (20_000, 0.5)])
def test_bounds_drop_most_pairs_of_clustered_vectors(n, share):
    rng = np.random.default_rng(n)
    steps = np.repeat(rng.normal(size=(40, 8)), 8, axis=1)  # vectors that are level over stretches, as segments can tell
    x = np.floor(64 * (steps[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, 64))))
    ids, seen = rng.permutation(n).astype(np.int64), {}
    got = topk.best_in_cell(ids[:50], x[:50], ids, x, 20, seen)
    assert sorted(zip(*(g.tolist() for g in got), strict=True)) == brute_best(ids[:50], x[:50], ids, x, 20)
    assert seen["pairs"] == 50 * n and seen["exact"] < share * seen["pairs"], seen


@pytest.mark.parametrize("seed", range(8))
def test_best_in_cell_with_ties_repeats_and_few_candidates(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 5000)), int(rng.integers(1, 30))
    x = rng.integers(-2, 3, (n, int(rng.integers(1, 20)))).astype(float)
    ids = rng.integers(0, n, n) if seed % 2 else rng.permutation(n)
    ids = ids.astype(np.int64)
    q = np.unique(ids[:40], return_index=True)[1]
    got = topk.best_in_cell(ids[q], x[q], ids, x, k)
    assert sorted(zip(*(g.tolist() for g in got), strict=True)) == brute_best(ids[q], x[q], ids, x, k)


# op6: targets where none are given


def test_default_targets_come_round_and_stay_near_the_tempered_sizes():
    totals = {"hot": 9_000_000_000, "a": 1_000_000, "b": 12_345, "tiny": 1}
    targets = mixing.tempered(totals)
    every = sum(n**mixing.TEMPER for n in totals.values())
    assert all(abs(targets[s] - n**mixing.TEMPER * mixing.SHARES / every) <= 1 for s, n in totals.items()) and min(targets.values()) == 1
    repeats = []
    steps = sum(1 for _ in mixing.turns({s: -(-n // 16) for s, n in totals.items()}, targets, repeats))
    assert steps < 5 * 2 * (mixing.SHARES + len(totals)), "a few periods, however many documents"
    assert repeats


# op3: a line in most documents


def test_a_common_line_is_dealt_to_several_copies(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", 100)
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that all documents have\nown line of document "), F.col("id").cast("string")).alias("text"))
    got = line_dedup.drop_lines(df)
    assert sorted(tuple(r) for r in got.groupBy("n_lines", "n_dropped").count().collect()) == [(2, 0, 1), (2, 1, 1499)]


# op9: the statistics, one text at a time


def plain_statistics(t):
    words, at = [], 0
    while at < len(t):
        end = at
        while end < len(t) and t[end].isalnum():
            end += 1
        if end > at:
            words.append(t[at:end])
        at = max(end, at + 1)
    n, some = len(t), max(len(t), 1)
    letters = sum(c.isalpha() for c in t)
    upper = lambda c: c.isalpha() and ord(c) < 0x250 and c.isupper()
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    count = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / count
    spread = math.sqrt(max(0.0, sum(s * s for s in sizes) / count - mean**2))
    common, share = ".,;:'\"?-()", lambda k: math.sqrt(k / some)
    other = sum(not c.isalnum() and not c.isspace() and c not in common + "!|" for c in t)
    return [
        math.log1p(n), letters / some, math.sqrt(sum(map(upper, t)) / max(letters, 1)), sum(c.isspace() for c in t) / some, share(sum(c.isalnum() and not c.isalpha() for c in t)),
        share(sum(c in common for c in t)), share(other), share(t.count("!")), share(t.count("|")), share(t.count("\n")), math.sqrt(sum(a == b for a, b in zip(low, low[1:], strict=False)) / count),
        math.log1p(len(set(low))) / math.log1p(count) if words else 0.0, math.log1p(mean), math.log1p(spread), sum(s <= 3 for s in sizes) / count, math.sqrt(sum(upper(w[0]) for w in words) / count),
    ]


def test_statistics_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    signs = list("abAB Zz019 .,;!|\n\t-()?\"'#é ÉΩ日😀²½ß") + ["the ", "The the ", "x x x "]
    texts = ["", " ", "a", "A", "!!!", "a a A b", "\n\n", "One two, TWO two.", "日本語 ²½ ΩΩ ÉÉ", "a\nb\n"] + ["".join(rng.choice(signs, rng.integers(0, 80))) for _ in range(300)]
    texts += [r["text"] for r in real(spark, 40).collect()]
    got = quality.statistics(texts)
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for t, row in zip(texts, got, strict=True):
        np.testing.assert_allclose(row, plain_statistics(t), rtol=1e-9, atol=1e-7, err_msg=repr(t[:80]))
