"""Each operator on odd tables, against brute force, and through round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempolith.llm import chat, common, cutting, fingerprints, langid, mixing, near_dups, packing, rangecoder, shingles, token_counts, token_files, tokens, topk, toxicity

BYTE, WORD, PIECE = (tokens.public_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, text):
    return np.array(tokens.cached_tokenizer(path).tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


# --- 1 language identification --------------------------------------------------------------------


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = langid.fit(docs.select("doc_id", "text", "lang"))
    got = langid.identify(docs.select("doc_id", "text", "lang"), m).filter(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert sum(r["rejected"] for r in got) <= 1


def test_unknown_languages_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = langid.fit(docs.filter("lang IN ('en', 'de')").select("doc_id", "text", "lang"))
    m.reach[:] = np.where(np.isfinite(m.reach), m.reach, 10)
    russian = "Съешь ещё этих мягких французских булок да выпей чаю. " * 20
    assert m.predict([russian])[3].tolist() == [True]


RUSSIAN = "Съешь ещё этих мягких французских булок да выпей чаю. " * 20


def test_rare_languages_reject_too(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    de = docs.filter(~langid.held_out(F.col("doc_id")) & (F.col("lang") == "de")).orderBy("doc_id")
    unseen = [r["text"] for r in docs.filter(langid.held_out(F.col("doc_id")) & (F.col("lang") == "de")).collect()]
    for n in (1, 2, 8, 30):
        m = langid.fit(docs.filter("lang = 'en'").union(de.limit(n)))
        assert np.isfinite(m.reach).all() and (m.mean > 0).all(), n
        assert m.predict([RUSSIAN])[3].tolist() == [True], n
        langs, _, _, rejected = m.predict(unseen)
        assert n < 8 or sum(rejected) <= 1, n


def test_a_few_letters_are_no_language(spark):
    docs = spark.createDataFrame([(i, "x y", "xx") for i in range(1)] + [(i, t, "yy") for i, t in enumerate(["é", "a"], 10)], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert m is None or np.isfinite(m.reach).all() and np.isfinite(m.mean).all()


def test_languages_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "score")
    m = langid.fit(docs)
    got = langid.identify(docs, m).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1
    assert langid.fit(no_docs.select("doc_id", "text", "lang")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, m).count() == 0


def test_kneser_ney_adds_up_to_one():
    keys, _, _ = langid.coded(["abra cadabra", "a bad cab"], langid.alphabet(["abcdr"]))
    m = langid.KneserNey(keys)
    for context in (keys[3] >> np.uint32(8), np.uint32(0x010101), np.uint32(0x060606)):
        every = (np.uint32(context) << np.uint32(8)) | np.arange(langid.V, dtype=np.uint32)
        assert m.probability(every, 4).sum() == pytest.approx(1, abs=1e-9)


def test_merged_model_agrees_with_each_language():
    table = langid.alphabet(["abcdefghij"])
    a, b = (langid.KneserNey(langid.coded([t], table)[0]) for t in ("abcabdabe faj", "hij hia hib a"))
    m = langid.Model(["a", "b"], [a, b], table)
    keys = langid.coded(["abc hij fah jjj xyz"], table)[0]
    want = np.log(np.stack([a.probability(keys, 4), b.probability(keys, 4)], axis=1))
    assert np.allclose(m.log_probabilities(keys), want, atol=1e-5)


# --- 2 mixing ---------------------------------------------------------------------------------------


def water_fill(sizes, weights, share, cap):
    total, capped = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [cap * sizes[i] if i in capped else (left * weights[i] / w if w else 0) for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in capped and t[i] >= cap * sizes[i]}
        if not more:
            return t
        capped |= more


def test_mix_targets_and_takes(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, n, t in zip(names, sizes, want):
        assert {r["source_size"] for r in by[s]} == {n}
        assert by[s][0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 16
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in by[s])
    text = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert sum(r["size"] for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in [x["text"] for x in odd_docs.collect()]) and text
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_mixed_documents_have_the_words_taken(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = defaultdict(int)
    for r in out.collect():
        got[r["source"]] += words(r["text"])
    want = defaultdict(int)
    for r in mixing.mix(odd_docs).collect():
        want[r["source"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(no_docs).count() == 0


def test_seats_against_repeated_division(spark):
    votes = [53, 24, 23, 7, 0, 100, 1]
    df = spark.createDataFrame([(1, f"p{i}", v, 37) for i, v in enumerate(votes)], "g int, k string, v long, n long")
    got = {r["k"]: r["seats"] for r in mixing.seats(df, ["g"], ["k"], "v", "n").collect()}
    won = [0] * len(votes)
    for _ in range(37):
        i = max((i for i in range(len(votes)) if votes[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    assert [got[f"p{i}"] for i in range(len(votes))] == won


# --- 3 token files ----------------------------------------------------------------------------------


def test_range_coder_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 2047, 2048, 2049, 9000):
        for ids in (rng.integers(0, 50257, n), rng.integers(0, 4, n), np.full(n, 2**32 - 1), np.arange(n) % 7):
            ids = ids.astype("<u4")
            assert np.array_equal(rangecoder.decode_group(rangecoder.encode_group(ids)), ids)


def test_blocks_decode_alone_and_damage_is_seen():
    ids = np.random.default_rng(2).integers(0, 300, 10_000).astype("<u4")
    data = rangecoder.encode_group(ids)
    assert np.array_equal(rangecoder.decode_group(data, range(2, 4)), ids[4096:8192])
    with pytest.raises(ValueError):
        bad = bytearray(data)
        bad[-40] ^= 8
        rangecoder.decode_group(bytes(bad))


def test_repeats_are_predicted():
    ids = np.tile(np.random.default_rng(3).integers(0, 50000, 64), 256).astype("<u4")
    assert len(rangecoder.encode_group(ids)) * 8 / len(ids) < 1.5


def test_token_files(odd_docs, no_docs):
    got = token_files.token_files(odd_docs, BYTE, 2).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.append(library(BYTE, r["text"]), 2).astype("<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(no_docs, BYTE, 2).count() == 0


def split(ids, lengths):
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if len(lengths) else []


def test_cached_ids_are_the_librarys():
    texts = ["a  b", "  a", " a", "a ", "a\n b", "a \n b\t c", "", None, "\x1c a\x1c b", "x<|endoftext|>y z", "a b", " ́x é", "ΑΣ ΣΑΣ.", "don't  it's\r\nno", "   ", "\n\n x", "word \x85 y", "I'LL  'll 'Re 12345 6", "End. Next, ok.\x01 b", "İstanbul ǅ. ß,", "One, two.\nThree four,\n's x.\n", "a.\nB c\n.D e,\x02f", "x,\ny", ".\n.", "\x03q r. s", "a. \n b", "A.B, c..d ., e",
             "a\n\nb c. d,\n\ne\n", "x\u3000y z\u2003 q", "ab" * 30 + " " + "x" * 300, "e\u0301t\u00e9 \u212bngstr\u00f6m ﬁn", "aaaa bbbbbbb aaabaaab mississippi Mississippi"]
    for path in (BYTE, WORD):
        t = tokens.CachedTokenizer(path)
        for some in (texts, texts, [x for x in texts if x], texts[::-1], texts[:1], ["", None], []):
            assert split(*t.encode(pa.array(some, pa.string()))) == [library(path, x).tolist() for x in some]


def test_merges_are_the_librarys(spark, sf_dir):
    rnd = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyzaeiounrstäöüßéèê")
    words = ["".join(rnd.choice(letters, rnd.integers(1, 30))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 3000, 100)] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for path in (BYTE, WORD):
        for cache in (tokens.CACHE, 50):  # forgetting must not change ids
            t = tokens.CachedTokenizer(path, cache)
            for _, ids, lengths in t.batches(pa.array(texts, pa.string()), 20_000):
                got = split(ids, lengths)
                assert got == [library(path, x).tolist() for x in texts[: len(got)]]
                texts = texts[len(got) :] + texts[: len(got)]
            assert t.slots.n < 20_000 if cache == 50 else True


def test_parts_without_spaces_dont_fill_the_cache():
    rnd = np.random.default_rng(11)
    for path in (BYTE, WORD):
        t = tokens.CachedTokenizer(path)
        for _ in range(3):
            texts = ["".join(map(chr, rnd.integers(0x4E00, 0x9000, 2000))) for _ in range(60)] + ["a" * 500, "b" * 64 + " x", "x" * 65 + ". y"]
            got = [x for _, ids, lengths in t.batches(pa.array(texts, pa.string()), 100_000) for x in split(ids, lengths)]
            assert got == [library(path, x).tolist() for x in texts]
        assert max(len(x.encode()) for x in t.slots.number) <= tokens.KEEP
        assert len(t.slots.ids) < 300_000


# --- 4 token counts ---------------------------------------------------------------------------------


def test_token_counts_and_cache(spark, odd_docs, no_docs):
    path = common.scratch(spark, "counts-test")
    got = token_counts.count_tokens(odd_docs, PIECE, path, limit=100).collect()
    assert len(got) == odd_docs.count()
    sp = tokens.pieces(PIECE)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    n = spark.read.parquet(path).count()
    assert n == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_counts.count_tokens(odd_docs, PIECE, path).collect()
    assert spark.read.parquet(path).count() == n
    assert token_counts.count_tokens(no_docs, PIECE).count() == 0


# --- 5 top-k ----------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8)) * rng.uniform(0.1, 4, size=(400, 1))
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (420, [None, 1.0]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, [1.0, 2.0]), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, sample=50).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(64 * np.array([*r, *[0.0] * (8 - len(r))])).astype(np.int64) for i, r in rows if r is not None and all(x is not None and np.isfinite(x) for x in r)}
    want = []
    for q in sorted(i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_top_k_of_big_components_and_many_ties(spark):
    big = [[2**23 + i % 3, -(2**22) * (i % 2), i] for i in range(300)]  # scores beyond 2 ** 52, many of them equal
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(big)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=9, sample=40).orderBy("query_id", "rank").collect()]
    x = [[64 * c for c in r] for r in big]
    want = []
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in range(300) if i != q)[:9]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "vec_id long, embedding array<double>")
    got = topk.top_k(same, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 5 * 4096) for i in range(1, 6)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"), F.lit(True))


def test_top_k_of_queries_with_one_id(spark):
    rows = [(0, [4.0, 0.0]), (0, [0.0, 3.0]), (0, [0.0, 3.0])] + [(i, [float(i % 7), float(i % 11)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=5).collect())
    want = []
    for q in ([256, 0], [0, 192]):
        best = sorted((-64 * sum(a * b for a, b in zip(q, x)), i) for i, x in rows if i)[:5]
        want += [(0, k + 1, i, int(-s)) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 8192), (0, 2, 3, 2048), (20, 1, 0, 8192), (20, 2, 3, 4096)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# --- 6 packing --------------------------------------------------------------------------------------


def check_packing(rows, texts):
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r["row"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_row) == len(texts)
    pools = defaultdict(list)
    for d, t in texts:
        pools[d].append(np.append(library(WORD, t), 2).astype("<u4"))
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        fits = [x for x in pools[pieces[0]["doc_id"]] if len(x) == pieces[0]["doc_tokens"] and all(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)]
        assert fits and sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        n = sum(p["length"] for p in pieces)
        assert n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    return padding


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORD).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()]) == 0
    assert packing.pack(no_docs, WORD).count() == 0


def test_cutting_stock_reaches_the_bound():
    demand = np.zeros(64, dtype=np.int64)
    demand[[39, 23, 31, 15, 7]] = [97, 97, 150, 50, 100]
    patterns, use = cutting.solve(demand, 64)
    assert np.allclose(use @ patterns, demand)
    assert (patterns @ np.arange(1, 65) <= 64).all()
    assert use.sum() >= demand @ np.arange(1, 65) / 64 - 1e-9
    assert use.sum() <= 1.05 * demand @ np.arange(1, 65) / 64
    n = cutting.whole_counts(patterns, use, demand, 64, 4096)
    assert (demand - n @ patterns >= 0).all()


def test_best_pattern_against_enumeration():
    import itertools

    prices = np.array([0.0, 0.3, 0.5, 0.1, 0.9])
    best = max(sum(prices[i] * c for i, c in enumerate(k)) for k in itertools.product(range(12), range(6), range(4), range(3), range(3)) if sum((i + 1) * c for i, c in enumerate(k)) <= 11)
    value, pattern = cutting.best_pattern(prices, 11)
    assert value == pytest.approx(best) and pattern @ np.arange(1, 6) <= 11 and pattern @ prices == pytest.approx(best)


# --- 7 near-duplicates ------------------------------------------------------------------------------


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k):
    sets = {d: shingle_set(t, k) for d, t in rows}
    at = {d: d for d in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                at[q] = p
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    import random

    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 260))]
        for _ in range(rnd.randrange(1, 14)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "Solo"), (n + 3, "solo"), (n + 4, "Solo\tsolo")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 80).collect()
    groups, sizes = brute_groups(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (sizes[d], g, g == d) for d, g in groups.items()}


def test_near_duplicates_of_odd_documents(odd_docs, no_docs):
    got = near_dups.near_duplicates(odd_docs, 5, 80).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[7]["component_id"] == 1 and by[3]["component_id"] == 3 and by[3]["n_shingles"] == 0
    kept = near_dups.deduplicated(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 7 not in ids and 3 in ids and None in ids
    assert near_dups.near_duplicates(no_docs).count() == 0 and near_dups.deduplicated(no_docs).count() == 0


def test_sketches_estimate_similarity():
    x = shingles.mix(np.arange(60_000, dtype=np.uint64), 5)
    parts = [p for i in range(200) for p in (np.sort(x[i * 250 : i * 250 + 180]), np.sort(x[i * 250 + 20 : i * 250 + 200]))]
    s = shingles.fast_sketches(np.concatenate(parts), np.full(400, 180), 256)
    agree = (s[0::2] == s[1::2]).mean(axis=1)
    assert agree.mean() == pytest.approx(0.8, abs=0.01) and agree.std() < 0.03
    tiny = shingles.fast_sketches(x[:3], np.array([1, 0, 2]), 256)
    assert tiny.shape == (3, 256)


@pytest.mark.parametrize("k", (2, 5))
def test_near_duplicates_of_a_short_document_alone_in_its_partition(spark, k):
    for n in range(1, 5):
        texts = ["a b c d"[: 2 * n - 1]] * 2
        assert shingles.shingle_sets(texts[:1], k)[1].tolist() == [max(1, n - k + 1)]
        rows = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id"), k=k).collect()
        assert {(r["n_shingles"], r["component_id"]) for r in rows} == {(max(1, n - k + 1), 0)}


def sketch_by_hand(h, t):
    """The least (round, digest) of each bin, over all rounds, with Python's unbounded integers."""
    best = [None] * t
    for i in range(2 * t):
        if None not in best:
            break
        x = shingles.mix(h, i + 1)
        bins = (((x & np.uint64(1023)) * np.uint64(0x5851F42D4C957F2D) + (x >> np.uint64(32)) * np.uint64(0x14057B7EF767814F)) >> np.uint64(33)) % np.uint64(t)
        for b, v in zip(bins.tolist() if i < t else [i - t] * len(h), x.tolist()):
            best[b] = min(best[b] or (i, v), (i, v))
    return best


@pytest.mark.parametrize("t", (16, near_dups.COORDINATES, near_dups.FINE))
def test_sketches_of_small_sets_against_brute_force(t):
    rng = np.random.default_rng(3)
    for n in range(5, 13):
        a = rng.integers(0, 2**64, n + 1, dtype=np.uint64)
        got = shingles.fast_sketches(np.concatenate([a[:-1], a]), np.array([n, n + 1]), t)
        x, y = sketch_by_hand(a[:-1], t), sketch_by_hand(a, t)
        assert (got[0] == got[1]).tolist() == [p == q for p, q in zip(x, y)]


def test_small_sets_above_the_threshold_pass_the_longer_sketches():
    rng = np.random.default_rng(4)
    least = 0.8 - near_dups.DEVIATIONS * (0.8 * 0.2 / near_dups.FINE) ** 0.5
    for few, more in ((5, 6), (6, 7), (8, 10), (9, 11)):
        sets = [rng.integers(0, 2**64, more, dtype=np.uint64) for _ in range(100)]
        fine = shingles.fast_sketches(np.concatenate([np.concatenate([s[:few], s]) for s in sets]), np.array([few, more] * 100), near_dups.FINE).astype(np.uint8)
        assert ((fine[::2] == fine[1::2]).mean(axis=1) >= least).all()


# --- 8 chats ----------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    mark = chat.MARK
    texts = ["hi", "", None, "<|im_end|><|im_start|>assistant ok", f"{mark}<|", f"<{mark}|x", f"<{mark}{mark}|", "a\n<|\nb", "<|im_start|>user\nx<|im_end|>\n", "é😀"]
    rows = [(c, t, r, x) for c, x in enumerate(texts) for t, r in enumerate(["user", "assistant", None, f"o\ndd{mark}n"])] + [(None, None, "assistant", "late"), (7, 1, "assistant", "tie"), (7, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fingerprint", F.lit("clash"))
    out = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    raw = {r["conv_id"]: r["formatted"] for r in out.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [t[2:] for t in turns]
        assert back[c]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
        assert back[c]["formatted_chars"] == len(raw[c]) and raw[c].count("<|im_start|>") == len(turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_layouts_are_told_apart(spark):
    tables = {
        "instruction string, input string, output string": [("do", "this", "done")],
        "prompt string, response string, extra int": [("p", "r", 1)],
        "messages array<struct<role:string,content:string>>": [([("user", "u"), ("assistant", "a")],)],
        "conversations array<struct<from:string,value:string>>": [([("human", "u"), ("gpt", "a")],)],
    }
    want = [[("user", "do\n\nthis"), ("assistant", "done")], [("user", "p"), ("assistant", "r")], [("user", "u"), ("assistant", "a")], [("user", "u"), ("assistant", "a")]]
    for (schema, rows), turns in zip(tables.items(), want):
        got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, schema))).first()
        assert [tuple(t) for t in got["turns"]] == turns
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "x int"))


def test_layouts_of_mixed_tables_are_chosen_by_row(spark):
    schema = "id int, instruction string, output string, response string, prompt string, messages string"
    rows = [
        (1, "i", "o", None, None, None), (2, "i", None, "r", None, None), (3, None, None, "r", "p", None), (4, None, None, None, None, '[{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]'),
        (5, "i", "o", "r", "p", "[]"), (6, None, None, None, None, "{broken"), (7, None, None, None, None, None), (8, "only", None, None, None, None),
    ]
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["fingerprint"]) for r in chat.canonical(spark.createDataFrame(rows, schema)).collect()}
    mapping = lambda *paths: chat.fingerprint(list(paths))
    assert got[1] == ([("user", "i"), ("assistant", "o")], mapping("instruction", "output"))
    assert got[2] == ([("user", "i"), ("assistant", "r")], mapping("instruction", "response"))
    assert got[3] == ([("user", "p"), ("assistant", "r")], mapping("prompt", "response"))
    assert got[4] == ([("user", "u"), ("assistant", "a")], mapping("messages"))
    assert got[5] == got[1]
    assert got[6][0] == [] and got[7][0] == [] and got[8][0] == [("user", "only")]
    maps = spark.createDataFrame([(9, [{"role": "user", "content": "m"}, {"content": "x", "name": "y"}])], "id int, messages array<map<string,string>>")
    assert [tuple(t) for t in chat.canonical(maps).first()["turns"]] == [("user", "m"), ("", "x")]


# --- 9 toxicity -------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, recall, share", [("0.01", 0.85, 0.01), ("0.1", 0.9, 0.003)])
def test_toxicity_held_out(spark, sf_dir, size, recall, share):
    """Five folds: what a model without these labels finds. 40 toxic labels of four languages teach less than 360."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', size)}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.labelled(docs, labels, 6000).collect()
    found = wrong = 0
    for fold in range(5):
        learn = [r for r in rows if r["doc_id"] % 5 != fold]
        m = toxicity.fit_rows([r["text"] for r in learn], [r["grade"] for r in learn])
        for r in rows:
            if r["doc_id"] % 5 == fold and m.judge(r["text"])[2]:
                found, wrong = found + (r["grade"] == 2), wrong + (r["grade"] < 2)
    toxic = sum(r["grade"] == 2 for r in rows)
    assert found / toxic >= recall and wrong <= share * len(rows)


def test_toxicity_of_its_own_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["is_toxic"] and r["toxic"] == 1 for r in got) >= 0.9 * sum(r["toxic"] == 1 for r in got)
    assert not any(r["is_toxic"] and r["toxic"] == 0 for r in got)


def test_fit_against_plain_proximal_steps():
    """The same penalised likelihood, written down plainly and minimised by many small steps from zero."""
    rnd = np.random.default_rng(5)
    names = ["aa", "bb", "cc", "dd", "ee"]
    x = rnd.integers(0, 2, (400, 5))
    x[:, 4] = 1
    s = x @ np.array([2.0, 1.2, 0.0, 0.0, 0.0]) + rnd.logistic(size=400)
    y = (s > 1).astype(int) + (s > 2.5)
    l1, l2 = 3e-3, 1e-3
    m = toxicity.fit_rows([" ".join(n for n, on in zip(names, r) if on) for r in x], y.tolist(), l1=l1, l2=l2, rounds=3000)
    # how telling each word is: twice the log likelihood ratio of its share of the highest grade
    n, a, share = x.sum(axis=0), x[y == 2].sum(axis=0), (y == 2).mean()
    ratio = np.array([2 * (i * np.log(i / (k * share)) + (k - i) * np.log((k - i) / (k * (1 - share)))) if i > share * k else 0 for i, k in zip(a, n)])
    size = np.sqrt(np.maximum(ratio / toxicity.TELLING, 0.1))
    f = x * np.log(2) * size

    def loss(u, t):
        cdf = lambda z: 1 / (1 + np.exp(-z))
        below = np.stack([cdf(t[0] - f @ u), cdf(t[1] - f @ u)])
        p = np.where(y == 0, below[0], np.where(y == 1, below[1] - below[0], 1 - below[1]))
        return -np.log(p).mean() + l1 * np.abs(u).sum() + l2 / 2 * (u @ u)

    def slope(u, t, h=1e-6):
        z = np.concatenate([u, t])
        plain = lambda z: loss(z[:5], z[5:]) - l1 * np.abs(z[:5]).sum()
        return np.array([(plain(z + h * e) - plain(z - h * e)) / (2 * h) for e in np.eye(7)])

    u, t = np.zeros(5), np.array([0.0, 1.0])
    for _ in range(4000):
        g = slope(u, t)
        u, t = u - 0.3 * g[:5], t - 0.5 * g[5:]
        u = np.sign(u) * np.maximum(np.abs(u) - 0.3 * l1, 0)
    own = np.array([m.weights.get(n, 0.0) for n in names]) / size
    assert loss(own, np.array(m.thresholds)) <= loss(u, t) + 1e-4


def test_toxic_stems_and_words_are_learned():
    import random

    rnd = random.Random(8)
    clean = [f"{a}{b}" for a in "ba be bi bo bu da de di".split() for b in "ka ke ki ko lan mo ra".split()]
    texts, grades = [], []
    for i in range(800):
        w = [rnd.choice(clean) for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(["vermin", "zlobn" + rnd.choice(clean)])
        texts.append(" ".join(w))
        grades.append(int(bad))
    m = toxicity.fit_rows(texts[:600], grades[:600])
    assert [m.grades(t)[0] < 0.5 for t in texts[600:]] == [bool(g) for g in grades[600:]]
    m = toxicity.fit_rows(texts[:600], [2 * g for g in grades[:600]])
    assert [m.judge(t)[2] for t in texts[600:]] == [bool(g) for g in grades[600:]]


def test_ordinal_grades():
    texts = ["fine day"] * 30 + ["bad day"] * 30 + ["awful day"] * 30
    m = toxicity.fit_rows(texts, [0] * 30 + [1] * 30 + [2] * 30)
    s = [sum(j * p for j, p in enumerate(m.grades(t))) for t in ("fine day", "bad day", "awful day")]
    assert s[0] < s[1] < s[2] and m.thresholds == sorted(m.thresholds)
    assert all(sum(m.grades(t)) == pytest.approx(1) for t in ("x", "bad bad", None))


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (9, None, None), (12, None, 1), (20, 1, 0)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, m).collect()
    assert len(got) == odd_docs.count() and all(r["severity"] == 0 and not r["is_toxic"] for r in got if not r["text"])
    one_grade = toxicity.fit(odd_docs, labels.filter("toxic = 0"))
    assert not any(r["is_toxic"] for r in toxicity.score(odd_docs, one_grade).collect())
    assert toxicity.score(no_docs, m).count() == 0
    assert toxicity.fit(no_docs, labels).weights == {}


# --- 10 fingerprints --------------------------------------------------------------------------------


def test_sketches_peel_to_the_difference():
    rng = np.random.default_rng(6)
    pool = [int(x) for x in rng.integers(0, 2**63, 3000)]
    a = [pool[:n] for n in (0, 1, 5, 50, 400, 1000)]
    b = [pool[: n // 2] + pool[2000 : 2000 + n // 3] for n in (0, 1, 5, 50, 400, 1000)]
    for (x, y), p, q in zip(fingerprints.differences(a, b), a, b):
        assert set(x) == set(p) - set(q) and set(y) == set(q) - set(p)


def test_fingerprints(odd_docs, no_docs):
    rows = sorted(odd_docs.collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -1), r["text"] is not None, r["text"] or ""))
    got = fingerprints.fingerprints(odd_docs).collect()
    assert len(got) == len(rows)
    want = []
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, r in enumerate(rows):
        t, n = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        s, u, v = (set(fingerprints.digests(x)) for x in (t, e, n))
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), round(jac(s, u), 9), round(jac(s, v), 9)))
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(set)
    for r in got:
        by[(r["n_chars"], r["edited_sha256"])].add(r["fingerprint"])
    assert fingerprints.encode([fingerprints.digests("a b"), fingerprints.digests("a b")])[0] == fingerprints.encode([fingerprints.digests("a b")])[0]
    assert fingerprints.fingerprints(no_docs).count() == 0
    alone = fingerprints.fingerprints(odd_docs.filter("doc_id = 9")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()


# --- ids and names ------------------------------------------------------------------------------------


BIG = [2**53 - 1, 2**53, 2**53 + 1, 2**53 + 2, 2**62, 2**62 + 1, 2**62 + 3, -(2**62) - 1, -(2**62), -(2**63) + 1, 2**63 - 1, 0, 5]


def test_ranges_of_big_ids_beside_nulls(spark):
    bounds = sorted(BIG)[1::2]
    rows = spark.createDataFrame([(x,) for x in [*BIG, None, None]], "k long").coalesce(1)
    got = rows.select("k", common.range_of(F.col("k"), bounds).alias("r")).collect()
    assert [r["r"] for r in got] == [0 if r["k"] is None else sum(b <= r["k"] for b in bounds) for r in got]


def big_docs(spark):
    rows = [(x, f"text {i} of {i * 7919} words", "en", "s") for i, x in enumerate(BIG)] + [(None, "nobody's", "en", "s"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_files_and_neighbours_of_big_ids(spark):
    docs = big_docs(spark)
    got = [r["doc_id"] for r in token_files.token_files(docs, BYTE, 2).orderBy("start").collect()]
    assert got == [None, None, *sorted(BIG)]
    text = {r["doc_id"]: r["text"] for r in docs.filter("doc_id IS NOT NULL").collect()}
    order = sorted(BIG, reverse=True)
    sha = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(docs).collect()}
    for x, following in zip(order, order[1:]):
        assert sha[x] == hashlib.sha256(fingerprints.edited(text[x], text[following]).encode()).hexdigest()


#: Names that operators use inside.
CLASHES = ["target", "source_size", "_size", "_key", "_mix", "shard", "_piece", "_one", "_own0", "_hash", "_d", "_range", "ghost", "digest", "sketch", "row", "rank", "class", "part", "n", "ids", "crcs", "lang_pred", "score", "rejected",
           "cross_entropy", "severity", "grade", "is_toxic", "component_id", "kept", "weight", "_shards", "a.b", "a b", "shard_size", "_quota", "_end", "_at", "n_shingles", "class_id", "doc", "_row", "row_hash", "_id"]


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    d = odd_docs.select("doc_id", "text", "lang", "source")
    return d.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])


def test_columns_with_names_used_inside(spark, sf_dir, clashing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf_dir)
        assert out.columns == clashing.columns and out.dtypes == clashing.dtypes, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, sf_dir).count() > 0
    n = clashing.count()
    assert mixing.mix(clashing).count() == n
    assert near_dups.near_duplicates(clashing).count() == n
    assert fingerprints.fingerprints(clashing).count() == n
    assert token_files.token_files(clashing, BYTE, 2).count() == n
    assert token_counts.count_tokens(clashing, PIECE).count() == n


def test_equal_ids_of_different_texts_are_different_documents(spark):
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words[:100]), " ".join(words[200:300])
    rows = [(7, a), (7, b), (7, b), (3, " ".join(words[:99])), (9, " ".join(words[201:300])), (8, a + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs, 5, 80).collect()}
    assert got == {(7, 96, 3), (7, 96, 7), (3, 95, 3), (9, 95, 7), (8, 97, 3)}
    assert {tuple(r) for r in near_dups.deduplicated(docs, 5, 80).collect()} == {(3, rows[3][1]), (7, b)}
    assert near_dups.deduplicated(docs, 5, 80).count() == 2


def test_parts_of_mixed_documents_keep_the_order_of_words(odd_docs):
    docs = odd_docs.withColumn("text", F.expr("array_join(transform(sequence(1, 50 + coalesce(doc_id, 0) % 7 * 31), i -> concat(i, 'w')), ' ')"))
    for r in mixing.mixed_documents(docs, share=0.6).collect():
        numbers = [int(w[:-1]) for w in r["text"].split()]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))


def test_shards_are_ranked_alike_in_slices_and_at_once(spark):
    rnd = np.random.default_rng(9)
    rows = [(g, i, int(v), 5000 + g) for g in (1, 2) for i, v in enumerate(rnd.integers(0, 40, 700))]
    df = spark.createDataFrame(rows, "g int, k int, v long, n long")
    seats = [{(r["g"], r["k"]): r["seats"] for r in mixing.seats(df, ["g"], ["k"], "v", "n", slices=s).collect()} for s in (False, True)]
    assert seats[0] == seats[1] and sum(seats[0].values()) == 5001 + 5002
