"""Passages of test sets, vector codes and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import same_rows

from tempolith.llm import contamination, divergence, vector_codes
from tempolith.llm.queries import LLM


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_vector_codes", "op13_source_divergence"])
def test_query_matches_sql(name, spark, sf_dir, duck):
    same_rows(LLM.queries()[name](spark, sf_dir), duck.sql(LLM.oracle_sql()[name]))


# --- 11 passages of test sets -----------------------------------------------------------------------


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_passages(text, items, window):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small(text))
    hit, of = set(), set()
    for item, t in items:
        v = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small(t))
        m = min(window, len(v))
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                of.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(of)


def test_passages(spark):
    rnd = random.Random(4)
    for window, block in ((10, 2_000_000), (4, 2_000_000), (4, 300), (1, 100)):
        pool = ["ab", "Cd", "é", "x9", "Ü", "zz", "日本", "a" * 40]
        text = lambda n: "".join(rnd.choice(pool) + rnd.choice([" ", ", ", "\n", "--", "\x00 "]) for _ in range(n))
        items = [(i, text(rnd.choice([0, 1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(25)]
        items += [(3, items[7][1]), (90, items[7][1]), (91, None), (92, ""), (93, "..."), (None, items[8][1] + " q r s t u v w x y z"), (-5, "one two three four five six seven eight nine ten eleven")]
        docs = [(i, text(rnd.randrange(60)) + (items[rnd.randrange(25)][1] if i % 2 else "")) for i in range(80)]
        docs += [(100, None), (101, ""), (102, "ab"), (None, items[5][1]), (103, docs[3][1]), (103, docs[3][1]), (104, text(3000)), (105, "ONE two, three four five six seven eight nine ten"), (106, "xone two three four five six seven eight nine ten")]
        d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, items string, spans int")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = Counter((r["doc_id"], r["n_words"], tuple(i for s in r["spans"] for i in range(s["begin"], s["end"])), tuple(r["items"])) for r in contamination.contamination(d, b, window, block).collect())
        want = Counter()
        for i, t in docs:
            n, hit, of = brute_passages(t, items, window)
            want[(i, n, tuple(hit), tuple(of))] += 1
        assert got == want
    assert contamination.contamination(d.limit(0), b).count() == 0
    assert contamination.contamination(d, b.limit(0)).filter("size(spans) > 0").count() == 0
    assert contamination.contamination(d, b.limit(0)).count() == len(docs)


def test_shift_tables_skip():
    rnd = random.Random(2)
    item = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(300))
    index = contamination.Index(["1"], [item])
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(9000)) + " " + item
    words = contamination.Words(pa.array([text, item[50:]]))
    looked = []
    table = index.tables[0]
    slot = table._slot
    table._slot = lambda b: looked.append(len(b)) or slot(b)
    table.ends_in(words)
    assert sum(looked) < 3000  # of 9,600 words, 600 of which are of the item
    assert [x.tolist() for x in [np.unique(index.search(words)[1][:, 0])]] == [[0, 1]]


def test_equal_slots_are_told_apart_by_bytes():
    """Patterns whose keys are forced to be equal are still compared byte by byte."""
    index = contamination.Index(["1", "2"], ["a b c", "a d c"])
    (table,) = index.tables
    table._key = lambda block, window: np.zeros(len(block), np.uint64)
    table.key = np.zeros(2, np.uint64)
    words = contamination.Words(pa.array(["x a d c", "a b c", "a e c"]))
    table.shift[:] = 0
    ends, sets = table.search(words)
    assert sorted(zip(ends.tolist(), [index.items[s] for s in sets.tolist()])) == [(3, (1,)), (6, (0,))]


# --- 12 vector codes --------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    dims = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * dims : (p + 1) * dims] for r in first] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * dims : (p + 1) * dims], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        of = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * dims : (p + 1) * dims] for (_, v, _), o in zip(kept, of) if o[p] == e]
                if mine:
                    books[p][e] = None or [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, lab, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v, lab in kept]
    by = Counter()
    for _, lab, _, e in out:
        by[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, c, e, by[lab], digest) for i, lab, c, e in out)


def test_vector_codes(spark):
    rnd = random.Random(6)
    nan, inf = float("nan"), float("inf")
    for dims, n, parts, entries in ((8, 60, 4, 5), (6, 40, 4, 16), (3, 4, 2, 16)):
        rows = [(rnd.choice([i, i, 7]), [rnd.choice([-1.0, 0.25, -0.3333, rnd.gauss(0, 1)]) for _ in range(dims)], rnd.choice([1, 1, 2, None])) for i in range(n)]
        rows += [rows[0], (None, [0.5] * dims, 3), (50, None, 1), (51, [nan] * dims, 1), (52, [inf, *[0.0] * (dims - 1)], None), (53, [None, *[0.0] * (dims - 1)], 2), (54, [-0.1], 2), (55, [], None)]
        d = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, error int, code string")
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
        want = brute_codes(rows, parts, entries, 3)
        got = Counter(tuple(r) for r in vector_codes.vector_codes(d, parts, entries, 3).collect())
        assert got == want
    assert vector_codes.vector_codes(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(d.selectExpr("vec_id", "array(1e30D) AS embedding", "label")).collect()


def test_labels_beyond_the_broadcast_ones(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0], i % 5 if i < 400 else i) for i in range(500)] + [(600 + i, [1.0, float(i)], None) for i in range(9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = vector_codes.vector_codes(d, 2, 4, 2).orderBy("vec_id").collect()
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 20)
    assert vector_codes.vector_codes(d, 2, 4, 2).orderBy("vec_id").collect() == want
    assert len(want) == len(rows)


# --- 13 source divergence ---------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    n, docs, groups = Counter(), defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", small(text)):
            n[lang, source, t] += 1
            docs[lang, t].add(k)
    out = set()
    for lang in {g[0] for g in groups}:
        terms = sorted(t for (x, t), d in docs.items() if x == lang and len(d) >= least)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
        counts = {s: {t: n[lang, s, t] for t in terms} for s in sources}
        p, q = {s: share(counts[s]) for s in sources}, share({t: sum(counts[s][t] for s in sources) for t in terms})
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item, -v, r + 1) for part, x in (("pair", pairs), ("term", own)) for r, (v, _, item) in enumerate(x)}
    return out


def test_divergence(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(8)
    pool = ["Wort", "mot", "É", "don't", "x2y", "日本語", "z-z", "ﬁn", "Ab", "ab"]
    rows = [(" ".join(rnd.choice(pool) for _ in range(rnd.randrange(30))), rnd.choice(["en", "de", "de", None]), rnd.choice(["s1", "s1", "s1", "s2", "", None, "日", "é", "z"])) for _ in range(150)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("12 34", "yy", "only"), ("rare word", "xx", "c"), (rows[0][0], rows[0][1], rows[0][2])]
    d = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    for size in (divergence.SHARD_BYTES, 500):
        monkeypatch.setattr(divergence, "SHARD_BYTES", size)
        for least, top in ((3, 4), (1, 50)):
            got = divergence.divergence(d, least, top).collect()
            assert len(got) == len(set(got))
            assert {tuple(r) for r in got} == brute_divergence(rows, least, top)
    monkeypatch.undo()
    odd = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert {tuple(r) for r in divergence.divergence(odd_docs, 2, 5).collect()} == brute_divergence(odd, 2, 5)
    assert divergence.divergence(no_docs).count() == 0
