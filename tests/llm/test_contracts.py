"""The registered queries on real tables, against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_operators import BYTE, PIECE, WORD, check_packing, library, water_fill

from tempolith.llm import fingerprints, langid, tokens
from tempolith.llm.queries import LLM


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])


def rows_of(name, spark, sf_dir):
    return LLM.queries()[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows_of("op1_identify_language", spark, sf_dir)}
    assert len(got) == len(docs)
    known = {d["lang"] for d in docs if d["lang"] is not None}
    right = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in known | {"und"}
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        right += r["lang_pred"] == d["lang"] or d["lang"] is None
    assert right >= 0.98 * len(docs)


def plain_kneser_ney(text, table, order):
    """Interpolated Kneser-Ney by its definition, over dictionaries of tuples."""
    codes = [c for key in langid.coded([text], table)[0].tolist() for c in [key & 255]]
    pads = langid.coded([text], table)[0].tolist()
    grams = [tuple((key >> 8 * j) & 255 for j in range(order - 1, -1, -1)) for key in pads]
    counts = [defaultdict(int) for _ in range(order + 1)]
    for g in grams:
        counts[order][g] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    discounts = [0.0] * (order + 1)
    for n in range(1, order + 1):
        n1 = sum(v == 1 for v in counts[n].values())
        n2 = sum(v == 2 for v in counts[n].values())
        discounts[n] = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    return codes, counts, discounts


def test_kneser_ney_against_its_definition():
    table = langid.alphabet(["abracadabra simsalabim"])
    text = "abracadabra abra simsalabim abba cab"
    _, counts, discounts = plain_kneser_ney(text, table, langid.ORDER)
    m = langid.KneserNey(langid.coded([text], table)[0])

    def probability(g):
        if not g:
            return 1 / langid.V
        total = sum(v for k, v in counts[len(g)].items() if k[:-1] == g[:-1])
        if not total:
            return probability(g[1:])
        kinds = sum(k[:-1] == g[:-1] for k in counts[len(g)])
        d = discounts[len(g)]
        return max(0, counts[len(g)].get(g, 0) - d) / total + d * kinds / total * probability(g[1:])

    keys = langid.coded(["abra ab sim cad zzz abba"], table)[0]
    want = [probability(tuple((int(k) >> 8 * j) & 255 for j in range(langid.ORDER - 1, -1, -1))) for k in keys]
    assert m.probability(keys, langid.ORDER) == pytest.approx(want, rel=1e-6)


def test_op2(spark, sf_dir, docs):
    rows = rows_of("op2_mix_sources", spark, sf_dir)
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    of = {d["doc_id"]: d["source"] for d in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(size) and all(r["size"] == size[r["doc_id"]] for r in rows)
    names = sorted({s for s in of.values() if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * (None in of.values())
    sizes = [sum(size[d] for d in size if of[d] == s) for s in names]
    for s, n, t in zip(names, sizes, water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)):
        mine = [r for r in rows if of[r["doc_id"]] == s]
        assert {r["source_size"] for r in mine} == {n} and all(r["target"] == pytest.approx(t) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 16 and all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


def test_op3(spark, sf_dir, docs):
    got = sorted(tuple(r)[:4] for r in rows_of("op3_token_files", spark, sf_dir))
    start, want = 0, []
    for d in docs:
        ids = np.append(library(BYTE, d["text"]), 2).astype("<u4")
        want.append((d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_op4(spark, sf_dir, docs):
    sp = tokens.pieces(PIECE)
    want = []
    for d in docs:
        n = len(sp.encode(d["text"] or ""))
        want.append((d["doc_id"], len((d["text"] or "").encode()), n, n > 4096))
    assert sorted(tuple(r) for r in rows_of("op4_token_counts", spark, sf_dir)) == want


def test_op6(spark, sf_dir, docs):
    assert check_packing(rows_of("op6_pack_sequences", spark, sf_dir), [(d["doc_id"], d["text"]) for d in docs]) == 0
    assert WORD.endswith("word_bpe_49k.json")


def test_op9(spark, sf_dir, docs):
    rows = rows_of("op9_toxicity", spark, sf_dir)
    assert sorted(r["doc_id"] for r in rows) == [d["doc_id"] for d in docs]
    assert all(0 <= r["severity"] <= 2 for r in rows) and 0 < sum(r["is_toxic"] for r in rows) < len(rows) / 4


def test_op10(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows_of("op10_fingerprints", spark, sf_dir)}
    order = docs[::-1]
    sets = {d["doc_id"]: set(fingerprints.digests(d["text"] or "")) for d in docs}
    for d, n in zip(order, [*order[1:], order[0]]):
        text, r = d["text"] or "", got[d["doc_id"]]
        m = len(text) // 3
        edited = text[: len(text) - m] + (n["text"] or "")[:m]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((sets[d["doc_id"]], set(fingerprints.digests(edited)), r["near_edited"]), (sets[d["doc_id"]], sets[n["doc_id"]], r["near_next"])):
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    by_text = defaultdict(set)
    for d in docs:
        by_text[d["text"] or ""].add(got[d["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)
