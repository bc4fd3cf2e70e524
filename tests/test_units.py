"""Golden values and brute force for single operators."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tempolith import stages
from tempolith.functions import arrays as A
from tempolith.functions import more as M
from tempolith.functions import strings as S
from tempolith.functions import values as V
from tempolith.operators import extract as X
from tempolith.operators import graph as G
from tempolith.operators import leiden, people, resolve
from tempolith.operators import relational as R
from tempolith.operators import similarity as sim
from tempolith.operators import temporal as T
from tempolith.operators.components import connected_components
from tempolith.plans.graph import cut


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


# --- similarity ---------------------------------------------------------------------------------


def test_token_overlap(spark):
    o = lambda a, b: one(spark, sim.token_overlap(F.lit(a), F.lit(b)))
    assert o("arithmetic logic unit", "arithmetic unit operations") == pytest.approx(2 / 3)
    assert o("The ALU", "alu") == 1.0
    assert o("a b", "c d") == 0.0
    assert o("", "x") == 0.0
    assert one(spark, sim.token_overlap(F.lit(None).cast("string"), F.lit("x"))) == 0.0


def test_cosine(spark):
    c = lambda a, b: one(spark, A.cosine(F.array(*[F.lit(float(x)) for x in a]), F.array(*[F.lit(float(x)) for x in b])))
    assert c([1, 2], [1, 2]) == pytest.approx(1)
    assert c([1, 0], [0, 1]) == 0
    assert c([1, 0], [-1, 0]) == pytest.approx(-1)
    assert c([0, 0], [1, 0]) == 0
    assert c([1, 0], [1, 0, 0]) == 0


def test_signature_similarity(spark):
    s = lambda a, b: one(spark, sim.signature_similarity(F.array(*map(F.lit, a)) if a else F.array().cast("array<string>"), F.array(*map(F.lit, b))))
    assert s(["CLK", "rst"], ["clk", "RST"]) > 0.9
    assert s(["a"], ["b", "c", "d", "e"]) < 0.5
    assert s([], ["b"]) == 0


def test_jaro_winkler():
    assert sim.jaro_winkler_py("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler_py("", "x") == 0
    assert sim.jaro_winkler_py(None, "x") is None


def test_fuzzy_confidence_rejects_short_prefixes(spark):
    assert one(spark, sim.fuzzy_confidence(F.lit("alu"), F.lit("alu1"))) == 0
    assert one(spark, sim.fuzzy_confidence(F.lit("adder"), F.lit("adder"))) == 0  # equal names are no fuzzy match
    assert one(spark, sim.fuzzy_confidence(F.lit("adder"), F.lit("addr"))) == pytest.approx(0.75)
    assert one(spark, sim.fuzzy_confidence(F.lit("cpu9x processor"), F.lit("cpu9x procesor"))) == pytest.approx(0.6 * (1 - 1 / 14) + 0.4 * 0.5)


def test_overlap_of_tokens(spark):
    f = lambda a, b: one(spark, sim.token_overlap(F.lit(a), F.lit(b)))
    assert f("arithmetic logic unit", "arithmetic unit operations") == pytest.approx(2 / 3)
    assert f("alu unit", "alu unit") == 1 and f("alu", "mmu") == 0 and f("", "x") == 0 and f("ALU", "alu") == 1
    assert f("the alu", "alu of be") == 1 and f("a_b c", "a_b d") == 0.5
    assert one(spark, sim.token_overlap(F.lit(None).cast("string"), F.lit("x"))) == 0


def test_label_similarity(spark):
    f = lambda a, b: one(spark, sim.label_similarity(F.lit(a), F.lit(b)))
    assert f("cpu9_alu", "RV32_ALU") == 1 and f("cpu9_alu_x", "rv32_alu_y") == pytest.approx(0.2) and f("a_b", "c_d") == 0


def test_graph_boost_and_gate(spark):
    assert one(spark, resolve.graph_boost(F.lit(0.75), F.lit(True))) == pytest.approx(0.9)
    assert one(spark, resolve.graph_boost(F.lit(0.9), F.lit(True))) == 1.0
    assert one(spark, resolve.embedding_gate(F.lit(0.6), F.lit(0.0), F.lit(0), 0.5)) is False
    assert one(spark, resolve.embedding_gate(F.lit(0.9), F.lit(0.1), F.lit(0), 0.5)) is True


# --- values ---------------------------------------------------------------------------------------


def test_value_semantics(spark):
    assert one(spark, V.safe_div(F.lit(1), F.lit(0))) is None
    assert one(spark, V.either(F.lit(0), F.lit(7), V.truthy_number)) == 7
    assert one(spark, V.either(F.lit(""), F.lit("d"), V.truthy_string)) == "d"
    assert one(spark, V.less(F.lit(None).cast("int"), F.lit(1))) is True
    assert one(spark, V.to_number(F.lit("x1"))) == 0
    assert one(spark, V.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (1, 2, 2, 3)])
    b = F.array(*[F.lit(x) for x in (2, 9)])
    assert one(spark, A.interleave(a, b)) == [1, 2, 2, 9, 2, 3]
    assert one(spark, A.outersection(a, b)) == [1, 3, 9]
    assert one(spark, A.remove_nth(a, 1)) == [1, 2, 3]
    assert one(spark, A.remove_nth(a, -1)) == [1, 2, 2]
    assert one(spark, A.slice0(a, 1, -1)) == [2, 2]
    assert one(spark, A.slice0(a, -2)) == [2, 3]
    assert one(spark, A.nth(a, 9)) is None
    assert one(spark, A.position(a, 7)) == -1
    assert one(spark, A.median(a)) == 2
    assert one(spark, A.percentile(a, 50)) == 2
    assert one(spark, A.variance(a)) == pytest.approx(0.5)
    assert one(spark, A.l1_distance(a, a)) == 0


def test_strings(spark):
    assert one(spark, S.find_last(F.lit("abcabc"), "bc")) == 4
    assert one(spark, S.find_last(F.lit("abc"), "x")) == -1
    assert one(spark, S.substring0(F.lit("abcdef"), -3, 2)) == "de"
    assert one(spark, S.ipv4_to_number(F.lit("1.2.3.4"))) == 16909060
    assert one(spark, S.ipv4_to_number(F.lit("1.2.3.400"))) is None
    assert one(spark, S.encode_uri_component(F.lit("a b&c"))) == "a%20b%26c"
    assert one(spark, S.label_suffix(F.lit("or_alu_x"))) == "alu_x"
    assert one(spark, S.expand_acronyms(F.lit("esrReg"), {"esr": "Exception Status"})) == "Exception Status Reg"
    assert one(spark, S.expand_acronyms(F.lit("if_insn"), {"if": "Instruction Fetch", "insn": "Instruction"})) == "Instruction Fetch Instruction"
    assert one(spark, S.expand_acronyms(F.lit("OPTION_esr"), {"esr": "E S"})) == "OPTION E S"
    assert one(spark, S.acronym(F.lit("Memory-management unit"))) == "MMU" and one(spark, S.acronym(F.lit(" _ "))) == ""
    assert one(spark, S.sanitize_id(F.lit("reg [31:0] data"))) == "31:0_data" and one(spark, S.sanitize_id(F.lit("assign a/b.c-d"))) == "a_b.c-d"
    assert one(spark, S.expand_acronyms(F.lit("foo"), {"esr": "x"})) is None
    assert one(spark, S.normalize_name(F.lit("CPU9_alu_core"), ("cpu9_",))) == "alu core"
    assert one(spark, S.sanitize_id(F.lit("reg [7:0] data out"))).strip("_") != ""


def test_dates_and_bits(spark):
    t = F.lit("2024-02-29 13:14:15").cast("timestamp")
    assert one(spark, M.date_format(t, "%yyyy-%mm-%dd at %hh:%ii %%")) == "2024-02-29 at 13:14 %"
    assert one(spark, M.leap_year(t)) is True
    assert one(spark, M.days_in_month(t)) == 29
    assert one(spark, M.date_diff(t, M.date_add(t, 36, "hours"), "days", True)) == 1.5
    assert one(spark, M.bit_construct(F.array(F.lit(0), F.lit(3)))) == 9
    assert one(spark, M.bit_deconstruct(F.lit(9))) == [0, 3]
    assert one(spark, M.bit_from_string(F.lit("1010"))) == 10
    assert one(spark, M.bit_negate(F.lit(0), 4)) == 15
    assert one(spark, M.decay_exp(F.lit(35.0), 25.0, 10.0, 0.0, 0.5)) == pytest.approx(0.5)
    assert one(spark, M.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371000)


def test_objects(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, M.merge(m, F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    assert one(spark, M.unset(m, "a")) == {"b": "2"}
    assert one(spark, M.matches(m, {"a": "1"})) is True
    assert one(spark, M.attributes(m)) == ["a", "b"]


# --- relations ------------------------------------------------------------------------------------


def test_snapshot_diff(spark):
    b = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "k string, h string")
    a = spark.createDataFrame([("y", "1"), ("z", "2"), ("n", "1")], "k string, h string")
    got = {r["k"]: r["change"] for r in R.snapshot_diff(b, a, "k", "h").collect()}
    assert got == {"x": "removed", "y": "unchanged", "z": "modified", "n": "added"}


def test_interval_join_finds_each_pair_once(spark):
    import random

    rnd = random.Random(3)
    mk = lambda n: [(rnd.randrange(3), i, s := rnd.randrange(300), s + rnd.randrange(1, 120)) for i in range(n)]
    l, r = mk(60), mk(60)
    a = spark.createDataFrame(l, "k int, i int, f long, t long")
    b = spark.createDataFrame(r, "k int, j int, g long, u long")
    got = sorted((x["i"], x["j"]) for x in R.interval_join(a, b, ["k"], ("f", "t"), ("g", "u"), 50).collect())
    assert got == sorted((x[1], y[1]) for x in l for y in r if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_insert_conflict(spark):
    b = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        R.insert(b, b, "k", "conflict")
    assert R.insert(b, spark.createDataFrame([(1, None)], "k int, v string"), "k", "update").first()["v"] == "a"


# --- time -----------------------------------------------------------------------------------------


def test_epoch_labels():
    def labels(*rows):
        return T.epoch_labels([(ts, tag, share, f"{i}abcdefghij") for i, (ts, tag, share) in enumerate(rows)])

    assert labels((0, None, 0.9)) == ["initial_commit"]
    assert labels((0, "v1", 0.9)) == ["initial_commit"]
    assert labels((0, None, 0), (10, None, 0.1), (20, None, 0.1)) == ["initial_commit", "development", "development"]
    assert labels((0, None, 0), (10, "v1.0", 0), (20, None, 0)) == ["initial_commit", "milestone_1_0", "milestone_1_0"]
    day = 86400
    got = labels((0, None, 0), (100 * day, None, 0.5), (190 * day, None, 0), (281 * day, None, 0), (282 * day, None, 0.15))
    assert got == ["initial_commit", "major_refactor_1abcdef", "major_refactor_1abcdef", "period_1970_10", "major_refactor_4abcdef"]


def test_situations(spark):
    commits = spark.createDataFrame([("o/r", 1, 10, "development"), ("o/r", 2, 20, "milestone_1_0"), ("o/r", 3, 30, "milestone_1_0"), ("o/r", 4, 40, "major_refactor_abc")], "repo string, commit long, ts long, epoch string")
    new = spark.createDataFrame([("o/r", 2, x) for x in "zyxwvut"] + [("o/r", 3, "late")], "repo string, commit long, label string")
    got = {(r["epoch"], r["situation"]): r for r in T.situations(commits, new).collect()}
    assert set(got) == {("milestone_1_0", "release_prep"), ("milestone_1_0", "subsystem_addition"), ("major_refactor_abc", "major_refactor")}
    r = got["milestone_1_0", "release_prep"]
    assert (r["first_commit"], r["last_commit"], r["from_ts"], r["to_ts"], r["outcome"], r["tags"]) == (2, 3, 20, 30, "milestone_release", ["release", "1.0"])
    assert r["label"] == "Release Prep \u2014 o/r @ milestone_1_0" and len({x["key"] for x in got.values()}) == 3
    assert got["milestone_1_0", "subsystem_addition"]["tags"] == ["late"] and got["major_refactor_abc", "major_refactor"]["tags"] == ["refactor", "r"]
    assert T.situations(commits.limit(0), new.limit(0)).count() == 0


# --- people ---------------------------------------------------------------------------------------


def test_authors(spark):
    p = lambda s: tuple(one(spark, people.parse_author(F.lit(s))))
    assert p("Jo Doe <Jo.Doe@X.org>") == ("Jo Doe", "jo.doe@x.org")
    assert p("jo@x.org") == ("jo", "jo@x.org")
    assert p("Jo Doe") == ("Jo Doe", None)
    assert one(spark, people.email_key(F.lit("Jo.Doe+x@X.org"))) == "jo_doe_x"
    assert one(spark, people.maintenance_score(F.lit(10), F.lit(10), F.lit(0))) == 1.0
    assert one(spark, people.maintenance_score(F.lit(0), F.lit(0), F.lit(999))) == pytest.approx(0.04)
    assert one(spark, people.maintenance_score(F.lit(10), F.lit(10), F.lit(365))) == pytest.approx(0.64)
    assert one(spark, people.maintenance_score(F.lit(1), F.lit(2), F.lit(73))) == pytest.approx(0.628)


def test_risk(spark):
    f = lambda n, a: (one(spark, people.risk(F.lit(n), F.lit(a))), one(spark, people.risk_level(people.risk(F.lit(n), F.lit(a)))))
    assert [f(0, 0), f(1, 1), f(1, 0), f(2, 2), f(2, 1), f(3, 3), f(4, 0)] == [(150, "CRITICAL"), (70, "HIGH"), (120, "CRITICAL"), (30, "MEDIUM"), (50, "MEDIUM"), (0, "LOW"), (50, "MEDIUM")]


def test_chunks_and_headers(spark):
    from tempolith.operators import text

    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, "one"), (3, " "), (4, None)], "k int, t string")
    got = [(r["k"], r["chunk_index"], r["word_count"], r["total_chunks"]) for r in text.chunks(docs, "k", "t", 5, 2).orderBy("k", "chunk_index").collect()]
    assert got == [(1, 0, 5, 4), (1, 1, 5, 4), (1, 2, 4, 4), (1, 3, 1, 4), (2, 0, 1, 1)]
    f = lambda s: one(spark, text.section_header(F.lit(s)))
    assert f("x\n## Title here\n1.2 A") == "Title here" and f("1.2.3 Memory") == "1.2.3 Memory" and f("##### deep") is None and f("1.2 lower") is None


def test_relations_operators_memories(spark):
    from tempolith.operators import extract as X

    f = lambda s: one(spark, X.relation_label(F.lit(s)))
    assert [f(x) for x in ("uses", "Is Part Of", "connects to", "depends-on", "is verified by", "blah")] == ["INCLUDES", "INCLUDES", "CONNECTS_TO", "DEPENDS_ON", "TESTED_BY", "RELATED_TO"]
    names = ["dpram_x", "spram", "ram", "rom1", "regfile", "fifo", "icache", "dtlb", "mem", "q"]
    body = "module m;\n" + "".join(f"reg [7:0] {n} [0:31];\n" for n in names) + "endmodule"
    got = {r["name"]: r["memory_type"] for r in X.memories(spark.createDataFrame([("m", body)], "module string, body string")).collect()}
    want = ["Dual-Port RAM", "Single-Port RAM", "RAM", "ROM", "Register File", "FIFO", "Cache", "TLB (Translation Lookaside Buffer)", "Memory Array", "Memory Array"]
    assert got == dict(zip(names, want))


# --- graphs ---------------------------------------------------------------------------------------


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_components(spark):
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, [(1, 2), (2, 3), (4, 5), (9, 9)]), cut).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_components_of_a_long_chain(spark):
    got = {r["component"] for r in connected_components(frame(spark, [(i + 1, i) for i in range(60)]), cut).collect()}
    assert got == {0}


def test_communities_are_stable_and_within_components(spark):
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)]
    for f in (lambda e: G.label_propagation(e, 12, cut), lambda e: leiden.leiden(e, cut)):
        got = {r["node"]: r["community"] for r in f(frame(spark, cliques)).collect()}
        assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1
        assert got[0] != got[10]


def test_pagerank_against_a_matrix(spark):
    import numpy as np

    e = [(0, 1), (1, 2), (2, 0), (3, 0), (0, 4)]
    r = {x["node"]: x["rank"] for x in G.pagerank(frame(spark, e), 30, 0.85, cut).collect()}
    m = np.zeros((5, 5))
    for a, b in e:
        m[b, a] = 1
    out = m.sum(axis=0)
    p = np.full(5, 0.2)
    for _ in range(30):
        p = 0.15 / 5 + 0.85 * (sum(m[:, a] * p[a] / out[a] for a in range(5) if out[a]) + p[out == 0].sum() / 5)
    assert [r[i] for i in range(5)] == pytest.approx(list(p))


def test_betweenness_of_a_path(spark):
    got = {r["node"]: r["score"] for r in G.betweenness(frame(spark, [(0, 1), (1, 2), (2, 3)]), cut).collect()}
    assert got[1] == 2 and got[2] == 2


def test_strong_components(spark):
    got = {r["node"]: r["component"] for r in G.strong_components(frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)]), cut).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_strong_components_of_a_long_ring_and_chain(spark):
    ring, chain = [(i, (i + 1) % 210) for i in range(210)], [(i, i + 1) for i in range(2000, 2033)]
    got = {r["node"]: r["component"] for r in G.strong_components(frame(spark, ring + chain), cut).collect()}
    assert got == {i: 0 for i in range(210)} | {i: i for i in range(2000, 2034)}


def test_strong_components_against_brute_force(spark):
    import random

    rnd = random.Random(8)
    e = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(28)]
    reach = {(a, a) for p in e for a in p} | set(e)
    for k in range(20):
        reach |= {(a, b) for a in range(20) for b in range(20) if (a, k) in reach and (k, b) in reach}
    want = {a: min(b for b in range(20) if (a, b) in reach and (b, a) in reach) for p in e if p[0] != p[1] for a in p}
    got = {r["node"]: r["component"] for r in G.strong_components(frame(spark, e), cut).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)
    assert G.strong_components(frame(spark, e).limit(0), cut).count() == 0


def test_cycles_once_each(spark):
    got = sorted((r["node"], r["length"]) for r in G.cycles(frame(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (5, 5)]), 1, 5, cut).collect())
    assert got == [(1, 2), (1, 3), (5, 1)]


def test_steps():
    assert stages.order({"b": ["a"], "a": [], "c": ["a", "b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        stages.order({"a": ["b"], "b": ["a"]})
    assert stages.run({"a": ([], lambda r: 1), "b": (["a"], lambda r: r["a"] + 1), "c": ([], lambda r: 1 / 0)}, ["b"]) == {"a": 1, "b": 2}


# --- extractors -----------------------------------------------------------------------------------


def test_literals_and_encodings():
    assert X.literal("8'hFF") == 255 and X.literal("4'b1010") == 10 and X.literal("42") == 42 and X.literal("W-1") is None
    assert X.encoding_kind([1, 2, 4]) == "one_hot" and X.encoding_kind([0, 1, 3, 2]) == "gray" and X.encoding_kind([0, 1, 2]) == "binary"


def test_model_output(spark):
    ok = '```json\n{"entities": [{"name": "ALU", "type": "X", "description": "d"}], "relations": [{"source": "ALU", "target": "gone", "type": "uses"}]}\n```'
    e, r = X.entities_and_relations(spark.createDataFrame([(1, ok), (2, "{bad"), (3, None)], "k int, t string"), "k", "t")
    assert [x["name"] for x in e.collect()] == ["ALU"] and r.count() == 0


def test_golden_merge(spark):
    rows = [("k1", "CPU9 Processor", 1, "", "v1", "c1"), ("k2", "cpu9 processor", 2, "5-stage", "v2", "c2"), ("k3", "MMU", 3, "m", "v1", "c3")]
    df = spark.createDataFrame(rows, "key string, name string, seq int, description string, version string, chunk string")
    got = {r["norm"]: r for r in resolve.golden(df, "key", "name", "seq", "description", "version", "chunk").collect()}
    assert len(got) == 2 and got["cpu9 processor"]["description"] == "5-stage" and got["cpu9 processor"]["sources"] == ["c1", "c2"]
