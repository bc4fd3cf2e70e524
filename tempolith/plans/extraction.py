"""Extractors that need whole modules, and the document pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import rag, search, text
from ..operators import similarity as sim
from ..registry import CORE
from ..sources import files
from ..stages import run as run_steps
from ..tables import load
from .graph import cut
from .matching import NAMES, _TOK, name_pairs
from ..sources.shared import scratch

q = CORE.query

#: A unit of hardware description text; %d is its number.
UNIT = """module ctl_%d (input clk_a, input clk_b, input rst_n, output wb_adr, output wb_dat, output wb_we, input wb_ack, output reg [1:0] q);
  parameter DEPTH = 64;
  localparam IDLE = 2'd0, RUN = 2'd1, DONE = 2'd2;
  reg [1:0] state;
  reg [7:0] fifo_mem [0:63];
  reg flag;
  function [7:0] twice;
    input [7:0] v;
    twice = (v > 1) ? v + v : 8'd0;
  endfunction
  // q MUST stay below three
  always @(posedge clk_a) begin
    case (state)
      IDLE: if (wb_ack) state <= RUN;
      RUN: state <= DONE;
      DONE: begin if (flag) state <= IDLE; end
    endcase
    fifo_mem[state] <= twice(8'd3);
  end
  always @(posedge clk_b) begin
    flag <= state[0];
    q <= fifo_mem[2];
  end
  initial $display("error: %d");
  generate
    for (i = 0; i < DEPTH; i = i + 1) begin : g
    end
  endgenerate
  sub #(.W(8)) u_x (.a(net_%d), .b(n2));
  sub u_y (.c(net_%d), .d(n3));
endmodule
module sub (input a, input b);
endmodule
"""


def units(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    parts = UNIT.split("%d")
    t = F.concat(*[c for i, p in enumerate(parts) for c in ([F.lit(p)] if i == 0 else [F.col("k").cast("string"), F.lit(p)])])
    m = X.modules(n.select("k", t.alias("text")))
    # the helper module is the same in all files
    return m.filter("module <> 'sub' OR k = 0")


def chunks(u: DataFrame) -> DataFrame:
    return u.select("module", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)always @.*?(?=always @|initial|endmodule)"), F.lit(0))).alias("chunk", "code"))


_C = "(SELECT 'ctl_' || n_nationkey AS module FROM nation)"


@q("EXT-15", "GR-15", oracle=f"""
SELECT module, 'state' AS register, s AS state, t AS next_state, c AS condition, 'binary' AS encoding FROM {_C}, (VALUES ('IDLE', 'RUN', 'wb_ack'), ('RUN', 'DONE', ''), ('DONE', 'IDLE', 'flag')) v(s, t, c)""")
def ext_state_machines(spark: SparkSession, d: str) -> DataFrame:
    return X.state_machines(units(spark, d)).select("module", "register", "state", "next_state", "condition", "encoding")


@q("EXT-21", oracle=f"SELECT module, s AS signal, 'clk_a' AS from_clock, 'clk_b' AS to_clock FROM {_C}, (VALUES ('state'), ('fifo_mem')) v(s) UNION ALL SELECT module, 'flag', 'clk_b', 'clk_a' FROM {_C}")
def ext_clock_crossings(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(units(spark, d)).withColumn("clock", F.regexp_extract("code", r"posedge (\w+)", 1))
    return X.clock_crossings(c.select("module", "clock", "code"))


@q("EXT-12", oracle=f"SELECT module, kind, severity FROM {_C}, (VALUES ('constraint', 'info'), ('display_check', 'error')) v(kind, severity)")
def ext_assertions(spark: SparkSession, d: str) -> DataFrame:
    return X.assertions(units(spark, d)).select("module", "kind", "severity")


@q("EXT-13", "EXT-14", oracle=f"SELECT module, 'twice' AS name, CAST(8 AS INTEGER) AS return_width, 'v' AS inputs, CAST(0 AS INTEGER) AS chunk FROM {_C}")
def ext_functions_calls(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    f = X.functions(u).select("module", "name", "return_width", F.array_join("inputs", ",").alias("inputs"))
    c = X.calls(chunks(u), f).select("module", F.col("function").alias("name"), "chunk")
    return f.join(c, ["module", "name"])


@q("EXT-16", "EXT-17", oracle=f"SELECT module, 'fifo_mem' AS memory, a AS access, CAST(c AS INTEGER) AS chunk, 'FIFO' AS memory_type FROM {_C}, (VALUES ('write', 0), ('read', 1)) v(a, c)")
def ext_memory_accesses(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    m = X.memories(u)
    a = X.memory_accesses(chunks(u), m)
    return a.join(m.select("module", F.col("name").alias("memory"), "memory_type"), ["module", "memory"]).select("module", "memory", "access", "chunk", "memory_type")


@q("EXT-18", oracle="""
WITH p AS (SELECT s_suppkey AS k, unnest(['iwb_', 'dwb_', 'wb_', 'axi_', 'apb_', 'ahb_', 'avm_', 'avs_', 'lsu_', 'spr_', 'x_']) AS prefix, unnest(range(11)) AS i,
  unnest(['Wishbone Instruction', 'Wishbone Data', 'Wishbone', 'AXI', 'APB', 'AHB', 'Avalon-MM', 'Avalon-ST', 'Load/Store Unit', 'Special Purpose Register', '']) AS kind FROM supplier)
SELECT 'bus_' || k AS module, prefix, CAST((k + i) % 5 + 1 AS BIGINT) AS port_count, upper(replace(prefix, '_', '')) || ' Interface' AS name, kind AS interface_type FROM p WHERE prefix <> 'x_' AND (k + i) % 5 + 1 >= 3""")
def ext_buses(spark: SparkSession, d: str) -> DataFrame:
    """One to five ports of each prefix, which change with the module."""
    prefixes = F.array(*[F.lit(p) for p in (*X.BUS_PREFIXES, "x_")])
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.posexplode(prefixes).alias("i", "prefix"))
    ports = rows.select("k", F.explode(F.transform(F.sequence(F.lit(0), ((F.col("k") + F.col("i")) % 5).cast("int")), lambda j: F.concat(F.lit("  input "), "prefix", F.lit("p"), j.cast("string")))).alias("port"))
    body = ports.groupBy("k").agg(F.array_join(F.collect_list("port"), ",\n").alias("ports"))
    text_ = F.concat(F.lit("module bus_"), "k", F.lit(" (\n"), "ports", F.lit("\n);\nendmodule\n"))
    return X.buses(X.ports(X.modules(body.select("k", text_.alias("text")))))


@q("EXT-19", oracle="""
WITH t AS (SELECT s_suppkey AS k, unnest([['Adder', 'Subtractor'], ['Multiplier', 'Divider'], ['Arithmetic Left Shifter', 'Comparator', 'Logical Left Shifter'],
  ['Arithmetic Right Shifter', 'Comparator', 'Logical Right Shifter'], ['Comparator', 'Equality'], ['Equality'], []]) AS o, unnest(range(7)) AS i FROM supplier)
SELECT 'm_' || k AS module, CAST(i AS INTEGER) AS chunk, unnest(o) AS operator_type FROM t WHERE k % 7 >= i""")
def ext_operators(spark: SparkSession, d: str) -> DataFrame:
    """A module's chunks, up to seven of them, each with operators of its own."""
    codes = ("y = a + b - c;", "y = a * b / c;", "y = a <<< 2;", "y = a >>> 2;", "if (a <= b) y = (a == b);", "y = (a != b);", "y = a & b;")
    c = load(spark, d, "supplier").select(F.concat(F.lit("m_"), "s_suppkey").alias("module"), F.col("s_suppkey").alias("k"), F.posexplode(F.array(*[F.lit(x) for x in codes])).alias("chunk", "code"))
    return X.operators(c.filter(F.col("k") % 7 >= F.col("chunk")).select("module", "chunk", "code"))


@q("EXT-20", "EXT-22", oracle=f"SELECT module, CAST(1 AS INTEGER) AS loop_count, 'i:0..DEPTH' AS loops, 'DEPTH' AS parameter FROM {_C}")
def ext_generate_parameters(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    g = X.generate_blocks(u).withColumn("loops", F.array_join("loops", ","))
    p = X.uses_parameter(g.select("module", "name", "loops"), X.parameters(u), "loops").select("module", "parameter")
    return g.join(p, "module").select("module", "loop_count", "loops", "parameter")


@q("EXT-07", "EXT-08", oracle="""
SELECT 'ctl_' || n_nationkey AS module, 'net_' || n_nationkey AS net, 'u_x.a' AS pin, 'u_y.c' AS other, 'W=8' AS overrides FROM nation""")
def ext_wiring(spark: SparkSession, d: str) -> DataFrame:
    found = X.instances(units(spark, d))
    o = found.filter("size(overrides) > 0").select("module", F.array_join("overrides", ",").alias("overrides"))
    return X.wired(found).join(o, "module")


@q("EXT-23", oracle=f"SELECT module, n AS name, k AS kind FROM {_C}, (VALUES ('wb_ack', 'port'), ('state', 'signal'), ('fifo_mem', 'memory'), ('DEPTH', 'parameter'), ('nothing', 'unresolved')) v(n, k)")
def ext_resolve(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    ported = X.ports(u.withColumn("body", F.regexp_replace("body", r", (?=input|output)", ",\n")))
    w = u.filter("module <> 'sub'").select("module", F.explode(F.array(*[F.lit(x) for x in ("wb_ack", "state", "fifo_mem", "DEPTH", "nothing")])).alias("name"))
    return X.resolve_names(w, [("port", ported), ("signal", X.signals(u)), ("memory", X.memories(u)), ("parameter", X.parameters(u))])


@q("SRC-07", "SRC-08", oracle="SELECT 'txt' AS extension, count(*) AS files, count(*) AS modules FROM nation")
def src_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of text files, found and read again whole."""
    p = scratch(spark, "tree")
    units(spark, d).filter("module <> 'sub'").select("k", "body").write.partitionBy("k").text(p)
    found = files.discover_documents(spark, p)
    mods = X.modules(files.read_sources(spark, p, ("txt",)))
    n = mods.agg(F.countDistinct("module").alias("modules"))
    return found.groupBy("extension").agg(F.count("*").alias("files")).crossJoin(F.broadcast(n))


@q("SRC-11", oracle="SELECT md5('o' || l_orderkey) AS commit, 'part/' || l_partkey AS file, count(*) AS n FROM lineitem GROUP BY 1, 2")
def src_name_only(spark: SparkSession, d: str) -> DataFrame:
    """Logs of 1,024 repositories: a header line for each order, then its parts."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    head = li.select("l_orderkey").distinct().select((F.col("l_orderkey") * 1000000000).alias("line"), F.concat(F.lit("commit "), F.md5(F.concat(F.lit("o"), "l_orderkey"))).alias("value"))
    body = li.select((F.col("l_orderkey") * 1000000000 + 1 + F.col("l_partkey")).alias("line"), F.concat(F.lit("part/"), "l_partkey").alias("value"))
    lines = head.unionByName(body).withColumn("log", F.floor(F.col("line") / 1000000000) % 1024)
    return files.parse_name_only(lines).groupBy("commit", "file").agg(F.count("*").alias("n"))


_CS = "list_distinct(string_split({}, ''))"
_P = " + ".join(f"CAST({' AND '.join(f'substring(a.n, {j}, 1) = substring(b.n, {j}, 1)' for j in range(1, i + 1))} AND length(a.n) >= {i} AS INTEGER)" for i in range(1, 5))


@q("SIM-07", oracle=f"""
WITH p AS (SELECT a.n AS a, b.n AS b, len(list_intersect({_CS.format('a.n')}, {_CS.format('b.n')})) / len(list_distinct(list_concat({_CS.format('a.n')}, {_CS.format('b.n')}))) AS j, {_P} AS lead FROM {NAMES} a JOIN {NAMES} b ON a.k < b.k)
SELECT a, b, round(least(j + 0.1 * lead * (1 - j), 1), 6) AS s FROM p""")
def sim_charset(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(sim.charset_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@q("PL-05", "TXT-03", oracle=f"""
WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p AS (SELECT doc_id, unnest(t) AS token, len(t) AS dl FROM d), tf AS (SELECT doc_id, token, dl, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(list_filter({_TOK.format('text')}, lambda x: length(x) >= 4)) AS token FROM benchmark), df AS (SELECT token, count(*) AS df FROM tf WHERE token IN (SELECT token FROM q) GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (token) JOIN df USING (token), n GROUP BY 1, 2)
SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS r FROM s) WHERE r <= 2 AND score > 5""")
def br_logic_references(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of four or more characters against chunks, the best two above a score."""
    ids = F.filter(text.tokens(F.col("text")), lambda x: F.length(x) >= 4)
    b = load(spark, d, "benchmark").select("item_id", F.array_join(ids, " ").alias("text"))
    index = search.build(load(spark, d, "documents"), "doc_id", "text", scratch(spark, "search-index"))
    found, _ = search.top_k(index, search.terms(index, b, "item_id", "text"), 2, cut, digits=7)
    return found.filter("score > 5").select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"))


KINDS = {"idiot": "INSULT", "moron": "INSULT", "the": "WORD", "der": "WORD"}


@q("PL-09", "PL-10", "PL-17", "EXT-30", oracle="""
WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT w, (len(w) - 1) // 350 AS last FROM w WHERE len(w) > 0),
c AS (SELECT DISTINCT left(sha256(array_to_string(w[i * 350 + 1 : i * 350 + 400], ' ') || ':' || i), 16) AS k, array_to_string(w[i * 350 + 1 : i * 350 + 400], ' ') AS t FROM (SELECT *, unnest(range(last + 1)) AS i FROM n))
SELECT v.name, v.type, count(*) AS mentions FROM c, (VALUES ('idiot', 'INSULT'), ('moron', 'INSULT'), ('the', 'WORD'), ('der', 'WORD')) v(name, type) WHERE regexp_matches(c.t, '(?i)\\b' || v.name || '\\b') GROUP BY 1, 2""")
def rag_build(spark: SparkSession, d: str) -> DataFrame:
    """Documents to chunks, entities, golden entities and edges; how often each golden entity is mentioned."""
    steps = {
        "documents": ([], lambda _: load(spark, d, "documents")),
        "graph": (["documents"], lambda r: rag.build(r["documents"], "doc_id", "text", KINDS)),
        "mentions": (["graph"], lambda r: r["graph"]["consolidates"].join(r["graph"]["mentioned_in"], "entity_key").groupBy("golden_key").agg(F.count("*").alias("mentions"))),
    }
    done = run_steps(steps)
    return done["graph"]["golden"].join(done["mentions"], "golden_key").select("name", "type", "mentions")


@q("PL-15", "AG-03", oracle="""
SELECT o_orderpriority AS method, c_mktsegment AS kind, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def br_audit(spark: SparkSession, d: str) -> DataFrame:
    """Bridges by method and kind, with mean and best score."""
    j = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderpriority").alias("method"), F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"))


@q("PL-16", oracle="SELECT item_id, true AS unit, CAST(64 AS INTEGER) AS dims FROM benchmark WHERE item_id % 4 <> 0")
def rag_embed(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings for rows that have none yet."""
    b = load(spark, d, "benchmark").select("item_id", "text")
    done = rag.hashed_embeddings(b.filter("item_id % 4 = 0"), "item_id", "text")
    e = rag.hashed_embeddings(rag.without_embedding(b, done, "item_id"), "item_id", "text")
    n = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return e.select("item_id", (F.abs(n - 1) < 1e-5).alias("unit"), F.size("embedding").alias("dims"))
