"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import documents as D
from ..functions import more as M
from ..functions import strings as S
from ..functions import values as V
from ..registry import CORE
from ..tables import load

q = CORE.query


@q("FN-STR", oracle="""
SELECT c_custkey, strpos(c_name, '#') - 1 AS first_at, length(c_name) - strpos(reverse(c_name), '0') AS last_at, substring(c_name, 3, 4) AS sub, left(c_name, 3) AS l, right(c_name, 3) AS r,
       replace(replace(c_name, 'C', 'k'), '#', '-') AS subst, reverse(c_name) AS rev, upper(c_name) AS up, lower(c_name) AS low, string_split(c_name, '#')[2] AS part2, md5(c_name) AS md5, sha256(c_name) AS sha256,
       array_to_string(regexp_extract_all(c_name, '[0-9]'), '') AS digits, regexp_replace(c_name, '0+', '_', 'g') AS rx, translate(c_mktsegment, 'AEIOU', '12345') AS tr, c_name LIKE 'C%1' AS lk, concat_ws('/', c_mktsegment, c_name) AS joined, lpad(c_custkey::VARCHAR, 8, '0') AS padded
FROM customer""")
def fn_string(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    return load(spark, d, "customer").select(
        "c_custkey", S.find_first(n, "#").cast("long").alias("first_at"), F.when(F.contains(n, F.lit("0")), S.find_last(n, "0")).otherwise(F.length(n)).cast("long").alias("last_at"), S.substring0(n, 2, 4).alias("sub"),
        F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(3)).alias("r"), S.substitute(n, {"C": "k", "#": "-"}).alias("subst"), F.reverse(n).alias("rev"), F.upper(n).alias("up"), F.lower(n).alias("low"),
        A.nth(S.split0(n, "#"), 1).alias("part2"), F.md5(n).alias("md5"), F.sha2(n, 256).alias("sha256"), F.array_join(F.regexp_extract_all(n, F.lit("[0-9]"), F.lit(0)), "").alias("digits"), F.regexp_replace(n, "0+", "_").alias("rx"),
        F.translate("c_mktsegment", "AEIOU", "12345").alias("tr"), S.like(n, "C%1").alias("lk"), F.concat_ws("/", "c_mktsegment", n).alias("joined"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
    )


@q("FN-STR", "KEY-01", oracle="""
SELECT l_orderkey, l_partkey, substring(md5(concat_ws(':', 'o' || l_orderkey, 'p' || l_partkey, 'HAS')), 1, 16) AS key FROM lineitem GROUP BY ALL""")
def fn_edge_key(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return e.withColumn("key", S.edge_key(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"), F.lit("HAS")))


@q("FN-STR", "FN-OBJ", oracle="""
SELECT s_suppkey, (s_suppkey // 16777216) || '.' || (s_suppkey // 65536 % 256) || '.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS ip, s_suppkey AS back, 'supplier' AS collection, s_suppkey::VARCHAR AS key FROM supplier""")
def fn_ipv4_identifier(spark: SparkSession, d: str) -> DataFrame:
    ip = S.ipv4_from_number(F.col("s_suppkey"))
    i = S.parse_identifier(F.concat_ws("/", F.lit("supplier"), "s_suppkey"))
    return load(spark, d, "supplier").select("s_suppkey", ip.alias("ip"), S.ipv4_to_number(ip).alias("back"), i.collection.alias("collection"), i.key.alias("key"))


@q("FN-NUM", oracle="""
SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS nat, round(log10(p_retailprice), 6) AS l10, round(log2(p_size), 6) AS l2, round(exp(p_size / 50.0), 6) AS e, round(pow(p_size, 1.5), 6) AS pw, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS at,
       round(degrees(p_size / 10.0), 6) AS deg, abs(p_size - 25) AS dist, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 5), 6) END AS safe, round(exp(-pow(greatest(0, abs(p_size - 25) - 5), 2) / (2 * (-100 / (2 * ln(0.5))))), 6) AS gauss, round(greatest(0, (20.0 - greatest(0, abs(p_size - 25.0) - 5)) / 20.0), 6) AS lin
FROM part""")
def fn_numeric(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    r = lambda c: F.round(c, 6)
    return load(spark, d, "part").select(
        "p_partkey", r(F.sqrt(p)).alias("root"), r(F.ln(p)).alias("nat"), r(F.log10(p)).alias("l10"), r(F.log2(s)).alias("l2"), r(F.exp(s / 50.0)).alias("e"), r(F.pow(s, F.lit(1.5))).alias("pw"), F.ceil(p).alias("up"), F.floor(p).alias("down"),
        r(F.sin(s)).alias("s"), r(F.atan2(s, F.lit(3))).alias("at"), r(F.degrees(s / 10.0)).alias("deg"), F.abs(s - 25).alias("dist"), r(V.safe_div(p, s % 5)).alias("safe"),
        r(M.decay_gauss(s, 25, 10, 5, 0.5)).alias("gauss"), r(M.decay_linear(s, 25.0, 10.0, 5.0, 0.5)).alias("lin"),
    )


@q("FN-DATE", oracle="""
SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, quarter(o_orderdate) AS q, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS iw, isoyear(o_orderdate) AS iy,
       (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap, day(last_day(o_orderdate)) AS dim, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS tr, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS added,
       date_sub('day', o_orderdate, TIMESTAMP '2000-01-01') AS days, CAST(epoch_ms(o_orderdate) // 900000 * 900000 AS BIGINT) AS rounded, year(o_orderdate) = 1996 AS same_year
FROM orders""")
def fn_date(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    i = lambda c: c.cast("long")
    y2k = F.lit("2000-01-01").cast("timestamp")
    return load(spark, d, "orders").select(
        "o_orderkey", M.date_timestamp(t).alias("ms"), i(F.year(t)).alias("y"), i(F.month(t)).alias("m"), i(F.dayofmonth(t)).alias("d"), i(F.hour(t)).alias("h"), i(F.quarter(t)).alias("q"), i(M.day_of_week(t)).alias("dow"), i(F.dayofyear(t)).alias("doy"),
        i(M.iso_week(t)).alias("iw"), i(M.iso_week_year(t)).alias("iy"), M.leap_year(t).alias("leap"), i(M.days_in_month(t)).alias("dim"), M.date_format(t, "%yyyy-%mm-%dd").alias("iso"), M.date_format(M.date_trunc(t, "month"), "%yyyy-%mm-%dd").alias("tr"),
        M.date_format(M.date_add(t, 3, "months"), "%yyyy-%mm-%dd").alias("added"), M.date_diff(t, y2k, "days").alias("days"), M.date_round(M.date_timestamp(t), 15, "minutes").alias("rounded"), M.date_compare(t, F.lit("1996-05-05").cast("timestamp"), "years").alias("same_year"),
    )


ARR = "WITH a AS (SELECT o_custkey, list(o_orderkey % 10 ORDER BY o_orderkey) AS v, list(o_orderkey % 7 ORDER BY o_orderkey) AS w FROM orders GROUP BY 1)"
_J = "array_to_string({}, ',')"


@q("FN-ARR", oracle=f"""{ARR}
SELECT o_custkey, CAST(len(v) AS BIGINT) AS n, CAST(len(list_distinct(v)) AS BIGINT) AS nd, v[1] AS first, v[-1] AS last, v[3] AS third, CAST(coalesce(list_position(v, 3), 0) - 1 AS BIGINT) AS pos, {_J.format('v[2:4]')} AS sl, {_J.format('list_sort(list_distinct(v))')} AS su, {_J.format('v[:-2]')} AS pop, {_J.format('v[2:]')} AS shift,
       {_J.format('list_append(v, 99)')} AS push, {_J.format('list_prepend(99, v)')} AS unshift, {_J.format('list_reverse(v)')} AS rev, {_J.format('list_filter(v, lambda x: x <> 3)')} AS rv, {_J.format('list_filter(v, lambda x: NOT list_contains(w, x))')} AS rvs,
       {_J.format('list_sort(list_intersect(v, w))')} AS inter, {_J.format('list_sort(list_distinct(list_concat(v, w)))')} AS uni, round(len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))), 6) AS jac, {_J.format('list_sort(list_concat(list_distinct(list_filter(v, lambda x: NOT list_contains(w, x))), list_distinct(list_filter(w, lambda x: NOT list_contains(v, x)))))')} AS outer_, {_J.format('list_transform(v, lambda x: x * 2)')} AS dbl
FROM a""")
def fn_array(spark: SparkSession, d: str) -> DataFrame:
    s = F.struct("o_orderkey", (F.col("o_orderkey") % 10).alias("a"), (F.col("o_orderkey") % 7).alias("b"))
    a = load(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(s)).alias("x")).select("o_custkey", F.transform("x", lambda x: x.a).alias("v"), F.transform("x", lambda x: x.b).alias("w"))
    v, w = F.col("v"), F.col("w")
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select(
        "o_custkey", F.size(v).cast("long").alias("n"), A.count_distinct(v).cast("long").alias("nd"), A.first(v).alias("first"), A.last(v).alias("last"), A.nth(v, 2).alias("third"), A.position(v, 3).alias("pos"), j(A.slice0(v, 1, 3)).alias("sl"),
        j(A.sorted_unique(v)).alias("su"), j(A.pop(v)).alias("pop"), j(A.shift(v)).alias("shift"), j(A.push(v, F.lit(99).cast("long"))).alias("push"), j(A.unshift(v, F.lit(99).cast("long"))).alias("unshift"), j(F.reverse(v)).alias("rev"),
        j(A.remove_value(v, F.lit(3).cast("long"))).alias("rv"), j(A.remove_values(v, w)).alias("rvs"), j(F.array_sort(F.array_intersect(v, w))).alias("inter"), j(F.array_sort(F.array_union(v, w))).alias("uni"), F.round(A.jaccard(v, w), 6).alias("jac"),
        j(F.array_sort(A.outersection(v, w))).alias("outer_"), j(F.transform(v, lambda x: x * 2)).alias("dbl"),
    )


@q("FN-OBJ", "FN-TYPE", oracle="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '=' || user_id AS kept, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS num, value <> 0 AS t FROM events""")
def fn_object(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("x"), F.lit("y"))
    k = M.keep(M.merge(m, F.create_map(F.lit("x"), F.lit("z"))), "type", "user")
    return load(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.try_element_at(k, F.lit("type")), F.lit("="), F.try_element_at(k, F.lit("user"))).alias("kept"), V.to_number(F.col("event_type")).alias("num"), V.truthy_number(F.col("value")).alias("t")
    )


@q("FN-OBJ", "FN-TYPE", oracle="""
WITH e AS (SELECT event_id, event_type, props, '{"k":{"deep":' || event_id || ',"x":[1,{"x":2}]},"x":"' || event_type || '"}' AS other FROM events)
SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' ELSE '?' END AS whole, CASE WHEN json_type(json_extract(other, '$.k.x')) = 'ARRAY' THEN 'array' ELSE '?' END AS inner_, 'number' AS number_,
       CAST(json_merge_patch('{"y":0,"k":{"old":1}}', other) AS VARCHAR) AS merged_, '{"k":{"deep":' || event_id || '}}' AS unset_, '{"k":{"x":[1,{"x":2}]},"x":"' || event_type || '"}' AS kept_,
       CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'pressed' ELSE event_type END AS told, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'pressed' ELSE 'other' END AS told_or FROM e""")
def fn_documents(spark: SparkSession, d: str) -> DataFrame:
    """Types of JSON values, recursive merges and projections, translations."""
    other = F.concat(F.lit('{"k":{"deep":'), F.col("event_id").cast("string"), F.lit(',"x":[1,{"x":2}]},"x":"'), F.col("event_type"), F.lit('"}'))
    lookup = F.create_map(F.lit("view"), F.lit("seen"), F.lit("click"), F.lit("pressed"))
    return load(spark, d, "events").withColumn("other", other).select(
        "event_id", D.typename(F.col("props")).alias("whole"), D.typename(F.get_json_object("other", "$.k.x")).alias("inner_"), D.typename(F.get_json_object("other", "$.k.deep")).alias("number_"),
        D.merge_recursive(F.lit('{"y":0,"k":{"old":1}}'), F.col("other")).alias("merged_"), D.unset_recursive(F.col("other"), "x").alias("unset_"), D.keep_recursive(F.col("other"), "k", "x").alias("kept_"),
        D.translate(F.col("event_type"), lookup).alias("told"), D.translate(F.col("event_type"), lookup, F.lit("other")).alias("told_or"),
    )


@q("FN-BIT", oracle="""
SELECT p_partkey, p_partkey & 255 AS a, p_partkey | 1 AS o, xor(p_partkey, 170) AS x, (p_partkey << 2) & 65535 AS sl, p_partkey >> 1 AS sr, CAST(bit_count(p_partkey) AS BIGINT) AS pop, ~p_partkey & 65535 AS neg, lpad(bin(p_partkey & 65535), 16, '0') AS s FROM part""")
def fn_bit(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    lit = lambda n: F.lit(n).cast("long")
    return load(spark, d, "part").select(
        "p_partkey", p.bitwiseAND(lit(255)).alias("a"), p.bitwiseOR(lit(1)).alias("o"), M.bit_fold(F.array(p, lit(170)), "xor").alias("x"), M.bit_shift_left(p, 2, 16).alias("sl"), F.shiftright(p, 1).alias("sr"),
        F.bit_count(p).cast("long").alias("pop"), M.bit_negate(p, 16).alias("neg"), M.bit_to_string(p.bitwiseAND(lit(65535)), 16).alias("s"),
    )


@q("FN-MISC", oracle="""
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_nationkey < 5 THEN 'near' END, 'other') AS kind, (c_acctbal > 0)::INT + (c_nationkey > 10)::INT + (c_mktsegment = 'BUILDING')::INT >= 2 AS two FROM customer""")
def fn_misc(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        "c_custkey", V.not_null(F.when(F.col("c_acctbal") > 5000, "rich"), F.when(F.col("c_nationkey") < 5, "near"), F.lit("other")).alias("kind"),
        V.min_match(2, F.col("c_acctbal") > 0, F.col("c_nationkey") > 10, F.col("c_mktsegment") == "BUILDING").alias("two"),
    )


@q("FN-GEO", oracle="""
WITH p AS (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)
SELECT n_nationkey, round(2 * 6371000 * asin(sqrt(pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2))), 3) AS metres, (lon BETWEEN -40 AND 60 AND lat BETWEEN -20 AND 25) AS inside FROM p WHERE lon NOT IN (-40, 60) AND lat NOT IN (-20, 25)""")
def fn_geo(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon")).filter("lon NOT IN (-40, 60) AND lat NOT IN (-20, 25)")
    box = [(-40.0, -20.0), (60.0, -20.0), (60.0, 25.0), (-40.0, 25.0)]
    return p.select("n_nationkey", F.round(M.distance_m(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 3).alias("metres"), M.in_polygon(F.col("lon"), F.col("lat"), box).alias("inside"))


@q("NRM-01", "NRM-02", "NRM-03", "NRM-04", "NRM-05", oracle="""
WITH n AS (SELECT p_partkey AS k, p_name AS n, 'Cpu9_' || replace(p_name, ' ', '_') AS label FROM part), w AS (SELECT *, string_split(n, ' ') AS w FROM n)
SELECT k AS p_partkey, trim(regexp_replace(regexp_replace('wire [3:0] ' || n || '/q$', '\\b(reg|wire|input|output|assign)\\b|\\s+', '', 'g'), '[^a-zA-Z0-9_:.-]', '_', 'g'), '_') AS ident,
       replace(n, '_', ' ') AS norm, upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS acr,
       CASE WHEN list_contains(w, 'gizmo') THEN array_to_string(list_transform(w, lambda x: CASE WHEN x = 'gizmo' THEN 'Small Device' ELSE upper(x[1]) || x[2:] END), ' ') END AS expanded,
       array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 3))), ' ') AS tokens, n || ' ;' AS bare, lower(replace(n, ' ', '_')) AS suffix FROM w""")
def fn_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    label = F.concat(F.lit("Cpu9_"), F.replace(n, F.lit(" "), F.lit("_")))
    return load(spark, d, "part").select(
        "p_partkey", S.sanitize_id(F.concat(F.lit("wire [3:0] "), n, F.lit("/q$"))).alias("ident"), S.normalize_name(label, ("cpu9_",)).alias("norm"), S.acronym(n).alias("acr"),
        S.expand_acronyms(F.regexp_replace(F.initcap(n), " ", ""), {"gizmo": "Small Device"}).alias("expanded"), F.array_join(F.array_sort(S.tokens_min3(n)), " ").alias("tokens"),
        S.strip_comments(F.concat(n, F.lit(" /* a\n b */;// c"))).alias("bare"), S.label_suffix(label).alias("suffix"),
    )
