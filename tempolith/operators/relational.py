"""Joins, quantifiers, set operations and keyed writes that have no single DataFrame method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- joins --------------------------------------------------------------------------------------


def left_collect(left: DataFrame, right: DataFrame, on: str, fields: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """Left join that nests the matches: each left row gets an array of structs, empty without a match."""
    item = F.struct(*(order or []), *[f for f in fields if f not in (order or [])])
    nested = right.groupBy(on).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    nested = nested.select(on, F.transform("_all", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
    empty = F.array().cast(nested.schema[name].dataType)
    return left.join(nested, on, "left").withColumn(name, F.coalesce(name, empty))


def as_of_previous(events: DataFrame, versions: DataFrame, keys: list[str], ts: str, version_ts: str, order: list[str]) -> DataFrame:
    """Each event with the latest version of its key at or before it.

    One shuffle on the key: both sides are stacked, and the last version seen is carried forward, so no pair of
    an event and a version that isn't the answer is ever made.
    """
    names = [c for c in versions.columns if c not in keys]
    v = versions.select(*keys, F.col(version_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*names).alias("_v"), *[F.lit(None).cast(events.schema[c].dataType).alias(f"_e_{c}") for c in events.columns if c not in keys], F.struct(*[F.col(c) for c in order]).alias("_o"))
    e = events.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_e_{c}") for c in events.columns if c not in keys], F.lit(None).cast(v.schema["_o"].dataType).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_ts", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = v.unionByName(e).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*keys, *[F.col(f"_e_{c}").alias(c) for c in events.columns if c not in keys], *[F.col(f"_last.{n}").alias(n) for n in names])


def ordered_pairs(rows: DataFrame, group: list[str], key: str, first: str, second: str, span: int = 1 << 14) -> DataFrame:
    """(group, pairs): how many pairs of a row that counts as ``first`` and one that counts as ``second`` have keys in rising order.

    No pair is made. ``first`` and ``second`` are numbers, ``key`` is a whole one. Keys are cut into stretches of
    ``span``: within a stretch, a running sum counts what comes before a row; between stretches, their totals do, so no
    window has more than a stretch of a group.
    """
    r = rows.filter(F.col(key).isNotNull()).select(*group, F.col(key).alias("_k"), F.floor(F.col(key) / span).alias("_at"), F.col(first).cast("long").alias("_a"), F.col(second).cast("long").alias("_b"))
    near = Window.partitionBy(*group, "_at").orderBy("_k").rangeBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = r.withColumn("_n", F.col("_b") * F.coalesce(F.sum("_a").over(near), F.lit(0)))
    across = r.groupBy(*group, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).withColumn("_n", F.col("_b") * F.coalesce(F.sum("_a").over(far), F.lit(0)))
    return within.select(*group, "_n").unionByName(across.select(*group, "_n")).groupBy(*group).agg(F.sum("_n").alias("pairs"))


def nearest(rows: DataFrame, keys: list[str], ts: str, at: int, pick: list[str]) -> DataFrame:
    """For each key the row nearest to a time, on either side; ties go to the earlier."""
    best = F.min(F.struct(F.abs(F.col(ts) - at).alias("_d"), F.col(ts).alias("_t"), *pick))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._t").alias(ts), F.col("_b._d").alias("distance"), *[F.col(f"_b.{p}").alias(p) for p in pick if p != ts])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals that meet, within equal keys.

    Both sides are dealt to the cells of a grid of ``width``, clipped to the time that both cover; a pair is made in
    the first cell that they share, so it comes once, and the join is an equi-join on key and cell instead of a scan
    of all pairs. Empty intervals meet nothing.
    """
    lo, hi = (left.agg(F.min(l[0]), F.max(l[1])).first(), right.agg(F.min(r[0]), F.max(r[1])).first())
    if lo[0] is None or hi[0] is None:
        lo = hi = (0, 0)
    first, end = max(lo[0], hi[0]), min(lo[1], hi[1])

    def cells(df: DataFrame, at: str, to: str) -> DataFrame:
        """Rows that meet the time that both sides cover, in each of their cells there; open ends have no cells beyond."""
        d = df.filter((F.col(at) < F.col(to)) & (F.col(at) < end) & (F.col(to) > first))
        return d.withColumn("_cell", F.explode(F.sequence(F.floor(F.greatest(F.col(at), F.lit(first)) / width), F.floor((F.least(F.col(to), F.lit(end)) - 1) / width))))

    a, b = cells(left, *l), cells(right, *r)
    j = a.join(b, [*keys, "_cell"])
    meets = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    return j.filter(meets & (F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width) == F.col("_cell"))).drop("_cell")


def dangling(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges that miss an endpoint, with ``missing``: from, to or both."""
    ids = nodes.select(key).distinct()
    e = edges.join(ids.select(F.col(key).alias("_s")), F.col(src) == F.col("_s"), "left").join(ids.select(F.col(key).alias("_t")), F.col(dst) == F.col("_t"), "left")
    missing = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both").when(F.col("_s").isNull(), "from").when(F.col("_t").isNull(), "to")
    return e.withColumn("missing", missing).filter("missing IS NOT NULL").drop("_s", "_t")


def repaired(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges with both endpoints."""
    ids = nodes.select(key).distinct()
    e = edges.join(ids.select(F.col(key).alias(src)), src, "left_semi")
    return e.join(ids.select(F.col(key).alias(dst)), dst, "left_semi")


def neighbours_any(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Both orientations as (node, other): the union of two equi-joinable halves, never an OR join."""
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))


# --- quantifiers --------------------------------------------------------------------------------


def all_of(a: Column, f) -> Column:
    return F.forall(a, f)


def any_of(a: Column, f) -> Column:
    return F.exists(a, f)


def none_of(a: Column, f) -> Column:
    return ~F.exists(a, f)


def at_least(n: int, a: Column, f) -> Column:
    return F.size(F.filter(a, f)) >= n


# --- sets ---------------------------------------------------------------------------------------


def outersection(*frames: DataFrame) -> DataFrame:
    """Rows that exactly one frame has, once."""
    all_ = frames[0].distinct()
    for f in frames[1:]:
        all_ = all_.unionByName(f.distinct())
    cols = frames[0].columns
    return all_.groupBy(*cols).agg(F.count("*").alias("_n")).filter("_n = 1").select(*cols)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, modified or unchanged between two snapshots."""
    b, a = before.select(F.col(key).alias("_b"), F.col(digest).alias("_bd")), after.select(F.col(key).alias("_a"), F.col(digest).alias("_ad"))
    j = b.join(a, F.col("_b") == F.col("_a"), "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_bd").eqNullSafe(F.col("_ad")), "unchanged").otherwise("modified")
    return j.select(F.coalesce("_b", "_a").alias(key), change.alias("change"))


# --- keyed writes -------------------------------------------------------------------------------


def upsert(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by ``seq``; rows of ``changes`` come after those of ``base``."""
    stacked = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(seq))
    return stacked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def insert(base: DataFrame, new: DataFrame, key: str, mode: str) -> DataFrame:
    """Insert documents: ``replace`` whole ones, ``update`` their non-null fields, ``ignore`` or ``conflict`` on known keys."""
    if mode == "ignore":
        return base.unionByName(new.join(base.select(key), key, "left_anti"))
    if mode == "replace":
        return base.join(new.select(key), key, "left_anti").unionByName(new)
    if mode == "update":
        b, n = base.select(*[F.col(c).alias(f"_b_{c}") for c in base.columns]), new
        j = b.join(n, F.col(f"_b_{key}") == F.col(key), "full")
        return j.select(*[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) for c in base.columns])
    if mode == "conflict":
        clash = new.join(base.select(key), key, "left_semi").limit(1).count()
        if clash:
            raise ValueError(f"a document with this {key} exists already")
        return base.unionByName(new)
    raise ValueError(f"unknown mode {mode!r}")


def remove(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def unseen(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys an ingestion log doesn't have yet."""
    return rows.join(log.select(*keys).distinct(), keys, "left_anti")
