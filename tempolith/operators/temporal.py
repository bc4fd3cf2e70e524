"""Validity intervals: half-open [valid_from_ts, valid_to_ts) in epoch seconds, open end 9999999999."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import OPEN_TS


def as_of(df: DataFrame, ts, closed: bool = False, start: str = "valid_from_ts", end: str = "valid_to_ts") -> DataFrame:
    """Rows valid at ``ts``; ``closed`` also takes intervals that end exactly then. Both tests push down."""
    t = ts if isinstance(ts, Column) else F.lit(ts)
    return df.filter((F.col(start) <= t) & (F.col(end) >= t if closed else F.col(end) > t))


def overlaps(df: DataFrame, lo: int, hi: int, start: str = "valid_from_ts", end: str = "valid_to_ts") -> DataFrame:
    """Rows whose interval meets [lo, hi)."""
    return df.filter((F.col(start) < hi) & (F.col(end) > lo))


def close_intervals(df: DataFrame, keys: list[str], ts: str, order: list[str]) -> DataFrame:
    """Turn change rows into versions: each is valid until the next one of its key."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    return df.withColumn("valid_from_ts", F.col(ts)).withColumn("valid_to_ts", F.coalesce(F.lead(ts).over(w), F.lit(OPEN_TS)))


def live_at(changes: DataFrame, keys: list[str], ts: str, order: list[str], columns: list[str], *times: int, until: bool = False) -> DataFrame:
    """What ``close_intervals`` and ``as_of`` give at each of ``times``, in one aggregation: no version is made that isn't live.

    A key's live version is its last change at or before the time, which ends with the first change after it. Gives
    (keys, t, valid_from_ts, columns), and ``valid_to_ts`` if ``until``.
    """
    c = changes if until else changes.filter(F.col(ts) <= max(times))
    last = [F.max(F.when(F.col(ts) <= t, F.struct(ts, *order, *[F.col(x).alias(f"_{x}") for x in columns]))).alias(f"_{i}") for i, t in enumerate(times)]
    ends = [F.min(F.when(F.col(ts) > t, F.col(ts))).alias(f"_end{i}") for i, t in enumerate(times)] if until else []
    at = [F.struct(F.lit(t).alias("t"), F.col(f"_{i}").alias("v"), *([F.coalesce(f"_end{i}", F.lit(OPEN_TS)).alias("end")] if until else [])) for i, t in enumerate(times)]
    v = c.groupBy(*keys).agg(*last, *ends).select(*keys, F.explode(F.array(*at)).alias("a")).filter("a.v IS NOT NULL")
    return v.select(*keys, "a.t", F.col(f"a.v.{ts}").alias("valid_from_ts"), *[F.col(f"a.v._{x}").alias(x) for x in columns], *([F.col("a.end").alias("valid_to_ts")] if until else []))


def diff_at(live: DataFrame, t1: int, t2: int, key: str) -> DataFrame:
    """``diff`` of what ``live_at`` gives for both times: one more aggregation."""
    g = live.groupBy(key).agg(F.bool_or(F.col("t") == t1).alias("_a"), F.bool_or(F.col("t") == t2).alias("_b")).filter("_a <> _b")
    return g.select(key, F.when(F.col("_b"), "new").otherwise("removed").alias("change"))


def diff(versions: DataFrame, t1: int, t2: int, key: str) -> DataFrame:
    """(key, change): keys that are live at t2 only (new) or at t1 only (removed)."""
    a, b = as_of(versions, t1).select(key).distinct(), as_of(versions, t2).select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def replay(snapshots: DataFrame, module: str, seq: str, digest: str) -> DataFrame:
    """Versions from snapshots: (module, seq, digest, role, until), a row where the digest changes."""
    w = Window.partitionBy(module).orderBy(seq)
    c = snapshots.withColumn("_before", F.lag(digest).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(digest)))
    role = F.when(F.col("_before").isNull(), "introduced_in").otherwise("modified_in")
    return c.select(module, seq, digest, role.alias("role"), F.coalesce(F.lead(seq).over(w), F.lit(OPEN_TS)).alias("until"))


#: Days without a boundary after which a new period starts; share of changed files that makes a refactoring.
PERIOD_DAYS, REFACTOR_SHARE = 180, 0.15


def clean_tag(tag: str) -> str:
    """A tag without the v before it; slashes, dots and hyphens are underscores."""
    import re

    return re.sub(r"[/.\-]", "_", tag.lstrip("v"))


def epoch_labels(rows: list[tuple[int, str | None, float, str]], opens: bool = True) -> list[str]:
    """Labels of commits (ts, tag, share of changed files, commit) of one repository, oldest first.

    The first commit is ``initial_commit``, a tagged one a milestone, one long after the last boundary opens a
    period of its month, one that changes much a refactoring; any other belongs to the epoch before it, or to
    ``development`` after the first commit. Whether a commit is long after a boundary depends on earlier
    decisions, so this is a fold; a tag starts it afresh. ``opens``: the rows begin with the first commit.
    """
    from datetime import datetime, timezone

    out, boundary, last = [], rows[0][0] if rows else 0, "development"
    for i, (ts, tag, share, commit) in enumerate(rows):
        if i == 0 and opens:
            label = "initial_commit"
        elif tag is not None:
            label = f"milestone_{clean_tag(tag)}"
        elif ts - boundary > PERIOD_DAYS * 86400:
            label = f"period_{datetime.fromtimestamp(ts, timezone.utc):%Y_%m}"
        elif share >= REFACTOR_SHARE:
            label = f"major_refactor_{commit[:7]}"
        else:
            out.append(last)
            continue
        boundary, last = ts, "development" if label == "initial_commit" else label
        out.append(label)
    return out


def epoch_type(label: Column) -> Column:
    kind = F.when(label.startswith("milestone_"), "milestone_tag").when(label.startswith("major_refactor_"), "major_refactor")
    return kind.when(label.isin("initial_commit", "development"), label).otherwise("other")


def detect_epochs(commits: DataFrame) -> DataFrame:
    """commits (repo, commit, ts, tag, change_ratio) with ``label`` and ``epoch_type``; a task for each run of commits from a tag to the next."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "commit"])
        tags = [t if isinstance(t, str) else None for t in pdf["tag"]]
        rows = list(zip(pdf["ts"], tags, pdf["change_ratio"], pdf["commit"].astype(str)))
        return pd.DataFrame({"repo": pdf["repo"], "commit": pdf["commit"], "ts": pdf["ts"], "label": epoch_labels(rows, bool(pdf["opens"].iloc[0]))})

    line = Window.partitionBy("repo").orderBy("ts", "commit")
    d = commits.select("repo", "commit", "ts", "tag", "change_ratio").withColumn("_n", F.row_number().over(line))
    # the first commit's own tag doesn't count, so the run that it opens is number 0
    d = d.withColumn("run", F.count(F.when((F.col("_n") > 1) & F.col("tag").isNotNull(), 1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("opens", F.col("run") == 0).drop("_n").groupBy("repo", "run").applyInPandas(fold, "repo string, commit long, ts long, label string")
    return d.withColumn("epoch_type", epoch_type(F.col("label")))


def situations(commits: DataFrame, introduced: DataFrame) -> DataFrame:
    """Design situations of commits (repo, commit, ts, epoch) and modules (repo, commit, label) that came with them.

    A row for each repository, epoch and class: ``subsystem_addition``, the last commit of the epoch that brought
    modules, tagged with up to five of them; ``release_prep`` for epochs of a milestone and ``major_refactor`` for
    those of a refactoring, from their first commit to their last. The key is made of these three.
    """
    at = F.struct("ts", "commit")
    added = commits.join(introduced.groupBy("repo", "commit").agg(F.slice(F.sort_array(F.collect_set("label")), 1, 5).alias("tags")), ["repo", "commit"])
    added = added.groupBy("repo", "epoch").agg(F.max_by(F.struct("ts", "commit", "tags"), at).alias("s"))
    added = added.select(
        "repo", "epoch", F.lit("subsystem_addition").alias("situation"), F.col("s.commit").alias("first_commit"), F.col("s.commit").alias("last_commit"), F.col("s.ts").alias("from_ts"),
        F.col("s.ts").alias("to_ts"), "s.tags", F.lit("unknown").alias("outcome"), F.concat(F.lit("New module(s): "), F.array_join("s.tags", ", ")).alias("notes"),
    )
    release, epoch = F.col("epoch").startswith("milestone_"), F.col("epoch")
    tag = F.replace(F.replace(epoch, F.lit("milestone_"), F.lit("")), F.lit("_"), F.lit("."))
    spans = commits.filter(release | epoch.startswith("major_refactor_")).groupBy("repo", "epoch").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    spans = spans.select(
        "repo", "epoch", F.when(release, "release_prep").otherwise("major_refactor").alias("situation"), F.col("a.commit").alias("first_commit"), F.col("b.commit").alias("last_commit"),
        F.col("a.ts").alias("from_ts"), F.col("b.ts").alias("to_ts"),
        F.when(release, F.array(F.lit("release"), tag)).otherwise(F.array(F.lit("refactor"), F.substring_index("repo", "/", -1))).alias("tags"),
        F.when(release, "milestone_release").otherwise("unknown").alias("outcome"),
        F.when(release, F.concat(F.lit("Commits leading to release tag "), tag)).otherwise(F.concat(F.lit("Major RTL refactor in epoch "), epoch)).alias("notes"),
    )
    d = added.unionByName(spans)
    title = F.concat(F.initcap(F.replace("situation", F.lit("_"), F.lit(" "))), F.lit(" \u2014 "), "repo", F.lit(" @ "), "epoch")
    return d.select(F.substring(F.md5(F.concat_ws(":", "repo", "epoch", "situation")), 1, 16).alias("key"), title.alias("label"), "*")
