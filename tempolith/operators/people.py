"""Authors, ownership and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def parse_author(s: Column) -> Column:
    """``Name <mail>``, a mail address alone, or a name alone, as a struct (name, email)."""
    mail = F.regexp_extract(s, r"<([^<>]+)>", 1)
    bare = s.rlike(r"^\s*[^\s<>@]+@[^\s<>@]+\s*$")
    name = F.trim(F.regexp_replace(s, r"<[^<>]*>", ""))
    return F.when(F.length(mail) > 0, F.struct(F.when(F.length(name) > 0, name).otherwise(F.split_part(mail, F.lit("@"), F.lit(1))).alias("name"), F.lower(F.trim(mail)).alias("email"))).when(
        bare, F.struct(F.split_part(F.trim(s), F.lit("@"), F.lit(1)).alias("name"), F.lower(F.trim(s)).alias("email"))
    ).otherwise(F.struct(F.trim(s).alias("name"), F.lit(None).cast("string").alias("email")))


def email_key(email: Column) -> Column:
    """Key of an author: the local part in small letters, other characters as single underscores."""
    local = F.lower(F.split_part(F.trim(email), F.lit("@"), F.lit(1)))
    return F.regexp_replace(F.regexp_replace(local, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_active(last_seen: Column, as_of: int, days: int = 180) -> Column:
    return (F.lit(as_of) - last_seen) <= days * DAY


def maintenance_score(commits: Column, total: Column, days_since: Column) -> Column:
    """0.6 share of commits + 0.4 recency, three digits; recency falls evenly from 1 to 0.1 over a year."""
    freq = F.least(commits / F.greatest(total, F.lit(1)), F.lit(1.0))
    recency = F.when(days_since <= 0, 1.0).when(days_since >= 365, 0.1).otherwise(1 - days_since / 365 * 0.9)
    return F.round(0.6 * freq + 0.4 * recency, 3)


def rollup(commits: DataFrame, author: str, ts: str) -> DataFrame:
    return commits.groupBy(author).agg(F.count("*").alias("total_commits"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def maintains(touches: DataFrame, author: str, module: str, ts: str, as_of: int, least: int = 3, share: float = 0.2) -> DataFrame:
    """Who maintains what: at least ``least`` changes of a module, or ``share`` of all of its changes."""
    g = touches.groupBy(author, module).agg(F.count("*").alias("commits"), F.max(ts).alias("last"))
    g = g.withColumn("total", F.sum("commits").over(Window.partitionBy(module)))
    g = g.filter((F.col("commits") >= least) | (F.col("commits") / F.col("total") >= share))
    return g.withColumn("score", maintenance_score(F.col("commits"), F.col("total"), F.floor((F.lit(as_of) - F.col("last")) / DAY)))


def bus_factor(maintained: DataFrame, author: str, module: str) -> DataFrame:
    """(module, experts, status): how many maintain it."""
    n = maintained.groupBy(module).agg(F.countDistinct(author).alias("experts"))
    return n.withColumn("status", F.when(F.col("experts") <= 1, "critical").when(F.col("experts") == 2, "at_risk").otherwise("covered"))


def collaborators(maintained: DataFrame, author: str, module: str) -> DataFrame:
    """Pairs of authors and how many modules they share."""
    a = maintained.select(F.col(author).alias("a"), module).distinct()
    b = a.select(F.col("a").alias("b"), module)
    g = a.join(b, module).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return g.withColumn("strength", F.when(F.col("shared") >= 5, "strong").when(F.col("shared") >= 2, "medium").otherwise("weak"))


def risk(maintainers: Column, active: Column) -> Column:
    """Risk of losing a module's knowledge: by how few maintain it, and how many of these are no longer active."""
    few = F.when(maintainers == 0, 100).when(maintainers == 1, 70).when(maintainers == 2, 30).otherwise(0)
    gone = F.when(active == 0, 50).when(active < maintainers, 20).otherwise(0)
    return few + gone


def risk_level(score: Column) -> Column:
    return F.when(score >= 100, "CRITICAL").when(score >= 70, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
