"""Analytics over the retrieval log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_HITS, LISTED_QUERIES, LISTED_ENTRIES = 15, 10, 20
BAR = 40


def select_events(log: DataFrame, collection: str | None = None, days: int | None = None, now: datetime | None = None) -> DataFrame:
    """Events of a collection since ``now - days``; without ``days`` also those without a time."""
    out = log.where(F.col("collection") == collection) if collection else log
    if days:
        if now is None:
            raise ValueError("days needs now")
        out = out.where(F.col("ts") >= F.lit(now - timedelta(days=days)))
    return out


def calls_by_day(log: DataFrame) -> DataFrame:
    """``(day, calls, bar)`` per day; events without a time have a null day."""
    by_day = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return by_day.withColumn("bar", F.expr(f"repeat('█', cast(least(calls, {BAR}) as int))"))


def usage_summary(log: DataFrame) -> DataFrame:
    """One row: calls, days with calls, first and last day. An empty log gives 0, 0, null, null."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return log.select(day.alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def hit_counts(log: DataFrame) -> DataFrame:
    """``(id, n, type)`` per retrieved id; the type is that of the first event that has one of the id's hits.

    Hits without an id or with an empty one are dropped. Counting is combined on the
    map side, so that an id in a third of all events costs one row per input partition.
    """
    hits = log.select("ts", "event_id", F.posexplode("hits").alias("_pos", "_h")).where("_h.id <> ''")
    first = F.min(F.struct("ts", "event_id", "_pos", "_h.type"))
    counted = hits.groupBy(F.col("_h.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
    return counted.select("id", "n", F.col("_first.type").alias("type"), F.col("_first.ts").alias("first_ts"))


def top_hits(log: DataFrame, k: int = TOP_HITS) -> DataFrame:
    return hit_counts(log).orderBy(F.desc("n"), "first_ts", "id").limit(k).select("id", "n", "type")


def empty_queries(log: DataFrame) -> DataFrame:
    """``(query, n, first_ts)`` of the searches that found nothing, one row per query text."""
    none = log.where(F.col("hits").isNull() | (F.size("hits") == 0))
    return none.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


def empty_query_report(log: DataFrame, k: int = LISTED_QUERIES) -> DataFrame:
    return empty_queries(log).orderBy("first_ts", "query").limit(k)


def dead_entries(points: DataFrame, log: DataFrame) -> DataFrame:
    """``(memory_id, memory_type)`` of stored entries that no event has retrieved."""
    indexed = points.where((F.col("kind") == "memory") & (F.col("memory_id") != "")).groupBy("memory_id").agg(F.max("memory_type").alias("memory_type"))
    seen = log.select(F.explode("hits.id").alias("memory_id")).where("memory_id is not null").distinct()
    return indexed.join(seen, "memory_id", "left_anti")


def dead_summary(points: DataFrame, log: DataFrame) -> DataFrame:
    """One row: dead entries, indexed entries, and whether consolidation is advised."""
    indexed = points.where((F.col("kind") == "memory") & (F.col("memory_id") != "")).agg(F.countDistinct("memory_id").alias("indexed"))
    dead = dead_entries(points, log).agg(F.count(F.lit(1)).alias("dead"))
    return dead.crossJoin(indexed).withColumn("consolidate", F.col("dead") > 5)


def verdict_lines(files: DataFrame) -> DataFrame:
    """``(repo, change, line)``: lines of learnings files of change folders that speak of memory impact.

    Only files named exactly ``learnings.md`` below ``openspec/changes/`` count.
    """
    from tallgrass.functions import paths, text

    learn = files.where((paths.base_name(F.col("path")) == "learnings.md") & F.col("path").rlike(r"(^|/)openspec/changes/"))
    rows = learn.select("repo", F.regexp_extract("path", r"([^/]+)/[^/]*\z", 1).alias("change"), F.explode(text.lines(F.col("source"))).alias("line"))
    return rows.where(F.col("line").rlike("(?i)memory impact")).select("repo", "change", text.strip(F.col("line")).alias("line"))


def entry_counts(files: DataFrame, threshold: int = 70) -> DataFrame:
    """``(repo, entries, needs_review)``: headings in the files of a memory folder itself, without those in comments.

    Files of folders below it and ``index.md`` don't count. Repositories without such files have no row.
    """
    notes = files.where(F.col("path").rlike(r"(^|/)openspec/memory/[^/]+\.md\z") & ~F.col("path").rlike(r"/index\.md\z"))
    clean = F.regexp_replace("source", r"<!--[\s\S]*?-->", "")
    counted = notes.select("repo", F.size(F.regexp_extract_all(clean, F.lit("(?m)(^## )"), F.lit(1))).alias("n"))
    total = counted.groupBy("repo").agg(F.sum(F.greatest("n", F.lit(0))).cast("bigint").alias("entries"))
    return total.withColumn("needs_review", F.col("entries") >= threshold)


def report(log: DataFrame, points: DataFrame, verdicts: DataFrame | None = None, collection: str | None = None, days: int | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    """The usage report as tables by name. ``log`` needs ``ts`` and ``hits``; an ``event_id`` is made up where there is none.

    The lists of dead entries and verdict lines are cut to ``LISTED_ENTRIES``, their numbers are not.
    """
    own = select_events(log, collection, days, now)
    own = own if "event_id" in own.columns else own.withColumn("event_id", F.monotonically_increasing_id())
    out = {
        "summary": usage_summary(own),
        "days": calls_by_day(own).orderBy("day"),
        "top hits": top_hits(own),
        "empty queries": empty_query_report(own),
        "dead": dead_summary(points, own),
        "dead entries": dead_entries(points, own).orderBy("memory_id").limit(LISTED_ENTRIES),
    }
    if verdicts is not None:
        out["verdicts"] = verdicts.agg(F.count(F.lit(1)).alias("verdicts"))
        out["verdict lines"] = verdicts.orderBy("change", "line").limit(LISTED_ENTRIES)
    return out
