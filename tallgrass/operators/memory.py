"""Search of memory entries: exact ids first, then semantic hits, with staleness notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text

ID_LIMIT = 5


def find_by_ids(points: DataFrame, ids: list[str], repo: str | None = None, limit: int = ID_LIMIT) -> DataFrame:
    """Up to ``limit`` memory rows per id, in the order of the ids. The stored id is compared as it is."""
    kept = points.where((F.col("kind") == "memory") & F.col("memory_id").isin(*ids) if ids else F.lit(False))
    if repo:
        kept = kept.where(F.col("repo") == repo)
    order = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("memory_id")) if ids else F.lit(0)
    n = F.row_number().over(Window.partitionBy("memory_id").orderBy("point_id"))
    return kept.withColumn("_n", n).where(F.col("_n") <= limit).withColumn("id_order", order.cast("int")).drop("_n")


def pin_merge(pinned: DataFrame, semantic: DataFrame, limit: int, key: str = "point_id") -> DataFrame:
    """Pinned rows ahead of the semantic ones that aren't pinned, cut to ``max(limit, pinned)``.

    Both inputs have ``key, score, rank``; they are short ranked lists.
    """
    first = pinned.select(key, F.lit(1.0).alias("score"), F.lit(0).alias("_tier"), "rank")
    rest = semantic.join(F.broadcast(pinned.select(key)), key, "left_anti").select(key, "score", F.lit(1).alias("_tier"), "rank")
    w = Window.orderBy("_tier", "rank", key)
    merged = first.unionByName(rest).select(key, "score", "_tier", F.row_number().over(w).alias("rank"))
    return merged.where((F.col("rank") <= limit) | (F.col("_tier") == 0)).drop("_tier")


def render_memory(now: Column, limit_days: int = 60) -> Column:
    """The text block of a memory hit; missing parts leave no line."""
    stale = text.staleness(F.col("memory_type"), F.col("last_verified"), now, limit_days)
    age = text.age_days(F.col("last_verified"), now)
    title = F.coalesce("title", "symbol_name", F.lit(""))
    head = F.concat(
        F.lit("["), F.coalesce("memory_type", F.lit("note")), F.lit("] "), F.when(F.coalesce("memory_id", F.lit("")) != "", F.concat("memory_id", F.lit(" — "))).otherwise(""), title
    )
    notes = F.when(stale == "stale", F.concat(F.lit("⚠ stale: unverified for "), age.cast("string"), F.lit(" days — confirm it still holds before relying on it"))).when(
        (stale == "undated") & F.col("last_verified").isNull(), F.lit("⚠ no verification date — confirm it still holds before relying on it")
    )
    return F.concat_ws(
        "\n",
        head,
        F.when(F.col("when_relevant") != "", F.concat(F.lit("When relevant: "), "when_relevant")),
        F.when(F.col("last_verified") != "", F.concat(F.lit("Last verified: "), "last_verified")),
        notes,
        F.when(F.size("evidence") > 0, F.concat(F.lit("Evidence: "), F.array_join("evidence", ", "))),
        F.concat(F.lit("Score: "), F.format_string("%.4f", F.coalesce("score", F.lit(0.0)))),
        F.lit(""),
        F.coalesce("text", F.lit("")),
    )


def render_code() -> Column:
    """The text block of a code hit."""
    unknown = F.lit("unknown")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), F.coalesce("file_path", F.lit(""))),
        F.concat(F.lit("Repository: "), F.coalesce("repo", F.lit(""))),
        F.concat(F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("Symbol: "), F.coalesce("symbol_name", unknown), F.lit(" ("), F.coalesce("symbol_type", unknown), F.lit(")")),
        F.concat(F.lit("Score: "), F.format_string("%.4f", F.coalesce("score", F.lit(0.0)))),
        F.lit(""),
        F.coalesce("text", F.lit("")),
    )
