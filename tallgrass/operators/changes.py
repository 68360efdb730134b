"""Change data: listings of changed files, and their application to the stored points."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import paths


def parse_status_lines(lines: DataFrame, excludes: Iterable[str] = (), parity: bool = False) -> DataFrame:
    """``(path, status, old_path)`` from rows ``line`` such as ``M<tab>a.ts`` or ``R100<tab>old<tab>new``.

    Blank lines and lines without a path are dropped, and so are skipped paths. A
    rename onto a skipped path becomes the deletion of its old path; with
    ``parity=True`` it is dropped as a whole.
    """
    parts = F.split(F.col("line"), "\t", -1)
    code = F.substring(F.get(parts, F.lit(0)), 1, 1)
    renamed = code == "R"
    rows = lines.where(F.trim("line") != "").select(
        F.when(renamed, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), code.alias("status"), F.when(renamed, F.get(parts, F.lit(1))).alias("old_path")
    )
    rows = rows.where(F.coalesce("path", F.lit("")) != "").withColumn("_skip", paths.is_skipped(F.col("path"), excludes))
    kept = rows.where(~F.col("_skip")).drop("_skip")
    if parity:
        return kept
    moved_out = rows.where(F.col("_skip") & (F.col("status") == "R") & ~paths.is_skipped(F.col("old_path"), excludes))
    return kept.unionByName(moved_out.select(F.col("old_path").alias("path"), F.lit("D").alias("status"), F.lit(None).cast("string").alias("old_path")))


def full_listing(listed: DataFrame, excludes: Iterable[str] = ()) -> DataFrame:
    """Every listed path as an addition; blanks and skipped paths are dropped."""
    kept = listed.where((F.trim("path") != "") & ~paths.is_skipped(F.col("path"), excludes))
    return kept.select("path", F.lit("A").alias("status"), F.lit(None).cast("string").alias("old_path"))


def paths_to_upsert(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status").isin("A", "M", "R")).select(*_keys(changes), "path").distinct()


def paths_to_delete(changes: DataFrame) -> DataFrame:
    """Paths whose points go: changed, deleted, and the old names of renamed files."""
    own = changes.where(F.col("status").isin("M", "R", "D", "A")).select(*_keys(changes), "path")
    old = changes.where((F.col("status") == "R") & F.col("old_path").isNotNull()).select(*_keys(changes), F.col("old_path").alias("path"))
    return own.unionByName(old).distinct()


def _keys(changes: DataFrame) -> list[str]:
    return ["repo"] if "repo" in changes.columns else []


def count_by_file(points: DataFrame, keys: DataFrame) -> DataFrame:
    """Number of stored points of each wanted ``(repo, file_path)``; files without points have no row."""
    wanted = keys.select("repo", "file_path").distinct()
    return points.join(wanted, ["repo", "file_path"], "left_semi").groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n_points"))


def delete_files(points: DataFrame, keys: DataFrame) -> DataFrame:
    """Points whose ``(repo, file_path)`` is not among the keys."""
    return points.join(keys.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")


def delete_paths(points: DataFrame, keys: DataFrame) -> DataFrame:
    return points.join(keys.select("file_path").distinct(), "file_path", "left_anti")


def delete_repos(points: DataFrame, repos: Iterable[str]) -> DataFrame:
    """Points of all other repositories; points without a repository stay."""
    names = list(repos)
    return points.where(~F.coalesce(F.col("repo").isin(*names), F.lit(False))) if names else points


def upsert(points: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Replace points by id. Repeated ids in ``new`` are written once, which row is decided by its values."""
    from tallgrass.session import distinct_by_key

    unique = distinct_by_key(new, key)
    return points.join(unique.select(key), key, "left_anti").unionByName(unique, allowMissingColumns=True)


def apply_changes(points: DataFrame, changes: DataFrame, new_points: DataFrame) -> DataFrame:
    """The table after a change set: points of changed and deleted files go, new ones come.

    ``changes`` has ``repo, path, status, old_path``. The new points are computed
    before anything is deleted, so that a failure leaves the table as it was.
    """
    gone = paths_to_delete(changes).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
    return upsert(delete_files(points, gone), new_points)


def change_counters(points: DataFrame, changes: DataFrame, new_points: DataFrame) -> DataFrame:
    """Per repository: files processed, points deleted and points upserted."""
    gone = paths_to_delete(changes).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
    deleted = count_by_file(points, gone).groupBy("repo").agg(F.sum("n_points").alias("points_deleted"))
    processed = changes.groupBy("repo").agg(F.count(F.lit(1)).alias("files_processed"))
    made = new_points.groupBy("repo").agg(F.count(F.lit(1)).alias("points_upserted"))
    out = processed.join(deleted, "repo", "full_outer").join(made, "repo", "full_outer")
    return out.select("repo", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files_processed", "points_deleted", "points_upserted")])


def next_totals(state: DataFrame, counters: DataFrame) -> DataFrame:
    """Running total per repository: old + upserted - deleted, never below 0."""
    joined = state.select("repo", "total_chunks").join(counters, "repo", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("repo", F.greatest(F.lit(0), zero("total_chunks") + zero("points_upserted") - zero("points_deleted")).cast("bigint").alias("total_chunks"))


def index_status(repos: DataFrame, state: DataFrame, points: DataFrame) -> DataFrame:
    """State of every configured repository, with the points that are really stored."""
    stored = points.groupBy("repo").agg(F.count(F.lit(1)).alias("stored_points"))
    joined = repos.select("repo").distinct().join(state, "repo", "left").join(stored, "repo", "left")
    return joined.select(
        "repo",
        F.when(F.col("last_indexed").isNull(), F.lit("not indexed")).otherwise(F.lit("indexed")).alias("status"),
        "last_commit",
        "last_indexed",
        F.coalesce("total_chunks", F.lit(0)).cast("bigint").alias("total_chunks"),
        F.coalesce("stored_points", F.lit(0)).cast("bigint").alias("stored_points"),
    )
