"""Listings from git, read on the driver. Git gets an argument list and never a shell string."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tallgrass import model
from tallgrass.operators import changes


class GitError(RuntimeError):
    pass


def _git(repo_path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo_path, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise GitError(done.stderr.strip())
    return done.stdout


def head_commit(repo_path: str) -> str:
    return _git(repo_path, "rev-parse", "HEAD").strip()


def list_files(spark: SparkSession, repo_path: str, excludes: Iterable[str] = ()) -> DataFrame:
    """All tracked files as additions."""
    rows = [(line,) for line in _git(repo_path, "ls-files").split("\n") if line]
    return changes.full_listing(spark.createDataFrame(rows, "path string"), excludes)


def changed_files(spark: SparkSession, repo_path: str, last_commit: str | None, excludes: Iterable[str] = ()) -> DataFrame:
    """Changes since a commit, or of the last commit without one; if git fails, the full listing."""
    span = f"{last_commit}..HEAD" if last_commit else "HEAD~1..HEAD"
    try:
        out = _git(repo_path, "diff", "--name-status", span)
    except GitError:
        return list_files(spark, repo_path, excludes)
    return changes.parse_status_lines(spark.createDataFrame([(line,) for line in out.split("\n")], "line string"), excludes)


def read_files(spark: SparkSession, repo: str, repo_path: str, listing: DataFrame, commit: str) -> DataFrame:
    """``repo, path, source, commit_hash`` of the listed files that can be read.

    The files are read by the executors, so the folder must be visible to them.
    Undecodable bytes become replacement characters; unreadable files have no row.
    """
    from pyspark.sql import functions as F

    root = repo_path.rstrip("/") + "/"

    def read(batches):
        for pdf in batches:
            kept = []
            for path in pdf["path"]:
                try:
                    with open(root + path, "rb") as f:
                        kept.append((path, f.read().decode("utf-8", "replace")))
                except OSError:
                    continue
            import pandas as pd

            yield pd.DataFrame(kept, columns=["path", "source"]).astype(object)

    read_rows = listing.select("path").distinct().mapInPandas(read, "path string, source string")
    return read_rows.select(F.lit(repo).alias("repo"), "path", "source", F.lit(commit).alias("commit_hash"))


def empty_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.FILES)
