"""The stored tables: points in Parquet by repository and kind, and the state of each repository."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass import model
from tallgrass.functions import paths
from tallgrass.operators import changes


class DimensionMismatch(RuntimeError):
    """The vectors to be written have another length than the stored ones."""


class Conflict(RuntimeError):
    """Somebody else has written in the meantime; the change was not made."""


class Files:
    """Small files on any file system that Spark knows. A file appears whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._fs_package = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._fs_package.Path(os.path.join(self.folder, name) if name else self.folder)

    def names(self, folder: str = "") -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self.path(name)):
            return None
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        except Exception as e:
            raise OSError(f"{name} can't be read") from e
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool) -> bool:
        """Write beside and rename, over an old file only if ``replace``; false if there is one."""
        staged = self.path(f"staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        option = self._fs_package.Options.Rename.OVERWRITE if replace else self._fs_package.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._fs_package.Options.Rename, 1)
        options[0] = option
        context = self._fs_package.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(self.path(name)), options)
        except Exception as e:
            self._fs.delete(staged, False)
            if not replace and self._fs.exists(self.path(name)):
                return False
            raise OSError(f"{name} could not be written") from e
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class PointStore:
    """Numbered snapshots, each a list of the folders of its (repository, kind) partitions.

    A change writes new folders for the partitions that it touches, and then a snapshot
    with the next number that names these and the old folders of all others. A snapshot
    appears by a rename that fails if the number is taken, so a job that dies leaves the
    old state, and of two writers one is refused. The highest number counts. Old
    snapshots and their folders stay until ``expire``, so a search that has begun can
    end. A point belongs to the repository that its id is made from; changes look for old
    points in the repositories of the new ones.
    """

    def __init__(self, spark: SparkSession, folder: str, dimensions: int) -> None:
        self.spark, self.folder, self.dimensions = spark, folder, dimensions
        self.files = Files(spark, folder)

    # -- snapshots ---------------------------------------------------------------
    def snapshots(self) -> list[int]:
        return [int(n[9:-5]) for n in self.files.names() if n.startswith("snapshot-")]

    def _partitions(self, number: int | None = None) -> dict[str, str]:
        """Folder of each partition, by its key, of a snapshot or the current one."""
        numbers = self.snapshots()
        number = number if number is not None else max(numbers, default=None)
        return json.loads(self.files.read(f"snapshot-{number:020d}.json")) if number is not None else {}

    def _commit(self, partitions: dict[str, str], after: int | None) -> None:
        number = 0 if after is None else after + 1
        if not self.files.write(f"snapshot-{number:020d}.json", json.dumps(partitions, indent=1, sort_keys=True), replace=False):
            raise Conflict(f"snapshot {number} was written by somebody else")

    def _key(self, repo: str | None, kind: str | None = None) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        none = "__HIVE_DEFAULT_PARTITION__"
        return f"_repo={escape(repo) if repo else none}/" + (f"_kind={escape(kind) if kind else none}" if kind is not None else "")

    def expire(self, keep: int = 5) -> None:
        """Remove all but the last ``keep`` snapshots, and the folders that none of these names."""
        numbers = sorted(self.snapshots())
        kept = numbers[-keep:]
        used = {folder.split("/")[1] for n in kept for folder in self._partitions(n).values()}
        for n in set(numbers) - set(kept):
            self.files.delete(f"snapshot-{n:020d}.json")
        for name in set(self.files.names("data")) - used:
            self.files.delete(f"data/{name}")

    # -- table -----------------------------------------------------------------
    def ensure(self, allow_recreate: bool = False) -> bool:
        """Create the table if there is none. Another dimension is refused unless recreation is allowed."""
        if not self.snapshots():
            self._commit({}, None)
            return True
        stored = self.read().where("dense is not null").select(F.size("dense").alias("n")).limit(1).first()
        if stored is not None and stored["n"] != self.dimensions:
            if not allow_recreate:
                raise DimensionMismatch(f"stored vectors have {stored['n']} numbers, not {self.dimensions}")
            self._commit({}, max(self.snapshots()))
            return True
        return False

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], model.POINTS)

    def read(self, repos: Iterable[str] | None = None, kind: str | None = None, memory_type: str | None = None) -> DataFrame:
        """The current points; only folders of the wanted repositories and kind are opened."""
        heads = None if repos is None else [self._key(r) for r in repos]
        tail = None if kind is None else self._key(None, kind).partition("/")[2]
        found = [f for k, f in self._partitions().items() if (heads is None or any(k.startswith(h) for h in heads)) and (tail is None or k.endswith("/" + tail))]
        out = self.spark.read.schema(model.POINTS).parquet(*[os.path.join(self.folder, f) for f in found]) if found else self.empty()
        return out.where(F.col("memory_type") == memory_type) if memory_type else out

    def _stored(self, points: DataFrame) -> dict[str, str]:
        """Write points to new folders; rows of a folder are sorted by memory type, so that statistics tell it apart."""
        base = f"data/{uuid.uuid4().hex}"
        rows = points.select(*self.empty().columns).withColumns({"_repo": F.col("repo"), "_kind": F.col("kind")})
        # One task per partition where it is small, several where it is large.
        rows.hint("rebalance", "_repo", "_kind").sortWithinPartitions("_repo", "_kind", "memory_type").write.partitionBy("_repo", "_kind").parquet(os.path.join(self.folder, base))
        return {f"{r}/{k}": f"{base}/{r}/{k}" for r in self.files.names(base) if r.startswith("_repo=") for k in self.files.names(f"{base}/{r}")}

    def write(self, points: DataFrame) -> None:
        """Replace all points."""
        after = max(self.snapshots(), default=None)
        self._commit(self._stored(points), after)

    # -- changes ---------------------------------------------------------------
    def _change(self, touched: set[tuple[str | None, str | None]], make) -> None:
        """Replace the touched partitions by ``make(their points)``."""
        after = max(self.snapshots(), default=None)
        old = self._partitions(after) if after is not None else {}
        keys = {self._key(r, k if k is not None else "") for r, k in touched}
        inside = [f for k, f in old.items() if k in keys]
        points = self.spark.read.schema(model.POINTS).parquet(*[os.path.join(self.folder, f) for f in inside]) if inside else self.empty()
        self._commit({k: f for k, f in old.items() if k not in keys} | self._stored(make(points)), after)

    def _touched(self, new: DataFrame | None, gone: DataFrame | None) -> set[tuple[str | None, str | None]]:
        """The (repository, kind) pairs of new points, of stored ones with the same ids, and of files that go; a few per repository."""
        out: set[tuple[str | None, str | None]] = set()
        if new is not None:
            out |= {(r.repo, r.kind) for r in new.select("repo", "kind").distinct().collect()}
            stored = self.read({r for r, _ in out})
            out |= {(r.repo, r.kind) for r in stored.join(new.select("point_id"), "point_id", "left_semi").select("repo", "kind").distinct().collect()}
        if gone is not None:
            repos = {r.repo for r in gone.select("repo").distinct().collect()}
            stored = self.read(repos)
            out |= {(r.repo, r.kind) for r in stored.join(gone.select("repo", "file_path"), ["repo", "file_path"], "left_semi").select("repo", "kind").distinct().collect()}
        return out

    def upsert(self, new: DataFrame) -> None:
        self._change(self._touched(new, None), lambda old: changes.upsert(old, new))

    def delete_repo(self, repo: str) -> None:
        """No data is read or written, the repository's folders are named no longer."""
        after = max(self.snapshots(), default=None)
        if after is not None:
            head = self._key(repo)
            self._commit({k: f for k, f in self._partitions(after).items() if not k.startswith(head)}, after)

    def replace_repo(self, repo: str, new: DataFrame) -> None:
        """All points of a repository at once; the other repositories stay as they are."""
        after = max(self.snapshots(), default=None)
        old = self._partitions(after) if after is not None else {}
        head = self._key(repo)
        self._commit({k: f for k, f in old.items() if not k.startswith(head)} | self._stored(changes.upsert(self.empty(), new)), after)

    def delete_files(self, keys: DataFrame) -> None:
        self._change(self._touched(None, keys), lambda old: changes.delete_files(old, keys))

    def apply(self, changed: DataFrame, new: DataFrame) -> None:
        gone = changes.paths_to_delete(changed).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
        self._change(self._touched(new, gone), lambda old: changes.apply_changes(old, changed, new))

    def count(self) -> int:
        return self.read().count()


class StateStore:
    """State of each repository in one JSON file that is replaced as a whole. Missing or broken means empty.

    With a session the file may lie on any file system that Spark knows, else on this machine.
    """

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path, spark

    def read(self) -> dict[str, dict]:
        try:
            if self.spark is not None:
                found = json.loads(Files(self.spark, os.path.dirname(self.path)).read(os.path.basename(self.path)) or "{}")
            else:
                with open(self.path, encoding="utf-8") as f:
                    found = json.load(f)
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            return {}

    def update(self, repo: str, last_commit: str, total_chunks: int, now) -> None:
        state = self.read()
        state[repo] = {"lastCommit": last_commit, "lastIndexed": now.isoformat(), "totalChunks": total_chunks}
        if self.spark is not None:
            Files(self.spark, os.path.dirname(self.path)).write(os.path.basename(self.path), json.dumps(state, indent=2), replace=True)
            return
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        staged = f"{self.path}.{uuid.uuid4().hex}"
        with open(staged, "w", encoding="utf-8") as f:
            json.dump(state, f, indent=2)
        os.replace(staged, self.path)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r, s.get("lastCommit"), s.get("lastIndexed"), s.get("totalChunks")) for r, s in self.read().items()]
        text = spark.createDataFrame(rows, "repo string, last_commit string, last_indexed string, total_chunks bigint")
        return text.withColumn("last_indexed", F.expr("try_to_timestamp(last_indexed)"))
