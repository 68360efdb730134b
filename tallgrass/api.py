"""The engine's five calls and its command line."""

from __future__ import annotations

import argparse
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import paths, text
from tallgrass.model import SEARCHABLE_MEMORY_TYPES, RuntimeConfig, SearchFilters
from tallgrass.operators import changes, chunking, memory, usage, vectors
from tallgrass.session import cut_lineage
from tallgrass.sources import git, logs, models
from tallgrass.sources.store import PointStore, StateStore


class Engine:
    """Reindexing and search over one collection."""

    def __init__(self, spark: SparkSession, config: RuntimeConfig, store: PointStore, state: StateStore, make_embedder=models.HashingEmbedder, reranker=None, log_path: str | None = None) -> None:
        self.spark, self.config, self.store, self.state = spark, config, store, state
        self.make_embedder, self.reranker, self.log_path = make_embedder, reranker, log_path

    # -- checks ---------------------------------------------------------------
    def _check(self, query: str | None, repo: str | None, memory_type: str | None = None) -> None:
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must not be blank")
        if repo is not None and repo not in self.config.repo_paths:
            raise ValueError(f"unknown repository {repo}")
        if memory_type is not None and memory_type not in SEARCHABLE_MEMORY_TYPES:
            raise ValueError(f"memory type must be one of {', '.join(SEARCHABLE_MEMORY_TYPES)}")

    # -- search ---------------------------------------------------------------
    def _retrieve(self, query: str, filters: SearchFilters, limit: int) -> DataFrame:
        n = vectors.candidates_for(limit)
        points = self.store.read()
        vector = models.embed_all(self.make_embedder(), [query])[0]
        fused = vectors.fuse([vectors.sparse_topk(points, query, n, filters), vectors.dense_topk(points, vector, n, filters)], n)
        if self.reranker is None:
            return fused.where(F.col("rank") <= limit)
        rows = points.join(F.broadcast(fused.select("point_id", "rank")), "point_id").orderBy("rank").select("text").collect()  # at most 50
        order = models.rerank(self.reranker, query, [r["text"] or "" for r in rows], limit)
        answer = self.spark.createDataFrame([(i + 1, x) for i, x in enumerate(order)], "rank int, index int")
        return vectors.apply_rerank(fused, answer, limit)

    def search_code(self, query: str, repo: str | None = None, limit: object = 10) -> DataFrame:
        self._check(query, repo)
        hits = self._retrieve(query, SearchFilters(repo=repo, exclude_memory=True), vectors.clamp_limit(limit))
        rows = self.store.read().join(F.broadcast(hits), "point_id")
        return rows.withColumn("block", memory.render_code()).orderBy("rank")

    def search_memory(self, query: str, repo: str | None = None, memory_type: str | None = None, limit: object = 10, now: datetime | None = None) -> DataFrame:
        self._check(query, repo, memory_type)
        now, limit = now or datetime.now(timezone.utc).replace(tzinfo=None), vectors.clamp_limit(limit)
        found = self.spark.range(1).select(text.mentioned_ids(F.lit(query)).alias("ids"), text.is_bare_id(F.lit(query)).alias("bare")).first()
        points = self.store.read()
        pinned_rows = memory.find_by_ids(points, found["ids"], repo).select("point_id", "memory_id", F.row_number().over(_by("id_order", "point_id")).alias("rank")).collect() if found["ids"] else []
        pinned = self.spark.createDataFrame([(r["point_id"], 1.0, r["rank"]) for r in pinned_rows], "point_id string, score double, rank int")
        if found["bare"] and pinned_rows:
            hits = pinned
        else:
            semantic = self._retrieve(query, SearchFilters(repo=repo, kind="memory", memory_type=memory_type), limit)
            hits = memory.pin_merge(pinned, semantic, limit)
        rows = points.join(F.broadcast(hits), "point_id").withColumn("block", memory.render_memory(F.lit(now))).orderBy("rank")
        if self.log_path:
            self._log(query, repo, memory_type, sorted({r["memory_id"] for r in pinned_rows}), rows, now)
        return rows

    def _log(self, query, repo, memory_type, id_hits, rows: DataFrame, now: datetime) -> None:
        hits = [(r["memory_id"] or r["file_path"], r["memory_type"], r["score"]) for r in rows.select("memory_id", "file_path", "memory_type", "score").collect()]
        from tallgrass.model import TELEMETRY

        event = [(now, self.config.collection_name, repo, query, memory_type, bool(id_hits), id_hits, hits)]
        logs.append_log(self.spark.createDataFrame(event, TELEMETRY), self.log_path)

    # -- files ----------------------------------------------------------------
    def get_file(self, repo: str, path: str, start_line: int | None = None, end_line: int | None = None) -> str:
        """Text of a file or of some of its lines; a path that leaves the repository is refused."""
        root = os.path.realpath(self.config.repo_paths[repo])
        full = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([root, full]) != root:
            raise ValueError("the path leaves the repository")
        with open(full, encoding="utf-8", errors="replace") as f:
            body = f.read()
        if start_line is None and end_line is None:
            return body
        lines = body.split("\n")
        first = max(1, start_line if start_line is not None else 1)
        return "\n".join(lines[first - 1 : max(0, min(len(lines), end_line if end_line is not None else len(lines)))])

    # -- ingest ---------------------------------------------------------------
    def _points(self, repo: str, files: DataFrame) -> DataFrame:
        ids = chunking.with_point_ids(chunking.chunk_files(files, self.config.exclude_patterns))
        return models.with_embeddings(ids, self.make_embedder).withColumn("sparse", vectors.sparse_vector(F.col("text")))

    def reindex(self, repo: str | None = None, full: bool = False, now: datetime | None = None) -> dict:
        """Bring the points of one or all repositories up to date.

        Returns ``files_processed, chunks_created, points_upserted, points_deleted`` summed
        over the repositories and ``errors``; an unknown repository, or one that fails, is an
        error and doesn't stop the others.
        """
        now = now or datetime.now(timezone.utc)
        out = {"files_processed": 0, "chunks_created": 0, "points_upserted": 0, "points_deleted": 0, "errors": []}
        if not self.config.repo_paths:
            return out | {"errors": ["no repositories are configured"]}
        self.store.ensure()
        for name in [repo] if repo else list(self.config.repo_paths):
            if name not in self.config.repo_paths:
                out["errors"].append(f"unknown repository {name}")
                continue
            try:
                own = self._reindex(name, full, now)
            except Exception as e:
                out["errors"].append(f"{name}: {e}")
                continue
            for key, value in own.items():
                out[key] += value
        return out

    def _reindex(self, repo: str, full: bool, now: datetime) -> dict:
        root, excludes = self.config.repo_paths[repo], self.config.exclude_patterns
        head, known = git.head_commit(root), self.state.read().get(repo)
        everything = full or not known
        listing = git.list_files(self.spark, root, excludes) if everything else git.changed_files(self.spark, root, known.get("lastCommit"), excludes)
        listing = cut_lineage(listing.withColumn("repo", F.lit(repo)))
        files = git.read_files(self.spark, repo, root, changes.paths_to_upsert(listing), head)
        # Embedding is the costly step, so its result is written once and then counted and stored.
        new = cut_lineage(self._points(repo, files))
        created = new.count()
        if everything:
            # What counts as deleted is what the last run said that there was.
            deleted = int((known or {}).get("totalChunks") or 0)
            self.store.replace_repo(repo, new)
            total = created
        else:
            gone = changes.paths_to_delete(listing).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
            deleted = self.store.read([repo]).join(gone, ["repo", "file_path"], "left_semi").count()
            self.store.apply(listing, new)
            total = max(0, int(known.get("totalChunks") or 0) + created - deleted)
        self.state.update(repo, head, total, now)
        return {"files_processed": listing.count(), "chunks_created": created, "points_upserted": new.select("point_id").distinct().count(), "points_deleted": deleted}

    def usage_report(self, log: DataFrame, learnings: DataFrame | None = None, collection: str | None = None, days: int | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
        """The tables of the usage report: days, summary, top hits, empty queries, dead entries, and verdict lines."""
        return usage.report(log, self.store.read(kind="memory"), learnings, collection, days, now)

    def index_status(self) -> DataFrame:
        repos = self.spark.createDataFrame([(r,) for r in self.config.repo_paths], "repo string")
        return changes.index_status(repos, self.state.frame(self.spark), self.store.read())


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def parse_arguments(argv: list[str], environment=None) -> tuple[RuntimeConfig, argparse.Namespace]:
    """Configuration and command. ``--repo NAME --path FOLDER`` may be given several times; folders must exist.

    What the arguments don't say comes from the environment: ``WORKSPACE_ROOT``,
    ``COLLECTION``, ``STORE``, ``EMBEDDER_DIMENSIONS``.
    """
    env = os.environ if environment is None else environment
    parser = argparse.ArgumentParser(prog="tallgrass")
    parser.add_argument("--workspace", default=env.get("WORKSPACE_ROOT") or ".")
    parser.add_argument("--collection", default=env.get("COLLECTION") or "code_chunks")
    parser.add_argument("--repo", action="append", default=[])
    parser.add_argument("--path", action="append", default=[])
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--store", default=env.get("STORE") or "tallgrass-store")
    parser.add_argument("--dimensions", type=int, default=int(env.get("EMBEDDER_DIMENSIONS") or 64))
    commands = parser.add_subparsers(dest="command", required=True)
    re = commands.add_parser("reindex")
    re.add_argument("--only")
    re.add_argument("--full", action="store_true")
    commands.add_parser("status")
    report = commands.add_parser("report")
    report.add_argument("--log", required=True)
    report.add_argument("--days", type=int)
    report.add_argument("--of")
    report.add_argument("--learnings")
    args = parser.parse_args(argv)
    if len(args.repo) != len(args.path):
        parser.error("every --repo needs its --path")
    for folder in args.path:
        if not os.path.isabs(folder) or not os.path.isdir(folder) or not os.access(folder, os.R_OK):
            parser.error(f"{folder} is no readable absolute folder")
    return RuntimeConfig(args.workspace, args.collection, dict(zip(args.repo, args.path)), args.exclude), args


def main(argv: list[str] | None = None) -> None:
    import sys

    from tallgrass.session import build_session
    from tallgrass.sources import clients

    config, args = parse_arguments(sys.argv[1:] if argv is None else argv)
    spark = build_session()
    store, state = PointStore(spark, args.store, args.dimensions), StateStore(os.path.join(args.store, "state.json"), spark)
    engine = Engine(spark, config, store, state, make_embedder=clients.embedder_of(os.environ, args.dimensions), reranker=clients.reranker_of(os.environ))
    if args.command == "reindex":
        print(engine.reindex(args.only, args.full))
    elif args.command == "report":
        learnings = logs.verdicts_under(spark, args.learnings) if args.learnings else None
        for name, table in engine.usage_report(logs.read_log(spark, args.log), learnings, args.of, args.days, datetime.now()).items():
            print(name)
            table.show(60, truncate=False)
    else:
        engine.index_status().show(truncate=False)


if __name__ == "__main__":
    main()
