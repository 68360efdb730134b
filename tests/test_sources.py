import json
import os
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallgrass import model
from tallgrass.api import Engine, parse_arguments
from tallgrass.model import RuntimeConfig
from tallgrass.sources import clients, git, logs, models
from tallgrass.sources.store import Conflict, DimensionMismatch, PointStore, StateStore
from tallgrass.streaming import live

NOW = datetime(2025, 5, 1)


def run(folder, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t.invalid", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t.invalid"}
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env)


def commit(folder, files, message="x"):
    for name, body in files.items():
        path = folder / name
        if body is None:
            path.unlink()
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    run(folder, "add", "-A")
    run(folder, "commit", "-qm", message)


@pytest.fixture
def repo(tmp_path):
    folder = tmp_path / "repo"
    folder.mkdir()
    run(folder, "init", "-q")
    commit(
        folder,
        {
            "src/a.ts": "export function readAlpha() {\n  return 1;\n}\n",
            "src/b.ts": "export function writeBeta() {\n  return 2;\n}\n",
            "openspec/memory/pitfalls.md": "## PIT-1: Alpha form\n**Last verified:** 2025-04-30\nalpha resets\n",
            "dist/x.js": "var a",
        },
    )
    return folder


def points_of(engine):
    return sorted((r.file_path, r.chunk_index) for r in engine.store.read().collect())


def engine_of(spark, repo, tmp_path, **more):
    return Engine(spark, RuntimeConfig(repo_paths={"r": str(repo)}), PointStore(spark, str(tmp_path / "store"), 64), StateStore(str(tmp_path / "state.json")), **more)


def test_incremental_equals_full(spark, repo, tmp_path):
    engine = engine_of(spark, repo, tmp_path)
    first = engine.reindex(now=NOW)
    assert first == {"files_processed": 3, "chunks_created": 3, "points_upserted": 3, "points_deleted": 0, "errors": []}
    run(repo, "mv", "src/b.ts", "src/c.ts")
    commit(repo, {"src/a.ts": "export function readAlpha() {\n  return 3;\n}\nfunction more() {}\n", "src/d.json": "{}"})
    # a.ts and b.ts go, a.ts twice, c.ts and d.json come.
    assert engine.reindex(now=NOW) == {"files_processed": 3, "chunks_created": 4, "points_upserted": 4, "points_deleted": 2, "errors": []}
    incremental = points_of(engine)
    assert engine.reindex("q", now=NOW) == {"files_processed": 0, "chunks_created": 0, "points_upserted": 0, "points_deleted": 0, "errors": ["unknown repository q"]}
    other = engine_of(spark, repo, tmp_path / "other")
    other.reindex(full=True, now=NOW)
    assert incremental == points_of(other) == [("r/openspec/memory/pitfalls.md", 0), ("r/src/a.ts", 0), ("r/src/a.ts", 1), ("r/src/c.ts", 0), ("r/src/d.json", 0)]
    status = {r.repo: (r.status, r.total_chunks, r.stored_points) for r in engine.index_status().collect()}
    assert status == {"r": ("indexed", 5, 5)}


def test_a_failing_repository_does_not_stop_the_others(spark, repo, tmp_path):
    engine = engine_of(spark, repo, tmp_path)
    engine.config.repo_paths = {"gone": str(tmp_path / "nowhere"), "r": str(repo)}
    done = engine.reindex(now=NOW)
    assert done["files_processed"] == 3 and len(done["errors"]) == 1 and done["errors"][0].startswith("gone: ")
    assert engine.reindex(full=True, now=NOW)["points_deleted"] == 3  # what the state said
    engine.config.repo_paths = {}
    assert engine.reindex()["errors"] == ["no repositories are configured"]


def test_usage_report(spark, repo, tmp_path):
    log = str(tmp_path / "log")
    engine = engine_of(spark, repo, tmp_path, log_path=log)
    engine.reindex(now=NOW)
    engine.search_memory("pit-1", now=NOW).collect()
    engine.search_memory("zzz", now=NOW).collect()
    folder = tmp_path / "x" / "openspec" / "changes" / "c1"
    folder.mkdir(parents=True)
    (folder / "learnings.md").write_text("Memory impact: none\n")
    report = engine.usage_report(logs.read_log(spark, log), logs.verdicts_under(spark, str(tmp_path / "x")))
    assert report["summary"].first().calls == 2 and report["days"].count() == 1
    assert report["top hits"].first()["id"] == "PIT-1" and report["verdicts"].first()[0] == 1 and report["verdict lines"].first().change == "c1"
    assert report["dead"].first().indexed == 1 and report["dead entries"].count() == report["dead"].first().dead


def test_deviation_4_full_listing_removes_vanished_files(spark, repo, tmp_path):
    engine = engine_of(spark, repo, tmp_path)
    engine.reindex(now=NOW)
    commit(repo, {"src/b.ts": None})
    engine.reindex(full=True, now=NOW)
    assert ("r/src/b.ts", 0) not in points_of(engine)


def test_search(spark, repo, tmp_path):
    log = str(tmp_path / "log")
    engine = engine_of(spark, repo, tmp_path, log_path=log)
    engine.reindex(now=NOW)
    code = engine.search_code("readAlpha").collect()
    assert code[0].file_path == "r/src/a.ts" and code[0].block.startswith("File: r/src/a.ts\nRepository: r\nLines: 1-3\nSymbol: readAlpha (function)")
    assert all(r.kind != "memory" for r in code)
    hits = engine.search_memory("pit-1", now=NOW).collect()
    assert [(r.memory_id, r.score) for r in hits] == [("PIT-1", 1.0)]
    assert engine.search_memory("alpha", now=NOW).first().memory_id == "PIT-1"
    events = logs.read_log(spark, log).orderBy("query").collect()
    assert [(e.query, e.via_id, [h.id for h in e.hits]) for e in events] == [("alpha", False, ["PIT-1"]), ("pit-1", True, ["PIT-1"])]
    for bad in (lambda: engine.search_code(" "), lambda: engine.search_code("x", repo="q"), lambda: engine.search_memory("x", memory_type="note")):
        with pytest.raises(ValueError):
            bad()


def test_rerank_changes_order_only(spark, repo, tmp_path):
    class Backwards:
        def rerank(self, query, texts, top_n):
            return {"results": [{"index": i, "score": i} for i in range(len(texts))]}

    engine = engine_of(spark, repo, tmp_path, reranker=Backwards())
    engine.reindex(now=NOW)
    plain = [r.point_id for r in engine_of(spark, repo, tmp_path).search_code("function return").collect()]
    assert [r.point_id for r in engine.search_code("function return").collect()] == plain[::-1]


def test_get_file(spark, repo, tmp_path):
    engine = engine_of(spark, repo, tmp_path)
    assert engine.get_file("r", "src/a.ts", 2, 2) == "  return 1;"
    assert engine.get_file("r", "src/a.ts", 3, 2) == ""
    with pytest.raises(ValueError):
        engine.get_file("r", "../outside")


def test_deviation_7_paths_are_no_shell_text(spark, repo):
    assert git.changed_files(spark, str(repo), "HEAD; touch /tmp/never").count() == 3  # falls back to the full listing
    assert not os.path.exists("/tmp/never")


def test_unreadable_files_have_no_row(spark, repo):
    listing = spark.createDataFrame([("src/a.ts",), ("missing.ts",)], "path string")
    assert [r.path for r in git.read_files(spark, "r", str(repo), listing, "c").collect()] == ["src/a.ts"]


def point(spark, *ids, size=4):
    rows = [(i,) for i in ids]
    df = spark.createDataFrame(rows, "point_id string")
    for field in spark.createDataFrame([], model.POINTS).schema.fields[1:]:
        df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.withColumn("repo", F.lit("r")).withColumn("kind", F.lit("code")).withColumn("dense", F.array_repeat(F.lit(0.5).cast("float"), size))


def test_store(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    assert store.count() == 0 and store.ensure() and not store.ensure()
    store.upsert(point(spark, "a", "b"))
    store.upsert(point(spark, "b", "c"))
    assert sorted(r.point_id for r in store.read().collect()) == ["a", "b", "c"]
    store.delete_repo("r")
    assert store.count() == 0


def folders(store):
    return set(store.files.names("data"))


def test_a_change_touches_only_its_partitions(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    notes = point(spark, "n").withColumn("kind", F.lit("memory")).withColumn("file_path", F.lit("r/n.md"))
    store.write(point(spark, "a").withColumn("file_path", F.lit("r/a.ts")).unionByName(notes).unionByName(point(spark, "q").withColumn("repo", F.lit("q/é"))))
    before = store._partitions()
    changed = spark.createDataFrame([("r", "a.ts", "M", None)], "repo string, path string, status string, old_path string")
    store.apply(changed, point(spark, "b").withColumn("file_path", F.lit("r/a.ts")))
    after = store._partitions()
    assert {k for k in before if before[k] != after.get(k)} == {"_repo=r/_kind=code"}
    assert sorted(r.point_id for r in store.read().collect()) == ["b", "n", "q"]
    assert [r.point_id for r in store.read(["r"], "memory").collect()] == ["n"] and [r.point_id for r in store.read(["q/é"]).collect()] == ["q"]
    data = folders(store)
    store.delete_repo("r")
    assert folders(store) == data and [r.point_id for r in store.read().collect()] == ["q"]


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    store.upsert(point(spark, "a"))
    reading = store.read()
    store.upsert(point(spark, "b"))
    store.delete_repo("r")
    assert [r.point_id for r in reading.collect()] == ["a"] and store.count() == 0
    store.expire(keep=1)
    assert len(store.snapshots()) == 1 and folders(store) == set()


@pytest.mark.parametrize("step", ["_stored", "_commit"])
def test_a_write_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    store.upsert(point(spark, "a"))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(PointStore, step, die)
        store.upsert(point(spark, "b"))
    fresh = PointStore(spark, str(tmp_path / "s"), 4)
    assert not fresh.ensure() and [r.point_id for r in fresh.read().collect()] == ["a"]
    fresh.upsert(point(spark, "b"))
    assert fresh.count() == 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    number = max(store.snapshots())
    store._commit({"x": "data/1"}, number)
    with pytest.raises(Conflict):
        store._commit({"x": "data/2"}, number)
    assert store._partitions() == {"x": "data/1"}


def test_deviation_2_no_implicit_drop(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    store.upsert(point(spark, "a"))
    other = PointStore(spark, str(tmp_path / "s"), 8)
    with pytest.raises(DimensionMismatch):
        other.ensure()
    assert store.count() == 1
    assert other.ensure(allow_recreate=True) and store.count() == 0


def test_deviation_1_a_failed_write_leaves_the_old_state(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), 4)
    store.ensure()
    store.upsert(point(spark, "a"))
    broken = point(spark, "b").withColumn("text", F.expr("raise_error('no embedding')"))
    with pytest.raises(Exception, match="no embedding"):
        store.upsert(broken)
    assert [r.point_id for r in store.read().collect()] == ["a"]


@pytest.mark.parametrize("shared", [False, True])
def test_state_store(spark, tmp_path, shared):
    path = tmp_path / "x" / "state.json"
    state = StateStore(str(path), spark if shared else None)
    assert state.read() == {}
    state.update("r", "c", 3, NOW)
    assert state.read()["r"]["totalChunks"] == 3
    path.write_text("{broken")
    assert state.read() == {}


def test_log_drops_malformed_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    good = {"ts": "2025-01-01T00:00:00Z", "collection": "c", "query": "q", "viaId": True, "idHits": ["A"], "hits": [{"id": "A", "type": "x", "score": 1.0}]}
    path.write_text(json.dumps(good) + "\n\n{broken\n")
    rows = logs.read_log(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0].via_id and rows[0].hits[0].id == "A"


def test_verdicts(spark, tmp_path):
    root = tmp_path / "openspec" / "changes"
    for folder, name in ((root / "archive" / "b", "learnings.md"), (root / "c", "Learnings.md"), (tmp_path / "docs" / "d", "learnings.md"), (root / "e", "other.md")):
        folder.mkdir(parents=True)
        (folder / name).write_text("x\n  Memory Impact: yes \n")
    assert [tuple(r) for r in logs.verdicts_under(spark, str(tmp_path)).collect()] == [("b", "Memory Impact: yes")]


class Flaky:
    def __init__(self, *failures):
        self.failures, self.calls = list(failures), 0

    def embed(self, texts):
        self.calls += 1
        if self.failures:
            raise self.failures.pop(0)
        return [[float(len(t))] for t in texts]


def test_embedding_retries_and_bisection():
    waits = []
    busy = models.ServiceError("busy", 429)
    assert models.embed_all(Flaky(busy, busy), ["a", "bb"], wait=waits.append) == [[1.0], [2.0]]
    assert waits == [1.0, 2.0]
    with pytest.raises(models.ServiceError):
        models.embed_all(Flaky(models.ServiceError("no", 400)), ["a"], wait=waits.append)
    long = models.ServiceError("long", 400, too_long=True)
    assert models.embed_all(Flaky(long, long), ["a" * 9000, "b"], wait=waits.append) == [[8000.0], [1.0]]


def test_all_attempts_share_their_time():
    now = [0.0]

    def wait(seconds):
        now[0] += seconds

    seen = []

    def busy(left):
        seen.append(left)
        now[0] += 10
        raise models.ServiceError("busy", 429)

    with pytest.raises(models.ServiceError, match="over"):
        models.call_with_retry(busy, wait, seconds=30, clock=lambda: now[0])
    assert seen == [30, 19, 7] and now[0] <= 37


@pytest.fixture
def service():
    """A local server that answers as the services do."""
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            server.seen.append((self.path, self.headers["Authorization"], body))
            status, answer = server.answers.pop(0) if server.answers else (200, None)
            if answer is None and "input" in body:
                answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif answer is None:
                answer = {"results": [{"index": i, "relevance_score": i} for i in range(len(body["documents"]))]}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.seen, server.answers = [], []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_http_clients(service):
    url = f"http://127.0.0.1:{service.server_port}"
    env = {"EMBEDDER_API_KEY": "k", "EMBEDDER_URL": url + "/v1", "EMBEDDER_MODEL": "m", "EMBEDDER_BATCH_SIZE": "2", "RERANKER_PROVIDER": "cohere", "RERANKER_API_KEY": "r", "RERANKER_URL": url + "/rerank"}
    embedder, reranker, waits = clients.embedder_of(env, 64)(), clients.reranker_of(env), []
    service.answers[:] = [(429, {}), (503, {})]
    assert models.embed_all(embedder, ["a", "bb", "ccc"], embedder.batch, waits.append) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    assert waits == [1.0, 2.0] and service.seen[-1] == ("/v1/embeddings", "Bearer k", {"model": "m", "input": ["ccc"]})
    service.answers[:] = [(400, {"error": "maximum context length is 8192"}), (400, {"error": "maximum context length is 8192"})]
    assert models.embed_all(embedder, ["x" * 9000, "y"], 2, waits.append) == [[8000.0, 1.0], [1.0, 1.0]]
    service.answers[:] = [(400, {"error": "no"})]
    with pytest.raises(models.ServiceError):
        embedder.embed(["a"])
    assert models.rerank(reranker, "q", ["a", "b", "c"], 2, waits.append) == [2, 1]
    assert service.seen[-1][1:] == ("Bearer r", {"model": "rerank-english-v3.0", "query": "q", "documents": ["a", "b", "c"], "top_n": 2})
    service.answers[:] = [(500, {})]
    assert models.rerank(reranker, "q", ["a", "b", "c"], 2, waits.append) == [0, 1]
    assert isinstance(clients.embedder_of({}, 8)(), models.HashingEmbedder) and clients.reranker_of({"RERANKER_PROVIDER": "cohere"}) is None and clients.reranker_of({"RERANKER_PROVIDER": "other", "RERANKER_API_KEY": "x"}) is None


def test_rerank_answers():
    answer = {"results": [{"index": 0, "relevance_score": 0.1}, {"index": 2, "relevance_score": 0.9}, {"index": "x"}, {"index": 1, "score": 0.9}]}
    assert models.parse_rerank(answer) == [2, 1, 0]
    assert models.parse_rerank({"data": []}) == []
    assert models.parse_rerank({"results": None, "data": [{"index": 1}, {"index": 0, "score": 2}]}) == [0, 1]
    assert models.parse_rerank("x") is None

    class Down:
        def rerank(self, *_):
            raise models.ServiceError("down", 500)

    assert models.rerank(Down(), "q", ["a", "b", "c"], 2) == [0, 1]
    assert models.rerank(None, "q", [], 2) == []


def test_embeddings_in_tasks(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "point_id string, text string")
    rows = {r.point_id: r.dense for r in models.with_embeddings(df, lambda: models.HashingEmbedder(8)).collect()}
    assert len(rows["a"]) == 8 and rows["b"] is None


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps({"ts": f"2025-01-0{d}T00:00:00Z", "query": "q", "hits": h}) for d, h in ((1, [{"id": "A"}]), (1, []), (2, [{"id": "A"}, {"id": "B"}]))]
    (source / "a.json").write_text("\n".join(lines))
    log = logs.stream_log(spark, str(source))
    for name, frame in (("calls", live.windowed_calls(log)), ("hits", live.windowed_hits(log))):
        frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.calls, r.empty) for r in spark.table("calls").collect()) == [(1, 0), (2, 1)]
    assert sorted((r.id, r.n) for r in spark.table("hits").collect()) == [("A", 1), ("A", 1), ("B", 1)]


def test_late_rows_are_counted(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, day in enumerate(("13", "14", "01")):  # one batch each, in this order
        (source / f"{i}.json").write_text(json.dumps({"ts": f"2025-01-{day}T12:00:00Z", "hits": [{"id": "A"}]}))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    log = spark.readStream.schema("ts timestamp, hits array<struct<id: string>>").option("maxFilesPerTrigger", 1).json(str(source))
    for name, frame in (("late_calls", live.windowed_calls(log)), ("late_hits", live.windowed_hits(log))):
        frame.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 3


def test_streamed_pairs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("1", "before", "bash", "ls", None, "2025-01-01 00:00:00"), ("1", "after", "bash", None, "ok", "2025-01-01 00:00:05"), ("2", "before", "bash", "x", None, "2025-01-01 00:00:00")]
    spark.createDataFrame(rows, "call_id string, phase string, tool string, command string, output string, ts string").coalesce(1).write.mode("overwrite").json(str(source))
    events = spark.readStream.schema(model.HOOKS).json(str(source))
    live.paired_calls(events).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.call_id, r.command, r.output) for r in spark.table("pairs").collect()] == [("1", "ls", "ok")]


def test_ingest_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "A", None)], model.CHANGES).write.json(str(source))
    seen = []
    changes = spark.readStream.schema(model.CHANGES).json(str(source))
    live.ingest_changes(changes, lambda df: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r.path for r in seen] == ["a"]


def test_arguments(tmp_path):
    config, args = parse_arguments(["--repo", "r", "--path", str(tmp_path), "--exclude", "*.css", "reindex", "--full"])
    assert config.repo_paths == {"r": str(tmp_path)} and config.exclude_patterns == ["*.css"] and args.full
    named, own = parse_arguments(["status"], {"WORKSPACE_ROOT": "/w", "COLLECTION": "c", "STORE": "/s", "EMBEDDER_DIMENSIONS": "8"})
    assert (named.workspace_root, named.collection_name, own.store, own.dimensions) == ("/w", "c", "/s", 8)
    assert parse_arguments(["--collection", "d", "status"], {"COLLECTION": "c"})[0].collection_name == "d"
    with pytest.raises(SystemExit):
        parse_arguments(["--repo", "r", "reindex"])
    with pytest.raises(SystemExit):
        parse_arguments(["--repo", "r", "--path", "relative", "reindex"])


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:00:01")], "event_id long, ts string").coalesce(1).write.json(str(source))
    log = spark.readStream.schema("event_id long, ts timestamp").json(str(source))
    live.deduplicated(log).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]


def test_checkpoint_folder(monkeypatch):
    from tallgrass.session import checkpoint_dir

    class Context:
        def __init__(self, master, current=None):
            self.master, self.current = master, current

        def getCheckpointDir(self):
            return self.current

        def setCheckpointDir(self, folder):
            self.current = folder

    class Session:
        def __init__(self, context, **conf):
            self.sparkContext, self.conf = context, conf

    assert checkpoint_dir(Session(Context("spark://x:7077", "shared"))) == "shared"
    assert checkpoint_dir(Session(Context("spark://x:7077"), **{"spark.checkpoint.dir": "named"})) == "named"
    assert "tallgrass" in checkpoint_dir(Session(Context("local[2]")))
    with pytest.raises(ValueError):
        checkpoint_dir(Session(Context("local-cluster[2,1,1024]")))
