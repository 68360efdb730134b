import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallgrass.model import SearchFilters
from tallgrass.operators import changes, chunking, guard, memory, usage, vectors

FILES = "repo string, path string, source string, commit_hash string"
MEMORY = """# Pitfalls

<!--
## PIT-000: template
-->
## PIT-001: Reset form
**When relevant:** forms, save
**Evidence:**
- a/b

* c/d
**Last verified:** 2024-01-05 rechecked

## Plain heading!
text"""


def files(spark, *rows):
    return spark.createDataFrame([("r", p, s, "c") for p, s in rows], FILES)


@pytest.mark.parametrize("n, spans", [(181, [(1, 100), (81, 180), (161, 181)]), (100, [(1, 100)]), (1, [(1, 1)]), (101, [(1, 100), (81, 101)])])
def test_line_windows(spark, n, spans):
    rows = chunking.chunk_by_lines(files(spark, ("a.json", "\n".join("x" for _ in range(n))))).orderBy("chunk_index").collect()
    assert [(r.start_line, r.end_line) for r in rows] == spans
    assert {r.total_chunks for r in rows} == {len(spans)}


def test_windows_cover_every_line(spark):
    for n in (99, 100, 101, 179, 180, 181, 500, 1234):
        rows = spark.range(1).select(F.explode(chunking.line_windows(F.lit(1), F.lit(n))).alias("w")).select("w.*").collect()
        assert set(range(1, n + 1)) == {x for r in rows for x in range(r.start_line, r.end_line + 1)}


def test_empty_and_null_sources(spark):
    got = chunking.chunk_files(files(spark, ("a.json", ""), ("b.json", None), ("c.ts", ""), ("d.ts", " \n"), ("e.py", "x"), (None, "x"), ("node_modules/a.ts", "let a")))
    assert [(r.file_path, r.text) for r in got.collect()] == [("r/a.json", "// a.json\n")]


def test_range_dedup_and_split(spark):
    r = "array<struct<start_line:int,end_line:int,symbol_name:string,symbol_type:string>>"
    df = spark.createDataFrame([([(1, 5, None, None), (1, 5, "f", "function"), (2, 4, "g", None)],)], f"x {r}")
    assert [tuple(x)[:3] for x in df.select(chunking.dedup_ranges(F.col("x")).alias("y")).first().y] == [(1, 5, "f"), (2, 4, "g")]
    df = spark.createDataFrame([([(10, 300, "f", "function")],)], f"x {r}")
    assert [tuple(x)[:3] for x in df.select(chunking.split_ranges(F.col("x")).alias("y")).first().y] == [(10, 209, "f"), (190, 300, None)]


def test_memory_sections(spark):
    rows = chunking.chunk_memory(files(spark, ("openspec/memory/pitfalls.md", MEMORY))).orderBy("chunk_index").collect()
    got = [(r.memory_id, r.title, r.start_line, r.end_line, r.when_relevant, r.evidence, r.last_verified, r.total_chunks, r.memory_type) for r in rows]
    assert got == [
        ("PIT-001", "Reset form", 6, 13, "forms, save", ["a/b", "c/d"], "2024-01-05", 2, "pitfall"),
        ("plain-heading", "Plain heading!", 14, 15, None, None, None, 2, "pitfall"),
    ]
    assert rows[0].text.startswith("## PIT-001")


def test_learnings_and_skills(spark):
    rows = chunking.chunk_memory(
        files(spark, ("changes/Add X/learnings.md", "text\n# Head\n## Sub"), ("q/learnings.md", "no heading"), ("skills/deploy/SKILL.md", "---\nname: deploy\ndescription: how\n---\nbody"), ("x/skill.md", "body"))
    ).collect()
    got = {r.file_path: (r.memory_id, r.title, r.total_chunks, r.when_relevant, r.memory_type) for r in rows}
    assert got == {
        "r/changes/Add X/learnings.md": ("add-x", "Head", 0, None, "learning"),
        "r/q/learnings.md": ("q", "Learnings — q", 0, None, "learning"),
        "r/skills/deploy/SKILL.md": ("deploy", "deploy", 0, "how", "skill"),
        "r/x/skill.md": ("skill-md", "skill.md", 0, None, "skill"),
    }


def test_script_chunks(spark):
    ts = "import a from 'a';\nexport const F = () => {\n  return 1;\n};\nclass C {\n  m() {\n  }\n}\nconst x = 1;\n"
    rows = chunking.chunk_scripts(files(spark, ("a.ts", ts))).orderBy("chunk_index").collect()
    assert [(r.start_line, r.end_line, r.symbol_name, r.symbol_type) for r in rows] == [(2, 4, "F", "component"), (5, 8, "C", "class"), (6, 7, "m", "method")]
    assert rows[0].text.split("\n")[:3] == ["// a.ts", "// component: F (lines 2-4)", "export const F = () => {"]
    rows = chunking.chunk_scripts(files(spark, ("a.js", "x = 1\n"))).collect()
    assert [(r.start_line, r.end_line, r.symbol_name) for r in rows] == [(1, 2, None)]


def test_point_ids_are_unique(spark):
    got = chunking.with_point_ids(chunking.chunk_files(files(spark, ("a.json", "x\n" * 400), ("b.ts", "function a() {}\nfunction b() {}"))))
    assert got.count() == got.select("point_id").distinct().count() == 7


def points(spark):
    docs = spark.createDataFrame([("p1", "alpha beta", "x", None), ("p2", "beta gamma", "x", "memory"), ("p3", "delta", "y", "code")], "point_id string, text string, repo string, kind string")
    sparse = vectors.sparse_vectors(docs, "point_id")
    dense = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.6, 0.8]), ("p3", [0.0, 0.0]), ("p4", None), ("p5", [1.0])], "point_id string, dense array<float>")
    return docs.join(sparse, "point_id", "full").join(dense, "point_id", "full").withColumn("memory_type", F.lit(None).cast("string"))


def test_sparse_topk(spark):
    got = vectors.sparse_topk(points(spark), "beta", 10).orderBy("rank").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    weight = math.log1p(2)  # a word is its own part
    assert [(r.point_id, round(r.score, 9)) for r in got] == [("p1", round(weight * weight * idf, 9)), ("p2", round(weight * weight * idf, 9))]
    assert vectors.sparse_topk(points(spark), "nothing", 10).count() == 0
    assert vectors.sparse_topk(points(spark), "! ?", 10).count() == 0


def test_exclusion_is_null_safe(spark):
    got = vectors.sparse_topk(points(spark), "beta", 10, SearchFilters(exclude_memory=True)).collect()
    assert [r.point_id for r in got] == ["p1"]


def test_dense_topk_skips_unusable_vectors(spark):
    got = vectors.dense_topk(points(spark), [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r.point_id, round(r.score, 6)) for r in got] == [("p1", 1.0), ("p2", 0.6)]
    assert vectors.dense_topk(points(spark), [0.0, 0.0], 10).count() == 0


def test_terms_are_cut_by_frequency_then_place(spark):
    text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)) + " wzz wzz"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = vectors.term_postings(docs, "doc_id")
    assert got.count() == 512
    assert got.agg(F.max("tf")).first()[0] == 4


def test_fusion_bounds(spark):
    a = spark.createDataFrame([("a", 9.0, 1), ("b", 8.0, 2)], "point_id string, score double, rank int")
    b = spark.createDataFrame([("a", 1.0, 1), ("c", 0.5, 2)], "point_id string, score double, rank int")
    got = vectors.fuse([a, b], 10).orderBy("rank").collect()
    assert [r.point_id for r in got] == ["a", "b", "c"]
    assert got[0].score == pytest.approx(2 / 61) and all(r.score <= 2 / 61 + 1e-12 for r in got)


@pytest.mark.parametrize("limit, value", [(0, 1), (7, 7), (7.9, 7), (99, 50), ("x", 10), (None, 10), (True, 10), (float("nan"), 10)])
def test_deviation_5_integer_limits(limit, value):
    assert vectors.clamp_limit(limit) == value


def test_deviation_6_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "point_id string, score double")
    assert [r.point_id for r in vectors.ranked(df, "point_id", 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_rerank_order(spark):
    answer = spark.createDataFrame([(0, 0, 0.1, None), (1, 2, 0.9, None), (2, None, 5.0, None), (3, 1, None, 0.9)], "input_pos int, index int, relevance_score double, score double")
    assert [r["index"] for r in vectors.rerank_order(answer).orderBy("rank").collect()] == [2, 1, 0]
    candidates = spark.createDataFrame([("a", 3.0, 1), ("b", 2.0, 2)], "point_id string, score double, rank int")
    got = vectors.apply_rerank(candidates, vectors.rerank_order(answer), 5).orderBy("rank").collect()
    assert [(r.point_id, r.score) for r in got] == [("b", 2.0), ("a", 3.0)]


def test_pin_merge(spark):
    pinned = spark.createDataFrame([("p1", 1.0, 1)], "point_id string, score double, rank int")
    semantic = spark.createDataFrame([("s1", 0.9, 1), ("p1", 0.8, 2), ("s2", 0.7, 3)], "point_id string, score double, rank int")
    assert [r.point_id for r in memory.pin_merge(pinned, semantic, 2).orderBy("rank").collect()] == ["p1", "s1"]


def test_find_by_ids_keeps_five(spark):
    rows = [(f"p{i}", "X-1", "memory", "r") for i in range(9)] + [("q", "x-1", "memory", "r"), ("z", "X-1", "code", "r")]
    df = spark.createDataFrame(rows, "point_id string, memory_id string, kind string, repo string")
    assert sorted(r.point_id for r in memory.find_by_ids(df, ["X-1"]).collect()) == ["p0", "p1", "p2", "p3", "p4"]
    assert memory.find_by_ids(df, []).count() == 0


LINES = ["M\ta.ts", "R100\told.ts\tnew.ts", "R090\tsrc/a.ts\tdist/a.ts", "C100\ta.ts\tb.ts", "", "A\tnode_modules/x.ts"]


def test_parse_status_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = {tuple(r) for r in changes.parse_status_lines(df, parity=True).collect()}
    assert got == {("a.ts", "M", None), ("new.ts", "R", "old.ts"), ("a.ts", "C", None)}


def test_deviation_3_rename_onto_a_skipped_path_deletes(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    assert ("src/a.ts", "D", None) in {tuple(r) for r in changes.parse_status_lines(df).collect()}


def _state(spark):
    old = spark.createDataFrame([("1", "r", "r/a"), ("2", "r", "r/b"), ("3", "r", "r/c"), ("4", "s", "s/a")], "point_id string, repo string, file_path string")
    changed = spark.createDataFrame([("r", "a", "M", None), ("r", "b", "D", None), ("r", "d", "R", "c"), ("r", "e", "C", None)], "repo string, path string, status string, old_path string")
    new = spark.createDataFrame([("1", "r", "r/a"), ("5", "r", "r/d"), ("5", "r", "r/d")], "point_id string, repo string, file_path string")
    return old, changed, new


def test_apply_changes(spark):
    old, changed, new = _state(spark)
    assert sorted(r.point_id for r in changes.apply_changes(old, changed, new).collect()) == ["1", "4", "5"]
    counters = changes.change_counters(old, changed, new.distinct()).collect()
    assert [(r.repo, r.files_processed, r.points_deleted, r.points_upserted) for r in counters] == [("r", 4, 3, 2)]
    state = spark.createDataFrame([("r", 1), ("s", 7)], "repo string, total_chunks bigint")
    totals = changes.next_totals(state, changes.change_counters(old, changed, new.distinct())).collect()
    assert {(r.repo, r.total_chunks) for r in totals} == {("r", 0), ("s", 7)}


def test_rename_is_delete_and_add(spark):
    old, _, new = _state(spark)
    schema = "repo string, path string, status string, old_path string"
    renamed = spark.createDataFrame([("r", "d", "R", "c")], schema)
    both = spark.createDataFrame([("r", "c", "D", None), ("r", "d", "A", None)], schema)
    added = new.where("point_id = '5'")
    assert sorted(map(tuple, changes.apply_changes(old, renamed, added).collect())) == sorted(map(tuple, changes.apply_changes(old, both, added).collect()))


def test_delete_by_repo_and_path(spark):
    old, _, _ = _state(spark)
    assert [r.point_id for r in changes.delete_repos(old, ["r"]).collect()] == ["4"]
    assert changes.delete_repos(old, []).count() == 4
    keys = spark.createDataFrame([("r/a",)], "file_path string")
    assert sorted(r.point_id for r in changes.delete_paths(old, keys).collect()) == ["2", "3", "4"]


LOG = "event_id bigint, ts timestamp, collection string, query string, hits array<struct<id:string,type:string,score:double>>"


def log(spark):
    t = lambda d: datetime(2025, 1, d)
    return spark.createDataFrame(
        [
            (1, t(1), "c", "q", [("A", "x", 1.0), ("B", None, 0.5), (None, "z", 0.1)]),
            (2, t(1), "c", "e", []),
            (3, t(2), "d", "e", None),
            (4, t(3), "c", "q", [("A", "y", 1.0), ("", "y", 1.0)]),
        ],
        LOG,
    )


def test_usage(spark):
    l = log(spark)
    assert {(r.day, r.calls, r.bar) for r in usage.calls_by_day(l).collect()} == {("2025-01-01", 2, "██"), ("2025-01-02", 1, "█"), ("2025-01-03", 1, "█")}
    assert tuple(usage.usage_summary(l).first()) == (4, 3, "2025-01-01", "2025-01-03")
    assert [tuple(r) for r in usage.top_hits(l).collect()] == [("A", 2, "x"), ("B", 1, None)]
    assert [(r.query, r.n) for r in usage.empty_query_report(l).collect()] == [("e", 2)]
    assert usage.select_events(l, "c", 2, datetime(2025, 1, 4)).count() == 1
    with pytest.raises(ValueError):
        usage.select_events(l, days=3)


def test_usage_of_an_empty_log(spark):
    empty = log(spark).limit(0)
    assert tuple(usage.usage_summary(empty).first()) == (0, 0, None, None)
    assert usage.top_hits(empty).count() == 0


def test_dead_entries(spark):
    p = spark.createDataFrame([("memory", "A", "x"), ("memory", "Z", "y"), ("memory", None, "y"), ("code", "Q", "y"), (None, "W", "y")], "kind string, memory_id string, memory_type string")
    assert [tuple(r) for r in usage.dead_entries(p, log(spark)).collect()] == [("Z", "y")]
    assert tuple(usage.dead_summary(p, log(spark)).first()) == (1, 2, False)


HOOKS = "call_id string, phase string, tool string, command string, output string, ts timestamp"


def test_guard(spark):
    t = datetime(2025, 1, 1)
    move = 'mv -f "./openspec/changes/add-x/" openspec/changes/archive/2025-add-x'
    rows = [
        ("1", "before", "bash", move, None, t), ("1", "after", "bash", None, "done", t), ("2", "before", "bash", "openspec new  change y", None, t),
        ("2", "after", "bash", None, "", t), ("3", "before", "edit", move, None, t), ("4", "before", "bash", "openspec instructions apply", None, t), ("5", "after", "bash", None, "x", t),
    ]
    events = spark.createDataFrame(rows, HOOKS)
    calls = guard.correlate(events)
    assert sorted(r.call_id for r in calls.collect()) == ["1", "2"]
    before = {r.call_id: r.output for r in calls.collect()}
    counts = spark.createDataFrame([("a", 40), ("b", 30)], "repo string, entries bigint")
    for entries in (70, counts):
        got = {r.call_id: r for r in guard.annotate(calls, entries).collect()}
        assert {k: r.note for k, r in got.items()} == {"1": guard.REVIEW.format(70), "2": guard.BEFORE_WRITING}
        assert all(r.output == before[k] + r.note for k, r in got.items())
    assert {r.call_id: r.note for r in guard.annotate(calls, 69).collect()} == {"1": None, "2": guard.BEFORE_WRITING}
    assert guard.annotate(calls, counts.limit(0)).where("call_id = '1'").first().note is None
    folders = spark.createDataFrame([("add-x", False), ("other", True)], "change string, has_learnings boolean")
    assert [tuple(r) for r in guard.blocked(events, folders).collect()] == [("1", "add-x")]
    done = spark.createDataFrame([("add-x", True)], "change string, has_learnings boolean")
    assert guard.blocked(events, done).count() == 0
    assert guard.blocked(events, done.limit(0)).count() == 0


def test_stored_postings(spark, tmp_path):
    texts = [(f"p{i}", f"alpha beta{i % 3} gamma {'delta ' * (i % 5)}", "r" if i % 2 else "q", "code", None) for i in range(60)] + [("none", None, "r", "code", None), ("empty", "", "r", "code", None)]
    points = spark.createDataFrame(texts, "point_id string, text string, repo string, kind string, memory_type string").withColumn("sparse", vectors.sparse_vector(F.col("text")))
    assert points.where("sparse is null").count() == 2
    folder = str(tmp_path / "postings")
    vectors.write_postings(points, folder, parts=4)
    for query in ("delta beta1", "unheard", "alpha"):
        for filters in (SearchFilters(), SearchFilters(repo="r")):
            want = [(r.point_id, round(r.score, 9), r["rank"]) for r in vectors.sparse_topk(points, query, 7, filters).collect()]
            assert [(r.point_id, round(r.score, 9), r["rank"]) for r in vectors.stored_topk(spark, folder, query, 7, filters, parts=4).collect()] == want
    plan = vectors.stored_topk(spark, folder, "delta", 7, parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters" in plan


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame([("a", "x1 y2 readAlpha")], "k string, text string")
    assert "Exchange" not in vectors.term_postings(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in vectors.sparse_vectors(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_clamped(spark):
    values = [None, float("nan"), -3.0, 0.0, 1.9, 10.0, 50.0, 51.0]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(vectors.clamped(F.col("x")).alias("n"))
    assert [r.n for r in df.collect()] == [vectors.clamp_limit(x) for x in values]
