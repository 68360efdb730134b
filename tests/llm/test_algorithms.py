"""Problems 1, 4, 6, 7, 8 and 9: against brute force, and on odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import distinctive, frequency, leakage, neighbours, packing, splitting

SPARSE = "point_id string, sparse struct<indices:array<bigint>,values:array<double>>, term string, score double, _t int"


# -- 1 ------------------------------------------------------------------------------
def test_residuals_against_brute_force(spark):
    rng = random.Random(1)
    counts = {f"p{i}": {t: rng.randint(1, 6) for t in rng.sample(range(30), rng.randint(1, 12))} for i in range(60)}
    rows = [(p, (list(c), [math.log1p(n) for n in c.values()]), "x", 1.0, 1) for p, c in counts.items()]
    df = spark.createDataFrame(rows + rows[:20], SPARSE)
    total = sum(sum(c.values()) for c in counts.values())
    column = {t: sum(c.get(t, 0) for c in counts.values()) for t in range(30)}
    got = distinctive.residuals(df, "point_id").collect()
    assert len(got) == sum(map(len, counts.values()))
    for r in got:
        n, row, col = counts[r.point_id][r.term], sum(counts[r.point_id].values()), column[r.term]
        e = row * col / total
        assert r.n == n and r.df == sum(r.term in c for c in counts.values())
        assert r.score == pytest.approx((n - e) / math.sqrt(e * (1 - row / total) * (1 - col / total)))


def test_residuals_of_odd_rows(spark):
    rows = [("a", None, "x", 1.0, 1), ("b", ([], []), "x", 1.0, 1), ("c", ([1, 2], [None, 0.7]), "x", 1.0, 1), ("d", ([3], [1.4, 2.0]), None, None, None), (None, ([1], [1.0]), "x", 1.0, 1)]
    got = {(r.point_id, r.term): r.n for r in distinctive.residuals(spark.createDataFrame(rows, SPARSE), "point_id").collect()}
    assert got == {("c", 2): 1, ("d", 3): 3}
    assert distinctive.residuals(spark.createDataFrame([], SPARSE), "point_id").count() == 0
    one = spark.createDataFrame([("a", ([1], [math.log(4)]), "x", 1.0, 1)], SPARSE)
    assert [r.score for r in distinctive.residuals(one, "point_id").collect()] == [0.0]  # no spread


def test_rare_repeated(spark):
    v = math.log1p
    rows = [("a", ([1, 2], [v(3), v(3)]), "", 0.0, 0), ("b", ([1, 2], [v(1), v(9)]), "", 0.0, 0)] + [(f"c{i}", ([2], [v(3)]), "", 0.0, 0) for i in range(4)]
    got = distinctive.rare_repeated(spark.createDataFrame(rows, SPARSE), "point_id").collect()
    assert {(r.point_id, r.term) for r in got} == {("a", 1)}


def test_least_residual_is_a_bound(spark):
    """No term of few records scores below it, and common terms do."""
    rng = random.Random(8)
    counts = {f"p{i}": {t: rng.randint(1, 9) for t in [0, *rng.sample(range(1, 4000), 12)]} for i in range(400)}
    rows = [(p, (list(c), [math.log1p(n) for n in c.values()]), "x", 1.0, 1) for p, c in counts.items()]
    df = spark.createDataFrame(rows, SPARSE)
    cells = distinctive._scored(df, "point_id", "sparse", 1.38)
    floor = distinctive.least_residual(F.col("n"), F.col("_row"), F.col("_all"), F.col("_largest"), 5)
    got = cells.select("df", "score", floor.alias("floor")).collect()
    assert all(r.score >= r.floor > 0 for r in got if r.df <= 5)
    assert sum(r.score < r.floor for r in got if r.df == 400) > 100
    few = [r for r in got if 2 <= r.df <= 5]
    assert len(few) == distinctive.rare_repeated(df, "point_id").count() > 100
    assert "sqrt" in distinctive.rare_repeated(df, "point_id")._jdf.queryExecution().optimizedPlan().toString().lower()


# -- 4 ------------------------------------------------------------------------------
DENSE = "point_id string, dense array<float>, shard int, v string, a int"


def vectors(n, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 64))
    near = base[: n // 3] + rng.normal(size=(n // 3, 64)) * rng.uniform(0.05, 0.3, size=(n // 3, 1))
    same = np.repeat(base[:1], copies, axis=0)
    x = np.concatenate([base, near, same]) * rng.uniform(0.1, 4, size=(n + n // 3 + copies, 1))
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(f"p{i:05d}", r.tolist(), 1, "q", 2) for i, r in enumerate(x)], DENSE)


def brute(x, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    return {(f"p{i:05d}", f"p{j:05d}") for i, j in zip(*np.nonzero(s >= least)) if i < j}


@pytest.mark.parametrize("shard, block", [(10**6, 10**6), (150, 10**6), (200, 120)])
def test_similar_pairs(spark, shard, block):
    x = vectors(900)
    got = {(r.a, r.b) for r in neighbours.similar_pairs(frame(spark, x), 0.95, shard=shard, block=block).collect()}
    true = brute(x, 0.95)
    assert got <= true and len(got) >= 0.99 * len(true) > 100


def test_relax_of_one_is_exact(spark):
    x = vectors(500, 3)
    got = {(r.a, r.b) for r in neighbours.similar_pairs(frame(spark, x), 0.9, relax=1.0, shard=60).collect()}
    assert got == brute(x, 0.9)


def test_group_of_copies(spark):
    x = vectors(60, 5, copies=200)
    rows = neighbours.similar_pairs(frame(spark, x), 0.95, k=3).collect()
    partners = {}
    for r in rows:
        partners.setdefault(r.a, set()).add(r.b)
        partners.setdefault(r.b, set()).add(r.a)
        assert r.cosine >= 0.95
    copies = ["p00000"] + [f"p{i:05d}" for i in range(80, 280)]
    assert all(len(partners[c]) >= 3 for c in copies)
    assert len(rows) < 10 * len(x)


def test_unusable_vectors(spark):
    rows = [("a", None), ("b", [0.0] * 64), ("c", [1.0] * 63), ("d", [float("nan")] + [1.0] * 63), ("e", [1.0] * 64), ("e", [1.0] * 64), ("f", [2.0] * 64), (None, [1.0] * 64)]
    df = spark.createDataFrame([(k, v, 1, "q", 2) for k, v in rows], DENSE)
    assert [(r.a, r.b) for r in neighbours.similar_pairs(df, 0.95).collect()] == [("e", "f")]
    assert neighbours.similar_pairs(df.limit(0), 0.95).count() == 0
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df, df.where("point_id = 'b'")).count() == 0


@pytest.mark.parametrize("relax, least", [(1.0, 0.97), (neighbours.NEAREST_RELAX, 0.9)])
def test_nearest_recall(spark, relax, least):
    x = vectors(2400, 7)
    df = frame(spark, x)
    asked = df.where("int(substring(point_id, 2, 5)) % 20 = 0")
    rows = neighbours.nearest(df, asked, 10, relax=relax, shard=1000).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in rows:
        got.setdefault(int(r["query"][1:]), set()).add(int(r["neighbour"][1:]))
    hits = 0
    for q in range(0, len(x), 20):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:10].tolist()))
        assert len(got[q]) == 10
    assert hits / (10 * len(range(0, len(x), 20))) >= least


# -- 6 ------------------------------------------------------------------------------
LOG = "event_id bigint, query string, hits array<struct<id:string,type:string,score:double>>, term string, field string, record int"


def test_frequencies(spark):
    h = lambda *ids: [(i, "t", 1.0) for i in ids]
    rows = [(i, f"Common word{i}  x", h("a", " A", None), "", "", 0) for i in range(-100, 100)]
    rows += [(i, "Common dup", h("b"), "", "", 0) for i in (-5, -5)] + [(500, None, None, "", "", 0), (501, "", [], "", "", 0), (None, "zzz", h("q"), "", "", 0), (502, "pair pair", h("", "é"), "", "", 0)]
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in frequency.term_frequencies(spark.createDataFrame(rows, LOG)).collect()}
    assert got[("hits", "A")] == (398, 199, "common")
    assert got[("query", "common")][1:] == (200, "common")
    assert got[("query", "pair")] == (2, 1, "rare") and got[("hits", "")] == (1, 1, "rare") and got[("hits", "É")] == (1, 1, "rare")
    assert ("query", "zzz") not in got and ("hits", "Q") not in got
    assert frequency.term_frequencies(spark.createDataFrame([], LOG)).count() == 0


def _records(rows):
    return {(r.t, (r.range << frequency.RANGE) + 64 * w.word + i) for r in rows for w in r.words for i in range(64) if w.bits >> i & 1}


def test_bitmaps_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(-10_000, 10_000)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "t string, record bigint")
    vertical = frequency.bitmaps(df, "record", "t")
    assert _records(vertical.collect()) == set(rows)
    assert all([w.word for w in r.words] == sorted({w.word for w in r.words}) and all(w.bits for w in r.words) for r in vertical.collect())
    want = {t: (sum(x == t for x, _ in rows), len({n for x, n in rows if x == t})) for t in "abc"}
    assert {r.t: (r.occurrences, r.records) for r in frequency.frequencies(vertical, "t").collect()} == want
    halves = [frequency.bitmaps(df.where(c), "record", "t") for c in ("record % 3 = 0", "record % 3 <> 0 or record % 2 = 0")]
    both = frequency.union(*halves, "t")
    assert _records(both.collect()) == set(rows)
    assert {r.t: r.records for r in frequency.frequencies(both, "t").collect()} == {t: n for t, (_, n) in want.items()}


def test_events_are_shuffled_once_for_all_bitmaps(spark):
    """Containers are built where the records of a range are: no shuffle of (term, word) rows."""
    df = frequency.term_frequencies(spark.createDataFrame([(1, "a b", None, "", "", 0)], LOG))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_range" not in plan and "_word" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


# -- 7 ------------------------------------------------------------------------------
CHUNKS = "point_id string, repo string, file_path string, text string, start_line int, end_line int, chunk_index int, kind string, piece string, _pieces int, start string, extra int"


def check_pieces(text, cut, limit, overlap):
    assert all(0 < len(p.text) <= limit for p in cut)
    assert cut[0].start == 0 and cut[-1].start + len(cut[-1].text) == len(text)
    for a, b in zip(cut, cut[1:]):
        shared = a.start + len(a.text) - b.start
        assert 0 <= shared <= overlap and shared >= overlap * 3 // 4 - 1
    assert all(text[p.start : p.start + len(p.text)] == p.text for p in cut)


@pytest.mark.parametrize(
    "text",
    ["word " * 3000, "x" * 9001, "line of text\n" * 900, "ä😀" * 4000, "a" * 4000 + "\n\n" + "b" * 4000, "\r\n".join("some; code {}" for _ in range(900)), "\n" * 8100, "p.\n\n" * 2500],
    ids=range(8),
)
def test_pieces(spark, text):
    cut = spark.createDataFrame([(text,)], "t string").select(F.explode(splitting.pieces(F.col("t"))).alias("p")).select("p.*").orderBy("start").collect()
    check_pieces(text, cut, 4000, 200)


def test_pieces_end_at_the_strongest_boundary(spark):
    text = "a. " * 60 + "\n\n" + "b. " * 60
    cut = spark.createDataFrame([(text,)], "t string").select(F.explode(splitting.pieces(F.col("t"), 250, 20)).alias("p")).select("p.*").collect()
    assert cut[0].text.endswith("\n\n")


def test_short_null_and_empty_texts(spark, one):
    assert one(F.size(splitting.pieces(F.col("t"))), t="x" * 4000) == 1
    assert one(F.size(splitting.pieces(F.col("t"))), t="") == 0
    assert one(splitting.pieces(F.col("t").cast("string")), t=None) is None
    with pytest.raises(ValueError):
        splitting.pieces(F.col("t"), 100, 50)


def test_split_chunks(spark):
    body = "\n".join(f"line {i} of the file" for i in range(1, 501))
    text = "// a.ts\n// function: f (lines 11-510)\n" + body
    long = "y" * 5000
    rows = [
        ("p1", "r", "r/a.ts", text, 11, 510, 0, "code", "q", 1, "s", 7), ("p1", "r", "r/a.ts", text, 11, 510, 0, "code", "q", 1, "s", 7), ("p2", "r", "r/a.ts", long, 600, 600, 2, None, None, None, None, 8),
        ("p3", "r", "r/b.ts", "short", 1, 1, 0, "code", None, None, None, 9), ("p4", None, None, long, None, None, None, None, None, None, None, None), ("p5", "r", "r/c", None, 1, 1, 0, None, None, None, None, None),
    ]
    out = splitting.split_chunks(spark.createDataFrame(rows, CHUNKS))
    assert len(out.columns) == len(set(out.columns))
    got = {}
    for r in out.orderBy("point_id", "piece").collect():
        got.setdefault(r.point_id, []).append(r)
    assert set(got) == {"p1", "p2", "p4"}
    n = len(got["p1"])
    assert [r.chunk_index for r in got["p1"]] == list(range(n)) and got["p1"][0].n_pieces == n > 2
    assert [r.chunk_index for r in got["p2"]] == [2 + n - 1, 2 + n] and {r.extra for r in got["p2"]} == {8}
    assert got["p1"][0].start_line == 11 and got["p1"][-1].end_line == 510
    for r in got["p1"]:
        numbers = [int(x.split()[1]) + 10 for x in r.text.split("\n") if x.startswith("line ") and x.endswith("file")]
        assert r.start_line <= numbers[0] <= r.start_line + 1 and r.end_line == numbers[-1]
    assert all((r.start_line, r.end_line) == (600, 600) for r in got["p2"])
    assert all(r.start_line is None and r.chunk_index is None for r in got["p4"])
    assert splitting.split_chunks(spark.createDataFrame([], CHUNKS)).count() == 0


def test_lines_of_pieces_are_counted_along(spark):
    text = "one\ntwo\n\nthree four\n" * 900
    cut = spark.createDataFrame([(text,)], "t string").select(F.explode(splitting.pieces(F.col("t"))).alias("p")).select("p.*").collect()
    for p in cut:
        assert p.before == text[: p.start].count("\n") and p.inside == p.text.removesuffix("\n").count("\n") and p.length == len(p.text)


def test_splitting_is_linear(spark):
    """Four times the text takes about four times as long, not sixteen."""
    import time

    line = "a line of code; that goes on { like this }\n"

    def seconds(n):
        df = spark.createDataFrame([("p", "r", "r/a", line * (n // len(line)), 1, n, 0, "code", None, None, None, None)], CHUNKS)
        start = time.perf_counter()
        assert splitting.split_chunks(df).agg(F.sum(F.length("text"))).first()[0] >= 0.99 * n
        return time.perf_counter() - start

    seconds(100_000)
    small = seconds(1_000_000)
    assert seconds(4_000_000) < 5 * small + 2


def test_reindexed(spark):
    long = "y" * 5000
    row = lambda p, f, t, i: (p, "r", f, t, 1, 9, i, "code", None, None, None, None)
    rows = [row("a0", "r/a", "short", 0), row("a1", "r/a", long, 1), row("a2", "r/a", "short", 2), row("a2", "r/a", "short", 2), row("a3", "r/a", long * 2, 3), row("a4", "r/a", None, 4), row("b0", "r/b", "short", 0), row("c0", None, long, None)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = sorted((r.point_id, r.piece, r.chunk_index, r.total_chunks) for r in splitting.reindexed(df).where("point_id <> 'c0'").collect())
    assert [g[0] for g in got] == ["a0", "a1", "a1", "a2", "a3", "a3", "a3", "a4"]
    assert [g[2] for g in got] == list(range(8)) and {g[3] for g in got} == {8}
    pieces = sorted((r.point_id, r.piece, r.chunk_index) for r in splitting.split_chunks(df).where("point_id <> 'c0'").collect())
    assert set(pieces) <= {g[:3] for g in got}
    assert {r.chunk_index for r in splitting.reindexed(df).where("point_id = 'c0'").collect()} == {None}
    assert splitting.reindexed(df.limit(0)).count() == 0


# -- 8 ------------------------------------------------------------------------------
def test_plan_places_everything_once():
    rng = random.Random(4)
    for trial in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 300) for _ in range(rng.randint(1, 60))}
        use, count = {}, {}
        for length, first, past, container, per in packing.plan(histogram, 100):
            count[length] = count.get(length, 0) + past - first
            for rank in range(first, past):
                c = container + (rank - first) // per
                use[c] = use.get(c, 0) + length
        assert count == histogram and max(use.values()) <= 100
        assert sorted(use) == list(range(len(use)))
        best = math.ceil(sum(k * v for k, v in histogram.items()) / 100)
        assert len(use) <= max(best * 11 // 9 + 6, best + 1)
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_pack(spark):
    rng = random.Random(5)
    texts = [" ".join(["tree"] * rng.randint(1, 900)) for _ in range(300)] + ["house " * 5000, None, "", "same", "same", "\ud83d"]
    rows = [(i, t, 1, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, rank int, container string, length int")
    got = packing.pack(df, part=7).collect()
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    room, seen = {}, {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.token_to - r.token_from
        seen.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
    assert max(room.values()) <= 2048 and sorted(room) == list(range(len(room)))
    for i, t in enumerate(texts):
        spans = sorted(seen.get(i, []))
        assert (not spans) == (not t)
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == counts[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == math.ceil(counts[i] / 2048)
    assert sum(room.values()) / (2048 * len(room)) > 0.98
    assert packing.pack(df.limit(0)).count() == 0


# -- 9 ------------------------------------------------------------------------------
def grams(text, n=13):
    import re

    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 60)), "s", 1) for i in range(30)] + [(98, None, "s", 1), (99, "", "s", 1)]
    docs = []
    for i in range(300):
        body = text(rng.randint(0, 120))
        if i % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            a = rng.randint(0, max(0, len(w) - 10))
            body += " - " + ",\n ".join(w[a : a + rng.randint(8, 40)]).upper() + "! " + text(5)
        docs.append((i, body, "x", 1))
    docs += [(1000, None, "x", 1), (1001, "", "x", 1)] + docs[:40]
    got = leakage.matches(spark.createDataFrame(docs, "doc_id bigint, text string, shift string, low int"), spark.createDataFrame(items, "item_id bigint, text string, at string, word int"))
    found = [(r.item_id, r.doc_id) for r in got.collect()]
    true = {(i, d) for i, t, *_ in items if t for d, b, *_ in docs if b and grams(t) & grams(b)}
    assert len(found) == len(set(found)) and set(found) == true and len(true) > 20


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "word " * 20)], "item_id bigint, text string")
    assert leakage.matches(docs, items).count() == 0
    assert leakage.matches(docs.limit(0), items).count() == 0
    assert leakage.matches(docs, items.limit(0)).count() == 0


def test_index_holds_every_word(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of"] + [f"w{i}" for i in range(300)]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "lost words")], "doc_id bigint, text string")
    index = leakage.Index.build(docs, segment=2000)
    want = {}
    for i, t in enumerate(texts):
        for pos, w in enumerate(t.split()):
            want.setdefault(w, set()).add((i, pos))
    where = {}
    for r in index.documents().collect():
        where.setdefault(r.segment, []).append((r.base, r.size, r.doc_id))
    assert len(where) > 4
    got = {}
    for r in index.lists().collect():
        for p in leakage._unpack(r.postings).tolist():
            base, doc = next((b, d) for b, n, d in where[r.segment] if b <= p < b + n)
            got.setdefault(r.word, set()).add((doc, p - base))
    assert got == want
    assert {r.word: r.df for r in index.frequency(spark.createDataFrame([(w,) for w in want], "word string")).collect()} == {w: len({d for d, _ in x}) for w, x in want.items()}
    items = spark.createDataFrame([(1, " ".join(texts[7].split()[:20]))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.matches(docs, items, index=index).collect()] == [(1, 7)]
    index.remove()


def test_packed_places():
    lists = [[5], [0, 1, 2], [3, 300, 70_000, 70_001, 5_000_000], list(range(0, 60_000, 7)), [7, 700], [9]]
    starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
    order, packed = leakage._pack(np.concatenate(lists), starts)
    assert sorted(order.tolist()) == list(range(len(lists)))
    assert [leakage._unpack(b).tolist() for b in packed.to_pylist()] == [lists[i] for i in order]
    assert len(leakage._pack(np.empty(0, np.int64), np.empty(0, np.int64))[0]) == 0


def test_proximity(spark):
    """Planted passages with changes are found, each by its own item, and texts that only share common turns aren't."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    turn = "a reader should pick the one whose count was written last and say why".split()
    items = [[*rng.sample(vocabulary, 15), *turn, *rng.sample(vocabulary, 25)] for _ in range(40)]
    docs, planted = [], set()
    for d in range(200):
        body = [rng.choice(vocabulary) for _ in range(60)] + turn[:12]
        if d % 4 == 0:
            i = rng.randrange(40)
            part = items[i][15 + len(turn) - 5 :] if d % 8 else list(items[i])
            part = list(part)
            for at in range(7, len(part) - 5, 10):
                change = rng.randrange(3)
                part[at : at + 1] = [] if change == 0 else ["altered"] if change == 1 else [part[at], "very"]
            body[20:20] = part
            planted.add((i, d))
        docs.append((d, ", ".join(body)))
    got = leakage.passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")).collect()
    near = {(r.item_id, r.doc_id) for r in got if r.kind == "proximity"}
    phrases = {(r.item_id, r.doc_id) for r in got if r.kind == "phrase"}
    words = {i: set(zip(*[t[k:] for k in range(13)])) for i, t in enumerate(items)}
    in_doc = {d: set(zip(*[b.split(", ")[k:] for k in range(13)])) for d, b in docs}
    assert phrases == {(i, d) for i in words for d in in_doc if words[i] & in_doc[d]}
    assert near <= planted and len((near | phrases) & planted) == len(planted) == 50 and len(near) > 40
    assert all(r.similarity >= 0.8 and r.item_to - r.item_from >= 12 for r in got)


def test_passages_of_odd_input(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "word " * 300)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "word " * 20), (2, None), (3, "a b"), (1, "word " * 20)], "item_id bigint, text string")
    assert [(r.item_id, r.doc_id, r.kind) for r in leakage.passages(docs, items).collect()] == [(1, 4, "phrase")]
    assert leakage.passages(docs.limit(0), items).count() == 0 and leakage.passages(docs, items.limit(0)).count() == 0


def test_words_of_special_letters(spark):
    """A Kelvin sign and a dotted capital I separate words; their lower case must not make ASCII letters."""
    item = " ".join(f"ki{i}" for i in range(13))
    docs = [(1, item.upper()), (2, item.replace("ki3", "Ki3")), (3, item.replace("ki3", "kİki3"))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [r.doc_id for r in leakage.matches(df, items).collect()] == [1]


def test_nearest_in_blocks(spark):
    """Blocks of queries and cuts of shards change nothing; relax of one is exact over all shards."""
    x = vectors(1500, 9, copies=400)
    df = frame(spark, x)
    asked = df.where("int(substring(point_id, 2, 5)) % 20 = 0")
    u = neighbours.unpack(neighbours.pack(x.astype(np.float64)), 64)
    got = {}
    for r in neighbours.nearest(df, asked, 5, relax=1.0, shard=150, queries_per_task=7).collect():
        got.setdefault(int(r["query"][1:]), []).append(r.cosine)
    assert len(got) == len(range(0, len(x), 20))
    for q, cosines in got.items():
        s = u @ u[q]
        s[q] = -2
        assert np.allclose(sorted(cosines), np.sort(s)[-5:], atol=1e-4)


def test_routes_meet_only_their_own_path():
    x = vectors(3000, 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.fit(u, 6)
    d = neighbours.distances(u, tree.points)
    for margin in (0.0, 0.05):
        want, close = [set() for _ in range(tree.n_leaves)], set()
        for i in range(len(u)):
            stack = [0]
            while stack:
                node = stack.pop()
                if node < 0:
                    want[-node - 1].add(i)
                    continue
                off = d[i, node] - tree.radii[node]
                if abs(abs(off) - margin) < 1e-5:
                    close.add(i)  # rounding decides; radii are distances of some of the vectors
                stack += [int(tree.children[node, 0])] * int(off <= margin) + [int(tree.children[node, 1])] * int(off > -margin)
        got = [set(r.tolist()) for r in tree.route(u, margin)]
        assert all(a - close == b - close for a, b in zip(got, want)) and len(close) < 200
    assert len(np.concatenate(tree.route(u, 0.0))) >= len(u)


def test_every_link_without_a_bound(spark):
    x = vectors(300, 6, copies=50)
    rows = neighbours.similar_pairs(frame(spark, x), 0.95, k=None).collect()
    same = {"p00000"} | {f"p{i:05d}" for i in range(400, 450)}
    members = {r.b for r in rows if r.a == "p00000" and r.b in same}
    assert members == same - {"p00000"}
    others = {(r.a, r.b) for r in rows if r.b not in members and r.a not in members}
    assert others == {(a, b) for a, b in brute(x, 0.95) if a not in members and b not in members}
