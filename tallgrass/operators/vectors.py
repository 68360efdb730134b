"""Sparse and dense features, ranked retrieval, fusion and reranking."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.model import SearchFilters

RRF_K = 60
MAX_CANDIDATES = 50


def clamp_limit(limit: object) -> int:
    """A result limit between 1 and 50; anything that is no number means 10."""
    if isinstance(limit, bool) or not isinstance(limit, (int, float)) or math.isnan(limit):
        return 10
    return int(max(1, min(50, limit)))


def clamped(limit: Column) -> Column:
    """``clamp_limit`` of a column of numbers."""
    number = limit.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(10)).otherwise(F.floor(F.greatest(F.lit(1.0), F.least(F.lit(50.0), number)))).cast("int")


def candidates_for(limit: int) -> int:
    """How many rows each branch fetches for a result of ``limit`` rows."""
    return min(3 * limit, MAX_CANDIDATES)


_TOKEN, _BOUNDARY, _SEPARATOR = re.compile(text.TOKEN), re.compile("([a-z0-9])([A-Z])"), re.compile(text.PART_SEPARATOR)
#: Words whose hashes are kept at a time.
KEPT_WORDS = 500_000


def _hashes(word: str) -> tuple[int, ...]:
    """Hashes of a word's tokens: itself and its parts (see ``text.tokens`` and ``text.term_hash``)."""
    tokens = [word.lower(), *_SEPARATOR.split(_BOUNDARY.sub(r"\1 \2", word).lower())]
    out = []
    for token in tokens:
        if len(token) >= 2:
            h = text.FNV_OFFSET
            for c in token.encode():
                h = (h ^ c) * text.FNV_PRIME & text.MASK_32
            out.append(h)
    return tuple(out)


def term_counts(column: Column, max_terms: int = text.MAX_TERMS, pinned: bool = False) -> Column:
    """array<struct<term_hash, tf>> of a text, most frequent first, cut to ``max_terms``.

    Ties at the cut go to the term that occurs first. Terms with one hash are one
    term. A null text gives null, one without tokens an empty array. All of it is
    work on the row of a text, in Arrow batches; each word is hashed once per batch.
    ``pinned`` keeps the optimiser from moving the work into a filter and doing it twice.
    """

    def count(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, ...]] = {}
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            counts: dict[int, int] = {}
            for word in _TOKEN.findall(t):
                found = known.get(word)
                if found is None:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    found = known[word] = _hashes(word)
                for h in found:
                    counts[h] = counts.get(h, 0) + 1
            out.append([{"term_hash": h, "tf": n} for h, n in sorted(counts.items(), key=lambda x: -x[1])[:max_terms]])
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(count, "array<struct<term_hash:bigint,tf:int>>")
    return (udf.asNondeterministic() if pinned else udf)(column)


def term_postings(docs: DataFrame, key: str, column: str = "text", max_terms: int = text.MAX_TERMS) -> DataFrame:
    """``(key, term_hash, tf, weight)``: the terms of each text. Null and empty texts have no rows. No shuffle."""
    exploded = docs.select(F.col(key), term_counts(F.col(column), max_terms, pinned=True).alias("_t")).select(F.col(key), F.explode("_t").alias("_t"))
    return exploded.select(key, "_t.term_hash", "_t.tf", F.log1p(F.col("_t.tf").cast("double")).alias("weight"))


def sparse_vector(column: Column, max_terms: int = text.MAX_TERMS) -> Column:
    """Struct of ascending ``indices`` and their ``values``; null for a text without terms."""
    pairs = text.let(term_counts(column, max_terms), lambda t: F.array_sort(t))
    packed = F.struct(F.transform(pairs, lambda p: p["term_hash"]).alias("indices"), F.transform(pairs, lambda p: F.log1p(p["tf"].cast("double"))).alias("values"))
    return F.when(F.size(pairs) > 0, packed)


def sparse_vectors(docs: DataFrame, key: str, column: str = "text", max_terms: int = text.MAX_TERMS) -> DataFrame:
    """``(key, sparse)`` of the texts that have terms, without a shuffle."""
    counted = docs.select(F.col(key), term_counts(F.col(column), max_terms, pinned=True).alias("_t")).where(F.size("_t") > 0)
    ordered = counted.select(key, F.array_sort("_t").alias("_t"))
    return ordered.select(key, F.struct(F.col("_t.term_hash").alias("indices"), F.transform("_t", lambda p: F.log1p(p["tf"].cast("double"))).alias("values")).alias("sparse"))


# -- stored postings ---------------------------------------------------------------
def write_postings(points: DataFrame, folder: str, parts: int = 64) -> None:
    """Store the postings of sparse vectors by term, with what ranking needs.

    ``terms`` has ``(term_hash, point_id, weight, repo, kind, memory_type)`` in folders by
    term, sorted in these, so a query opens the parts of its terms only; frequent terms are
    split over files. ``sizes`` has the frequency of each term and, for the null term, the
    number of vectors. Made once per snapshot of the points.
    """
    fields = [c for c in ("repo", "kind", "memory_type") if c in points.columns]
    rows = unpack_sparse(points, "point_id", *fields).withColumn("part", F.pmod("term_hash", F.lit(parts)).cast("int"))
    rows.hint("rebalance", "part").sortWithinPartitions("part", "term_hash").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/terms")
    stored = points.sparkSession.read.parquet(f"{folder}/terms")
    sizes = stored.groupBy("term_hash").agg(F.count(F.lit(1)).alias("df"))
    n = points.where(F.col("sparse").isNotNull()).agg(F.count(F.lit(1)).alias("df")).select(F.lit(None).cast("bigint").alias("term_hash"), "df")
    sizes.unionByName(n).write.mode("overwrite").parquet(f"{folder}/sizes")


def stored_topk(spark: SparkSession, folder: str, query: str, k: int, filters: SearchFilters = SearchFilters(), parts: int = 64) -> DataFrame:
    """``sparse_topk`` on stored postings: reads only the parts and row groups of the query's terms."""
    wanted = {r.term_hash: r.query_weight for r in query_terms(spark, query).collect()}  # at most 512
    sizes = spark.read.parquet(f"{folder}/sizes").where(F.col("term_hash").isNull() | F.col("term_hash").isin(*wanted))
    n = sizes.where("term_hash is null").select(F.col("df").alias("_n"))
    idf = sizes.where("term_hash is not null").crossJoin(F.broadcast(n)).select("term_hash", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("_idf"))
    own = spark.createDataFrame(list(wanted.items()), "term_hash bigint, query_weight double")
    weights = idf.join(F.broadcast(own), "term_hash")
    hits = spark.read.parquet(f"{folder}/terms").where(F.col("part").isin(*{h % parts for h in wanted}) & F.col("term_hash").isin(*wanted)).where(filters.condition())
    scored = hits.join(F.broadcast(weights), "term_hash")  # a row per term of the query
    return ranked(scored.groupBy("point_id").agg(F.sum(F.col("query_weight") * F.col("weight") * F.col("_idf")).alias("score")), "point_id", k)


def unpack_sparse(points: DataFrame, *keep: str, column: str = "sparse") -> DataFrame:
    """Postings of stored sparse vectors: the columns ``keep``, ``term_hash`` and ``weight``.

    Null vectors, and positions that only one of the two arrays has, give no rows.
    """
    pairs = F.arrays_zip(F.col(f"{column}.indices").alias("i"), F.col(f"{column}.values").alias("v"))
    rows = points.where(F.col(column).isNotNull()).select(*keep, F.explode(pairs).alias("_p"))
    return rows.select(*keep, F.col("_p.i").alias("term_hash"), F.col("_p.v").alias("weight")).where("term_hash is not null and weight is not null")


def query_terms(spark, query: str) -> DataFrame:
    """Term weights of a query text; at most 512 rows, hence safe to broadcast."""
    one = spark.range(1).select(F.lit(0).alias("_q"), F.lit(query).alias("text"))
    return term_postings(one, "_q").select("term_hash", F.col("weight").alias("query_weight"))


def sparse_topk(points: DataFrame, query: str, k: int, filters: SearchFilters = SearchFilters(), key: str = "point_id") -> DataFrame:
    """``(key, score, rank)``: the ``k`` points with the largest sum of query weight x weight x idf.

    The collection's size and the document frequencies are of all points, before
    filters; only postings of query terms take part, so that the shuffle carries a
    few terms of each point. Ties go to the smaller key. A query without tokens,
    or whose terms occur nowhere, gives no rows.
    """
    wanted = F.broadcast(query_terms(points.sparkSession, query))
    fields = [c for c in ("repo", "kind", "memory_type") if c in points.columns]
    hits = unpack_sparse(points, key, *fields).join(wanted, "term_hash")
    n = points.where(F.col("sparse").isNotNull()).agg(F.count(F.lit(1)).alias("_n"))
    frequency = hits.groupBy("term_hash").agg(F.count(F.lit(1)).alias("_df"))
    idf = frequency.crossJoin(F.broadcast(n)).select("term_hash", F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    scored = hits.where(filters.condition()).join(F.broadcast(idf), "term_hash")
    total = scored.groupBy(key).agg(F.sum(F.col("query_weight") * F.col("weight") * F.col("_idf")).alias("score"))
    return ranked(total, key, k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The top ``k`` by score, ties by key, with their rank from 1."""
    top = scored.orderBy(F.desc("score"), F.asc(key)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if their lengths differ or one is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norms))


def dense_topk(points: DataFrame, vector: list[float], k: int, filters: SearchFilters = SearchFilters(), key: str = "point_id", column: str = "dense") -> DataFrame:
    """``(key, score, rank)`` of the ``k`` most similar vectors; one scan and a top-k, no shuffle.

    Vectors that are null, all zero or of another length are left out.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    norm = math.sqrt(sum(float(x) ** 2 for x in vector))
    if not norm:
        return points.select(key, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).limit(0)
    own = F.col(column)
    size_ok = F.size(own) == len(vector)
    scored = points.where(filters.condition() & size_ok).select(key, F.try_divide(dot(own, query), F.sqrt(dot(own, own)) * norm).alias("score"))
    return ranked(scored.where("score is not null and not isnan(score)"), key, k)


def fuse(branches: list[DataFrame], k: int, key: str = "point_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; a point that a branch lacks gets nothing from it."""
    parts = [b.select(key, (1.0 / (constant + F.col("rank"))).alias("_part")) for b in branches]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(every.groupBy(key).agg(F.sum("_part").alias("score")), key, k)


def hybrid_topk(points: DataFrame, query: str, vector: list[float], limit: int = 10, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Fused ranking of both branches; filters work inside each branch, before its cut."""
    n = candidates_for(clamp_limit(limit))
    fused = fuse([sparse_topk(points, query, n, filters), dense_topk(points, vector, n, filters)], n)
    return fused.where(F.col("rank") <= clamp_limit(limit))


def rerank_order(answer: DataFrame) -> DataFrame:
    """``(rank, index)`` from a reranker's rows ``input_pos, index, relevance_score, score``.

    Rows without an index are dropped; the first score there is counts, else 0;
    ties keep the order of the answer.
    """
    value = F.coalesce("relevance_score", "score", F.lit(0.0))
    w = Window.orderBy(F.desc(value), "input_pos")
    return answer.where("index is not null").select(F.row_number().over(w).alias("rank"), "index")


def apply_rerank(candidates: DataFrame, order: DataFrame, top_n: int) -> DataFrame:
    """Candidates (with ``rank`` from 1) in the order of a reranker; positions out of range are dropped.

    Both sides have at most 50 rows. The score stays that of the fusion.
    """
    new = order.select(F.col("rank").alias("_new"), (F.col("index") + 1).alias("rank"))
    joined = candidates.join(F.broadcast(new), "rank").orderBy("_new").limit(top_n)
    return joined.drop("rank").withColumnRenamed("_new", "rank")
