"""Queries of the ten problems, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.session import cut_lineage, read_spread, read_table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# -- 1: distinctive terms -------------------------------------------------------
_CELLS = """pts as (select point_id, min(sparse) as sparse from points where sparse is not null group by 1),
cells as (select point_id, unnest(sparse.indices) as term_hash, unnest(sparse.values) as value from pts)"""


@query(f"""with {_CELLS}, dfs as (select term_hash, count(*) as df from cells group by 1)
select point_id, term_hash from cells join dfs using (term_hash) where value > 1.38 and df between 2 and 5""")
def p1_found(spark, d):
    from tallgrass.llm import distinctive

    return distinctive.rare_repeated(read_table(spark, d, "points"), "point_id").select("point_id", F.col("term").alias("term_hash"))


@query(f"""with {_CELLS}, c as (select *, round(exp(value) - 1) as n from cells), r as (select point_id, sum(n) as row_n from c group by 1),
k as (select term_hash, sum(n) as col_n, count(*) as df from c group by 1), t as (select sum(n) as all_n from c)
select point_id, term_hash, n::BIGINT as n, df, round((n - row_n * col_n / all_n) / sqrt(row_n * col_n / all_n * (1 - row_n / all_n) * (1 - col_n / all_n)), 4) as score
from c join r using (point_id) join k using (term_hash) cross join t""")
def p1_scores(spark, d):
    from tallgrass.llm import distinctive

    out = distinctive.residuals(read_table(spark, d, "points"), "point_id")
    return out.select("point_id", F.col("term").alias("term_hash"), "n", "df", F.round("score", 4).alias("score"))


# -- 2: files that are not hand-written ------------------------------------------
@query()
def p2_found(spark, d):
    from tallgrass.llm import handwritten

    return handwritten.not_handwritten(read_spread(spark, d, "files")).select("file_id")


@query()
def p2_reasons(spark, d):
    from tallgrass.llm import handwritten

    return handwritten.not_handwritten(read_spread(spark, d, "files"))


# -- 3: files that don't parse ----------------------------------------------------
@query()
def p3_found(spark, d):
    from tallgrass.llm import validity

    return validity.invalid(read_spread(spark, d, "files")).select("file_id")


@query()
def p3_rates(spark, d):
    from tallgrass.llm import validity

    return validity.rates(read_spread(spark, d, "files"))


# -- 4: similar vectors ---------------------------------------------------------
@query("""with v as (select distinct point_id, dense::DOUBLE[] as d from points where len(dense) = 64 and list_dot_product(dense::DOUBLE[], dense::DOUBLE[]) > 0)
select a.point_id as point_a, b.point_id as point_b from v a join v b on a.point_id < b.point_id where list_cosine_similarity(a.d, b.d) >= 0.95""")
def p4_found(spark, d):
    from tallgrass.llm import neighbours

    pairs = neighbours.similar_pairs(read_table(spark, d, "points"), 0.95)
    return pairs.select(F.col("a").alias("point_a"), F.col("b").alias("point_b"))


def _query_points(points: DataFrame) -> DataFrame:
    """The points whose id, read as a hexadecimal number, is divisible by 20."""
    low = F.conv(F.substring(F.replace("point_id", F.lit("-"), F.lit("")), -2, 2), 16, 10).cast("int")
    fives = F.aggregate(F.split(F.replace("point_id", F.lit("-"), F.lit("")), ""), F.lit(0), lambda s, c: s + F.coalesce(F.conv(c, 16, 10).cast("int"), F.lit(0)))
    return points.where((low % 4 == 0) & (fives % 5 == 0)).select("point_id")  # 16 = 1 (mod 5)


@query()
def p4_knn(spark, d):
    from tallgrass.llm import neighbours

    points = read_table(spark, d, "points")
    found = neighbours.nearest(points, _query_points(points), 10)
    paths = points.groupBy("point_id").agg(F.min("file_path").alias("file_path"))
    named = found.join(paths.select(F.col("point_id").alias("query"), F.col("file_path").alias("query_path")), "query")
    return named.join(paths.select(F.col("point_id").alias("neighbour"), "file_path"), "neighbour").select("query", "query_path", "rank", "neighbour", "file_path", F.round("cosine", 4).alias("cosine"))


# -- 5: secrets -----------------------------------------------------------------
@query()
def p5_found(spark, d):
    from tallgrass.llm import secrets

    return secrets.find_secrets(read_spread(spark, d, "chunks")).select("point_id", "line_no").distinct()


@query()
def p5_redacted(spark, d):
    from tallgrass.llm import secrets

    return secrets.redacted(read_spread(spark, d, "chunks"))


# -- 6: frequencies -------------------------------------------------------------
_TERMS = """ev as (select distinct on (event_id) event_id, query, hits from telemetry where event_id is not null order by event_id),
cells as (select event_id, 'hits' as field, upper(trim(h.id)) as term from (select event_id, unnest(hits) as h from ev) where h.id is not null
 union all select event_id, 'query', lower(unnest(regexp_extract_all(query, '[A-Za-z0-9]+'))) from ev where query is not null),
f as (select field, term, count(*) as occurrences, count(distinct event_id) as records from cells group by 1, 2),
m as (select *, case when records < 3 then 'rare' when records > 0.05 * (select count(*) from ev) then 'common' end as mark from f)"""


@query(f"with {_TERMS} select field, term, mark from m where mark is not null")
def p6_found(spark, d):
    from tallgrass.llm import frequency

    return frequency.term_frequencies(read_table(spark, d, "telemetry")).where("mark is not null").select("field", "term", "mark")


@query(f"with {_TERMS} select * from m")
def p6_frequencies(spark, d):
    from tallgrass.llm import frequency

    return frequency.term_frequencies(read_table(spark, d, "telemetry"))


# -- 7: splitting ---------------------------------------------------------------
@query("select distinct point_id from chunks where length(text) > 4000")
def p7_found(spark, d):
    from tallgrass.llm import splitting

    return splitting.split_chunks(read_table(spark, d, "chunks")).where("piece = 0").select("point_id")


@query()
def p7_pieces(spark, d):
    from tallgrass.llm import splitting

    return splitting.split_chunks(read_table(spark, d, "chunks"))


@query("""with c as (select distinct point_id, text, start_line, end_line from chunks where length(text) > 4000)
select point_id, length(text) as characters, md5(text) as digest, true as within_limit, true as overlapping, true as numbered, start_line as first_line from c""")
def p7_reassembled(spark, d):
    """The pieces put together again: what is new in each gives the text, and limits, overlaps and numbers are kept."""
    from tallgrass.llm import splitting

    p = splitting.split_chunks(read_table(spark, d, "chunks")).select("point_id", "piece", "n_pieces", "start", "text", "start_line")
    by = p.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "text", "start_line"))).alias("p"), F.max("n_pieces").alias("n"))
    state = F.struct(F.lit("").alias("text"), F.lit(True).alias("over"))

    def step(s, x):
        shared = F.length(s["text"]) - x["start"]
        return F.struct(
            F.concat(s["text"], F.substring(x["text"], shared + 1, F.length(x["text"]))).alias("text"),
            (s["over"] & ((x["piece"] == 0) | (shared >= 150 - 1) & (shared <= 200))).alias("over"),
        )

    whole = by.withColumn("w", F.aggregate("p", state, step))
    return whole.select(
        "point_id", F.length("w.text").cast("bigint").alias("characters"), F.md5("w.text").alias("digest"), F.forall("p", lambda x: F.length(x["text"]) <= 4000).alias("within_limit"), F.col("w.over").alias("overlapping"),
        ((F.size("p") == F.col("n")) & (F.col("p")[F.size("p") - 1]["piece"] == F.col("n") - 1)).alias("numbered"), F.col("p")[0]["start_line"].alias("first_line"),
    )


@query("""with c as (select distinct point_id, repo, file_path, chunk_index, length(text) > 4000 as long from chunks), f as (select repo, file_path, count(*) as chunks, count(*) filter (long) as long from c group by 1, 2)
select repo, file_path, chunks, long, true as gapless from f where long > 0""")
def p7_reindexed(spark, d):
    """Indexes of all chunks of the files that have an oversized one: without gaps, and in the old order."""
    from tallgrass.llm import splitting

    c = read_table(spark, d, "chunks").select("point_id", "repo", "file_path", F.col("chunk_index").alias("old")).distinct()
    r = splitting.reindexed(read_table(spark, d, "chunks")).join(c, "point_id")
    by = r.groupBy("repo", "file_path").agg(
        F.countDistinct("point_id").alias("chunks"), F.countDistinct(F.when(F.col("piece") > 0, F.col("point_id"))).alias("long"), F.array_sort(F.collect_list(F.struct("old", "piece", "chunk_index"))).alias("x"), F.max("total_chunks").alias("n"), F.min("old").alias("first")
    )
    # Indexes count on from the old ones, so a gap of the old ones stays one.
    ok = F.forall(F.sequence(F.lit(1), F.greatest(F.size("x") - 1, F.lit(1))), lambda i: F.coalesce(F.get("x", i)["chunk_index"] - F.get("x", i - 1)["chunk_index"] == F.greatest(F.get("x", i)["old"] - F.get("x", i - 1)["old"], F.lit(1)), F.lit(True)))
    return by.select("repo", "file_path", "chunks", "long", (ok & (F.size("x") == F.col("n"))).alias("gapless"))


# -- 8: packing -----------------------------------------------------------------
@query()
def p8_pack(spark, d):
    from tallgrass.llm import packing

    return packing.pack(read_spread(spark, d, "documents"))


@query("""select doc_id, true as covered from documents where length(text) > 0
union all select -1, true""")
def p8_coverage(spark, d):
    """Every text that isn't empty lies whole in its containers; row -1 says that no container holds more than 2,048 tokens, their numbers have no gap, and they are full but for 1 %."""
    from tallgrass.llm import packing

    packed = cut_lineage(packing.pack(read_spread(spark, d, "documents")))
    by_doc = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_from", "token_to", "piece"))).alias("x"))
    joined = F.forall(F.sequence(F.lit(1), F.size("x")), lambda i: F.when(i == F.size("x"), True).otherwise((F.get("x", i)["token_from"] == F.get("x", i - 1)["token_to"]) & (F.get("x", i - 1)["token_to"] % 2048 == 0)))
    docs = by_doc.select("doc_id", ((F.col("x")[0]["token_from"] == 0) & joined).alias("covered"))
    room = packed.groupBy("container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    total = room.agg(((F.max("n") <= 2048) & (F.max("container") + 1 == F.count(F.lit(1))) & (F.sum("n") >= F.count(F.lit(1)) * 2048 * 0.99 - 2048)).alias("covered"))
    return docs.unionByName(total.select(F.lit(-1).cast("bigint").alias("doc_id"), F.coalesce("covered", F.lit(True)).alias("covered")))


# -- 9: leaked evaluation texts -------------------------------------------------
@query("""with i as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from eval_items),
g as (select distinct item_id, array_to_string(list_slice(w, k::INT, (k + 12)::INT), ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i)),
dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
dg as (select doc_id, array_to_string(list_slice(w, k::INT, (k + 12)::INT), ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from dw))
select distinct item_id, doc_id from g join dg using (gram)""")
def p9_found(spark, d):
    from tallgrass.llm import leakage

    return leakage.matches(read_spread(spark, d, "documents"), read_table(spark, d, "eval_items"))


@query()
def p9_matches(spark, d):
    from tallgrass.llm import leakage

    return leakage.passages(read_spread(spark, d, "documents"), read_table(spark, d, "eval_items"))


# -- 10: personal information ---------------------------------------------------
@query()
def p10_found(spark, d):
    from tallgrass.llm import personal

    return personal.find_mentions(read_spread(spark, d, "documents")).select("doc_id", "line_no", "pii_type").distinct()


@query()
def p10_redacted(spark, d):
    from tallgrass.llm import personal

    return personal.redacted(read_spread(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
