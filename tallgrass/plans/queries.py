"""Queries over the core operators, each with the SQL that must give the same rows.

Every query reads its tables whole. Scores are rounded to six decimals on both
sides, timestamps are compared as text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import paths, text
from tallgrass.model import SearchFilters
from tallgrass.operators import changes, chunking, guard, memory, usage, vectors
from tallgrass.session import checkpoint_dir, distinct_by_key, read_spread, read_table
from tallgrass.sources import logs
from tallgrass.sources.store import PointStore
from tallgrass.streaming import live

#: The fixed query and clock of the examples.
QUERY = "how do we stage the unsorted cache before the router drops a legacy snapshot"
NOW = datetime(2026, 2, 1)
QUERY_VECTOR = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
EXCLUDES = ("packages/*/docs/**", "*.svg", "./packages/*/tools/generators/?*.ts")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# -- SQL parts ------------------------------------------------------------------
_SKIP = r"(^|[/\\])(node_modules|\.git|dist|build|\.next|\.tmp|coverage|__tests__|vendor|\.turbo)[/\\]|(\.min\.(js|css|mjs)|\.d\.ts|\.bundle\.(js|mjs))$"
_SKIP_CHUNKER = _SKIP.replace(r"\.turbo", r"\.turbo|\.cache")
_TRIM = r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$"
_TOKENS = r"""flatten(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_\-.]*|[0-9]+'), lambda m:
  list_filter(list_concat([lower(m)], regexp_split_to_array(lower(regexp_replace(m, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s_\-.]+')), lambda t: length(t) >= 2)))"""
_HASH = "list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_BASE = "regexp_extract({0}, '[^/]*$')"
_EXT = r"regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+(\.[^.]*)$', 1)"
_MEMORY_PATH = (
    f"({_EXT.format('path')} = '.md' and case lower({_BASE.format('path')}) when 'index.md' then false "
    "when 'skill.md' then not regexp_matches(path, '/skills/(openspec-|opsx-)') when 'learnings.md' then true else contains(path, 'openspec/memory/') end)"
)
_LINE_EXTENSIONS = "('.json','.css','.scss','.md','.yaml','.yml','.toml','.xml','.html','.svg')"
_LANGUAGES = (
    "map {'.ts':'typescript','.tsx':'tsx','.js':'javascript','.jsx':'jsx','.json':'json','.css':'css','.scss':'scss','.md':'markdown',"
    "'.yaml':'yaml','.yml':'yaml','.toml':'toml','.xml':'xml','.html':'html','.svg':'svg'}"
)
_POSTINGS = """postings as (select point_id, kind, repo, memory_type, unnest(sparse.indices) as h, unnest(sparse.values) as w
  from (select *, null::varchar as memory_type from points) where sparse is not null)"""
_POINT_ROWS = "(select distinct on (point_id) * from points order by point_id, upserted_at nulls last)"


def _query_terms(q: str) -> str:
    return f"""terms as (select h, ln(1 + count(*)) as qw from (select {_HASH.format('t')} as h from (select unnest({_TOKENS.format("'" + q + "'")}) as t)) group by h)"""


def _sparse_sql(k: int, where: str, source: str = "points") -> str:
    return f"""pts as (select distinct on (point_id) * from {source} order by point_id),
{_query_terms(QUERY)},
post as (select point_id, repo, kind, unnest(sparse.indices) as h, unnest(sparse.values) as w from pts where sparse is not null),
n as (select count(*) as n from pts where sparse is not null),
dfs as (select h, count(*) as df from post join terms using (h) group by h),
sp as (select point_id, sum(qw * w * ln(1 + (n - df + 0.5) / (df + 0.5))) as score from post join terms using (h) join dfs using (h) cross join n where {where} group by point_id),
sparse_top as (select point_id, score, row_number() over (order by score desc, point_id) as rank from sp qualify rank <= {k})"""


def _dense_sql(k: int, where: str) -> str:
    v = "[" + ",".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
    return f"""dn as (select point_id, list_dot_product(dense::DOUBLE[], {v}) / sqrt(list_dot_product(dense::DOUBLE[], dense::DOUBLE[])) / sqrt(list_dot_product({v}, {v})) as score
  from pts where len(dense) = 64 and list_dot_product(dense::DOUBLE[], dense::DOUBLE[]) > 0 and {where}),
dense_top as (select point_id, score, row_number() over (order by score desc, point_id) as rank from dn qualify rank <= {k})"""


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return os.path.join(checkpoint_dir(spark), f"query-{uuid.uuid4().hex}")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """One row per point; repeated rows are exact copies."""
    return read_table(spark, d, "points").dropDuplicates(["point_id"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if c == "rank" else F.col(c) for c, t in df.dtypes])


# -- text features --------------------------------------------------------------
@query(f"""with tok as (select doc_id, unnest({_TOKENS.format('text')}) as t, generate_subscripts({_TOKENS.format('text')}, 1) as pos from documents where text is not null),
c as (select doc_id, {_HASH.format('t')} as term_hash, count(*) as tf, min(pos) as first from tok group by 1, 2)
select doc_id, term_hash, tf::INT as tf, round(ln(1 + tf), 6) as weight from c qualify row_number() over (partition by doc_id order by tf desc, first) <= 512""")
def tokenize_tf(spark, d):
    return _rounded(vectors.term_postings(read_spread(spark, d, "documents"), "doc_id"))


@query(f"select term, {_HASH.format('term')} as term_hash from (select distinct unnest({_TOKENS.format('query')}) as term from telemetry)")
def term_hash(spark, d):
    terms = read_table(spark, d, "telemetry").select(F.explode(text.tokens(F.col("query"))).alias("term")).distinct()
    return terms.select("term", text.term_hash(F.col("term")).alias("term_hash"))


@query(f"""with tok as (select point_id, unnest({_TOKENS.format('text')}) as t, generate_subscripts({_TOKENS.format('text')}, 1) as pos from (select distinct point_id, text from chunks)),
c as (select point_id, {_HASH.format('t')} as h, count(*) as tf, min(pos) as first from tok group by 1, 2),
top as (select * from c qualify row_number() over (partition by point_id order by tf desc, first) <= 512)
select point_id, count(*) as n_terms, string_agg(h::varchar, ',' order by h) as indices, round(sum(ln(1 + tf)), 4) as total from top group by 1""")
def sparse_vectors(spark, d):
    chunks = read_spread(spark, d, "chunks").select("point_id", "text").distinct()
    packed = vectors.sparse_vectors(chunks, "point_id")
    total = F.aggregate("sparse.values", F.lit(0.0), lambda s, x: s + x)
    return packed.select("point_id", F.size("sparse.indices").cast("bigint").alias("n_terms"), F.array_join("sparse.indices", ",").alias("indices"), F.round(total, 4).alias("total"))


@query(r"""select distinct title, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) as slug from chunks where title is not null""")
def slug(spark, d):
    t = read_table(spark, d, "chunks").where("title is not null").select("title").distinct()
    return t.select("title", text.slug(F.col("title")).alias("slug"))


@query(r"""with t as (select event_id, query, list_transform(regexp_extract_all(' ' || regexp_replace(query, '[^A-Za-z0-9_\-]', '  ', 'g') || ' ', '[^A-Za-z0-9_]([A-Za-z]{2,5}-[0-9]+)(?:[^A-Za-z0-9_])', 1), lambda x: upper(x)) as ids
 from (select distinct event_id, query from telemetry) where query is not null)
select event_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') as ids from t""")
def id_extract(spark, d):
    t = read_table(spark, d, "telemetry").where("query is not null").select("event_id", "query").distinct()
    return t.select("event_id", F.array_join(text.mentioned_ids(F.col("query")), ",").alias("ids"))


@query(r"""with t as (select event_id, query, list_transform(regexp_extract_all(' ' || regexp_replace(query, '[^A-Za-z0-9_\-]', '  ', 'g') || ' ', '[^A-Za-z0-9_]([A-Za-z]{2,5}-[0-9]+)(?:[^A-Za-z0-9_])', 1), lambda x: upper(x)) as ids
 from (select distinct event_id, query from telemetry) where query is not null)
select event_id, len(list_distinct(ids)) = 1 and upper(trim(query)) = ids[1] as bare from t""")
def bare_id(spark, d):
    t = read_table(spark, d, "telemetry").where("query is not null").select("event_id", "query").distinct()
    return t.select("event_id", F.coalesce(text.is_bare_id(F.col("query")), F.lit(False)).alias("bare"))


@query("select distinct repo, 'code_chunks_' || regexp_replace(repo, '[^A-Za-z0-9]+', '_', 'g') as collection from files where repo is not null")
def collection_name(spark, d):
    return read_table(spark, d, "files").where("repo is not null").select("repo", F.concat(F.lit("code_chunks_"), text.collection_name(F.col("repo"))).alias("collection")).distinct()


@query("select doc_id, md5(case when position('the cache' in text) > 0 then left(text, position('the cache' in text) - 1) || 'this store' || substr(text, position('the cache' in text) + 9) else text end) as digest from (select distinct doc_id, text from documents) where text is not null")
def replace_once(spark, d):
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return t.select("doc_id", F.md5(text.replace_once(F.col("text"), "the cache", "this store")).alias("digest"))


@query("""select memory_id, memory_type, case when memory_type = 'learning' then null when d is null then 'undated' when date_diff('day', d, date '2026-02-01') > 60 then 'stale' end as state
from (select *, case when regexp_matches(last_verified, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(last_verified as date) end as d
 from (select memory_id, memory_type, last_verified from core_memory union select memory_id, memory_type, last_verified from chunks where kind = 'memory'))""")
def staleness(spark, d):
    cols = ["memory_id", "memory_type", "last_verified"]
    entries = read_table(spark, d, "core_memory").select(*cols).union(read_table(spark, d, "chunks").where("kind = 'memory'").select(*cols)).distinct()
    return entries.select("memory_id", "memory_type", text.staleness(F.col("memory_type"), F.col("last_verified"), F.lit(NOW)).alias("state"))


@query("select file_id, md5(array_to_string(list_slice(string_split(source, chr(10)), 3, least(12, len(string_split(source, chr(10))))), chr(10))) as digest from (select distinct file_id, source from files)")
def line_slice(spark, d):
    f = read_table(spark, d, "files").select("file_id", "source").distinct()
    return f.select("file_id", F.md5(text.line_slice(F.col("source"), F.lit(3), F.lit(12))).alias("digest"))


# -- paths ----------------------------------------------------------------------
@query(f"select distinct repo, path, regexp_matches(path, '{_SKIP}') as skipped, regexp_matches(path, '{_SKIP_CHUNKER}') as skipped_by_chunker from files")
def skip_filter(spark, d):
    f = read_table(spark, d, "files").select("repo", "path").distinct()
    return f.select("repo", "path", paths.is_skipped(F.col("path")).alias("skipped"), paths.is_skipped(F.col("path"), for_chunker=True).alias("skipped_by_chunker"))


@query(
    rf"""select distinct repo, path from files where not regexp_matches(path, '{_SKIP}')
and not regexp_matches(path, '^packages/[^/]*/docs/.*$|(^|/)[^/]*\.svg$|^packages/[^/]*/tools/generators/[^/][^/]*\.ts$')"""
)
def exclude_glob(spark, d):
    f = read_table(spark, d, "files").select("repo", "path").distinct()
    return f.where(~paths.is_skipped(F.col("path"), EXCLUDES))


@query(
    f"""select distinct repo, path, case when {_MEMORY_PATH} then 'memory' when {_EXT.format('path')} in ('.ts','.tsx','.js','.jsx') then 'script'
 when {_EXT.format('path')} in {_LINE_EXTENSIONS} then 'line' end as branch, {_LANGUAGES}[{_EXT.format('path')}] as language from files"""
)
def ext_dispatch(spark, d):
    f = read_table(spark, d, "files").select("repo", "path").distinct()
    return f.select("repo", "path", paths.branch(F.col("path")).alias("branch"), paths.language_label(F.col("path")).alias("language"))


@query(
    f"""select distinct repo, path, coalesce(map {{'architecture.md':'architecture','conventions.md':'convention','pitfalls.md':'pitfall','decisions.md':'decision',
 'workflows.md':'workflow','learnings.md':'learning','skill.md':'skill'}}[lower({_BASE.format('path')})], 'note') as memory_type from files where {_MEMORY_PATH}"""
)
def memory_type(spark, d):
    f = read_table(spark, d, "files").select("repo", "path").distinct()
    return f.where(paths.is_memory_path(F.col("path"))).select("repo", "path", paths.memory_type(F.col("path")).alias("memory_type"))


@query("select distinct repo, file_path, chunk_index, point_id from chunks")
def point_id(spark, d):
    c = read_table(spark, d, "chunks").select("repo", "file_path", "chunk_index").distinct()
    return c.withColumn("point_id", paths.point_id(F.col("repo"), F.col("file_path"), F.col("chunk_index")))


# -- chunks ---------------------------------------------------------------------
def _window_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with f as (select distinct repo, path, source from files where {_EXT.format('path')} in {_LINE_EXTENSIONS} and source is not null and not regexp_matches(path, '{_SKIP_CHUNKER}')),
l as (select repo, path, string_split(source, chr(10)) as ls from f),
w as (select repo, path, ls, unnest(range(0, case when len(ls) <= {size} then 1 else 1 + ceil((len(ls) - {size}) / {step}.0)::INT end)) as i from l)
select repo, path, i::INT as chunk_index, (1 + {step} * i)::INT as start_line, least({step} * i + {size}, len(ls))::INT as end_line,
 md5('// ' || path || chr(10) || array_to_string(list_slice(ls, (1 + {step} * i)::INT, least({step} * i + {size}, len(ls))::INT), chr(10))) as digest from w"""


def _line_chunks(spark, d, size, overlap):
    f = read_spread(spark, d, "files").select("repo", "path", "source", F.lit("c").alias("commit_hash")).distinct()
    f = f.where(paths.extension(F.col("path")).isin(*paths.LINE_LANGUAGES) & ~paths.is_skipped(F.col("path"), for_chunker=True))
    c = chunking.chunk_by_lines(f, size, overlap)
    return c.select("repo", F.expr("substring(file_path, length(repo) + 2)").alias("path"), "chunk_index", "start_line", "end_line", F.md5("text").alias("digest"))


@query(_window_sql(100, 20))
def line_chunks(spark, d):
    return _line_chunks(spark, d, 100, 20)


@query(_window_sql(20, 4))
def line_chunks_short(spark, d):
    return _line_chunks(spark, d, 20, 4)


def _ranges(spark, d) -> DataFrame:
    i = read_table(spark, d, "lineitem")
    name = F.when(F.col("l_quantity") % 3 != 0, F.concat(F.lit("f"), F.col("l_partkey") % 7))
    r = F.struct(
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("start_line"),
        (F.col("l_suppkey") % 5 + 1 + F.col("l_partkey") % 4 * 190).cast("int").alias("end_line"),
        name.alias("symbol_name"),
        F.lit("function").alias("symbol_type"),
    )
    packed = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", r.alias("r")))).alias("rs"))
    return packed.select("l_orderkey", F.transform("rs", lambda x: x["r"]).alias("ranges"))


_RANGES_SQL = """r as (select l_orderkey, l_linenumber, (l_suppkey % 5 + 1)::INT as s, (l_suppkey % 5 + 1 + l_partkey % 4 * 190)::INT as e,
 case when l_quantity % 3 <> 0 then 'f' || (l_partkey % 7)::varchar end as name from lineitem),
u as (select * from r qualify row_number() over (partition by l_orderkey, s, e order by (name is null), l_linenumber, name) = 1)"""


@query(f"with {_RANGES_SQL} select l_orderkey, s as start_line, e as end_line, name as symbol_name from u")
def range_dedup(spark, d):
    rows = _ranges(spark, d).select("l_orderkey", F.explode(chunking.dedup_ranges(F.col("ranges"))).alias("r"))
    return rows.select("l_orderkey", "r.start_line", "r.end_line", "r.symbol_name")


@query(f"""with {_RANGES_SQL}, w as (select *, unnest(range(0, case when e - s + 1 <= 200 then 1 else 1 + ceil((e - s + 1 - 200) / 180.0)::INT end)) as i from u)
select l_orderkey, (s + 180 * i)::INT as start_line, least(s + 180 * i + 199, e)::INT as end_line, case when i = 0 then name end as symbol_name from w""")
def range_split(spark, d):
    rows = _ranges(spark, d).select("l_orderkey", F.explode(chunking.split_ranges(chunking.dedup_ranges(F.col("ranges")))).alias("r"))
    return rows.select("l_orderkey", "r.start_line", "r.end_line", "r.symbol_name")


def _current_files(spark, d) -> DataFrame:
    return read_spread(spark, d, "files").select("repo", "path", "source", "commit_hash").dropDuplicates(["repo", "path"])


@query(rf"""with f as (select distinct repo, path, source from files where source is not null and {_MEMORY_PATH} and not regexp_matches(path, '{_SKIP_CHUNKER}')
  and lower({_BASE.format('path')}) not in ('skill.md', 'learnings.md')),
blanked as (select repo, path, string_split(list_reduce(list_concat([source], list_sort(list_distinct(regexp_extract_all(source, '(?s)<!--.*?-->')))), lambda acc, m: replace(acc, m, regexp_replace(m, '[^\n]', '', 'g'))), chr(10)) as ls from f),
l as (select repo, path, ls, unnest(ls) as line, generate_subscripts(ls, 1) as pos from blanked),
h as (select repo, path, ls, pos, trim(regexp_extract(line, '^##\s+([^\r\n]+)$', 1)) as heading from l where regexp_matches(line, '^##\s+[^\r\n]+$')),
s as (select *, coalesce(lead(pos) over (partition by repo, path order by pos) - 1, len(ls)) as stop, row_number() over (partition by repo, path order by pos) - 1 as i, count(*) over (partition by repo, path) as n from h)
select repo, path, i::INT as chunk_index, pos::INT as start_line, stop::INT as end_line, n::INT as total_chunks,
 case when regexp_matches(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+.+$') then regexp_extract(heading, '^([A-Za-z][A-Za-z0-9_\-]{{1,14}}):', 1) else left(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) end as memory_id,
 case when regexp_matches(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+.+$') then trim(regexp_extract(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+(.+)$', 1)) else heading end as title,
 md5(regexp_replace(array_to_string(list_slice(ls, pos::INT, stop::INT), chr(10)), '{_TRIM}', '', 'g')) as digest from s""")
def memory_sections(spark, d):
    f = _current_files(spark, d)
    name = F.lower(paths.base_name(F.col("path")))
    f = f.where(paths.is_memory_path(F.col("path")) & ~paths.is_skipped(F.col("path"), for_chunker=True) & ~name.isin("skill.md", "learnings.md"))
    c = chunking.chunk_memory(f)
    return c.select("repo", F.expr("substring(file_path, length(repo) + 2)").alias("path"), "chunk_index", "start_line", "end_line", "total_chunks", "memory_id", "title", F.md5("text").alias("digest"))


_SECTIONS = rf"""f as (select distinct repo, path, source, lower({_BASE.format('path')}) as name from files where source is not null and {_MEMORY_PATH} and not regexp_matches(path, '{_SKIP_CHUNKER}')),
blanked as (select repo, path, string_split(list_reduce(list_concat([source], list_sort(list_distinct(regexp_extract_all(source, '(?s)<!--.*?-->')))), lambda acc, m: replace(acc, m, regexp_replace(m, '[^\n]', '', 'g'))), chr(10)) as ls from f where name not in ('skill.md', 'learnings.md')),
l as (select repo, path, ls, unnest(ls) as line, generate_subscripts(ls, 1) as pos from blanked),
h as (select repo, path, ls, pos, trim(regexp_extract(line, '^##\s+([^\r\n]+)$', 1)) as heading from l where regexp_matches(line, '^##\s+[^\r\n]+$')),
s as (select *, coalesce(lead(pos) over (partition by repo, path order by pos) - 1, len(ls)) as stop, row_number() over (partition by repo, path order by pos) - 1 as i, count(*) over (partition by repo, path) as n from h),
sections as (select repo, path, i::INT as i, pos::INT as start_line, stop::INT as end_line, n::INT as total, regexp_replace(array_to_string(list_slice(ls, pos::INT, stop::INT), chr(10)), '{_TRIM}', '', 'g') as body,
 case when regexp_matches(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+.+$') then regexp_extract(heading, '^([A-Za-z][A-Za-z0-9_\-]{{1,14}}):', 1) else left(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) end as memory_id,
 case when regexp_matches(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+.+$') then trim(regexp_extract(heading, '^[A-Za-z][A-Za-z0-9_\-]{{1,14}}:\s+(.+)$', 1)) else heading end as title, null as described from s),
heads as (select *, regexp_extract(source, '^---\n((?s).*?)\n---', 1) as front, regexp_extract(path, '([^/]+)/[^/]*$', 1) as folder from f where name in ('skill.md', 'learnings.md')),
named as (select *, regexp_replace(regexp_extract_all(front, '(?m)^name:[ \t]*(\S[^\n]*)$', 1)[-1], '{_TRIM}', '', 'g') as skill, regexp_replace(regexp_extract_all(front, '(?m)^description:[ \t]*(\S[^\n]*)$', 1)[-1], '{_TRIM}', '', 'g') as described,
 nullif(regexp_replace(regexp_extract(source, '(?m)^#\s+(.+)$', 1), '{_TRIM}', '', 'g'), '') as first_heading from heads),
whole as (select repo, path, 0 as i, 1 as start_line, len(string_split(source, chr(10)))::INT as end_line, 0 as total, source as body,
 case name when 'skill.md' then coalesce(skill, left(regexp_replace(regexp_replace(lower({_BASE.format('path')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48)) else left(regexp_replace(regexp_replace(lower(folder), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) end as memory_id,
 case name when 'skill.md' then coalesce(skill, {_BASE.format('path')}) else coalesce(first_heading, 'Learnings — ' || folder) end as title, case name when 'skill.md' then described end as described from named),
every as (select * from sections union all select * from whole),
ln as (select repo, path, i, pos, regexp_replace(line, '{_TRIM}', '', 'g') as line from (select repo, path, i, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from every)),
field as (select repo, path, i, pos, line, regexp_extract(line, '(?i)^(?:[-*]\s+)?(?:\*\*)?When relevant:?(?:\*\*)?:?\s*(.*)$', 1) as w,
 regexp_extract(regexp_extract(line, '(?i)^(?:[-*]\s+)?(?:\*\*)?Last verified:?(?:\*\*)?:?\s*(.*)$', 1), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as v,
 regexp_matches(line, '(?i)^(?:\*\*)?Evidence[^:]*:(?:\*\*)?\s*$') as label, regexp_extract(line, '^[-*]\s+(.+)$', 1) as bullet from ln),
runs as (select *, sum(case when label or line <> '' and bullet = '' then 1 else 0 end) over (partition by repo, path, i order by pos) as g from field),
ev as (select repo, path, i, g, string_agg(regexp_replace(bullet, '{_TRIM}', '', 'g'), '|' order by pos) filter (bullet <> '' and not label) as evidence from runs group by 1, 2, 3, 4 having bool_or(label)),
last_ev as (select repo, path, i, arg_max(evidence, g) as evidence from ev where evidence is not null group by 1, 2, 3),
fields as (select repo, path, i, arg_max(w, pos) filter (w <> '') as w, arg_max(v, pos) filter (v <> '') as v from field group by 1, 2, 3)"""


@query(f"""with {_SECTIONS} select e.repo, e.path, e.i as chunk_index, e.start_line, e.end_line, e.total as total_chunks, e.memory_id, e.title,
 coalesce(regexp_replace(f.w, '{_TRIM}', '', 'g'), e.described) as when_relevant, x.evidence, f.v as last_verified, md5(e.body) as digest
 from every e join fields f on f.repo = e.repo and f.path = e.path and f.i = e.i left join last_ev x on x.repo = e.repo and x.path = e.path and x.i = e.i""")
def memory_chunks(spark, d):
    f = _current_files(spark, d)
    c = chunking.chunk_memory(f.where(paths.is_memory_path(F.col("path")) & ~paths.is_skipped(F.col("path"), for_chunker=True)))
    own = c.select("repo", F.expr("substring(file_path, length(repo) + 2)").alias("path"), "chunk_index", "start_line", "end_line", "total_chunks", "memory_id", "title", "when_relevant", F.array_join("evidence", "|").alias("evidence"), "last_verified", F.md5("text").alias("digest"))
    return own


@query()
def ast_chunks(spark, d):
    f = _current_files(spark, d)
    return chunking.chunk_scripts(f.where(paths.extension(F.col("path")).isin(*paths.SCRIPT_LANGUAGES) & ~paths.is_skipped(F.col("path"), for_chunker=True)))


@query("""with p as (select p_partkey as k, p_partkey % 7 as n from part),
d as (select k, 3 as a, 4 + n as b, 'alpha' || k as name, 'function' as type from p union all select k, 6 + n, 8 + n, 'Shape' || k, 'interface' from p union all select k, 10 + n, 14 + n, 'Box' || k, 'class' from p
 union all select k, 11 + n, 13 + n, 'open', 'method' from p union all select k, 16 + n, 16 + n, 'Name' || k, 'type' from p union all select k, 18 + n, 18 + n, 'pick' || k, 'component' from p)
select 'src/part' || k || '.ts' as path, a::INT as start_line, b::INT as end_line, name as symbol_name, type as symbol_type, '// ' || type || ': ' || name || ' (lines ' || a || '-' || b || ')' as label, (row_number() over (partition by k order by a, b) - 1)::INT as chunk_index from d""")
def script_declarations(spark, d):
    """Scripts made from the parts, whose declarations are known by arithmetic."""
    k = F.col("p_partkey")
    source = F.concat(
        F.lit("import x from 'x';\n\nexport function alpha"), k, F.lit("(a: number) {\n"), F.expr("repeat('  run(a);\n', cast(p_partkey % 7 as int))"), F.lit("}\n\ninterface Shape"), k, F.lit(" {\n  a: string;\n}\n\nclass Box"), k,
        F.lit(" {\n  open(b: number) {\n    return b;\n  }\n}\n\ntype Name"), k, F.lit(" = string;\n\nconst pick"), k, F.lit(" = (c: number) => c;\n"),
    )
    f = read_spread(spark, d, "part").select(F.lit("r").alias("repo"), F.concat(F.lit("src/part"), k, F.lit(".ts")).alias("path"), source.alias("source"), F.lit("c").alias("commit_hash"))
    c = chunking.chunk_scripts(f)
    return c.select(F.expr("substring(file_path, length(repo) + 2)").alias("path"), "start_line", "end_line", "symbol_name", "symbol_type", F.get(F.split("text", "\n"), F.lit(1)).alias("label"), "chunk_index")


@query()
def chunk_files(spark, d):
    return chunking.with_point_ids(chunking.chunk_files(_current_files(spark, d)))


@query(rf"""select distinct repo, path, {_LANGUAGES}[{_EXT.format('path')}] as language from files where source is not null and not regexp_matches(path, '{_SKIP_CHUNKER}') and not {_MEMORY_PATH}
 and ({_EXT.format('path')} in {_LINE_EXTENSIONS} or {_EXT.format('path')} in ('.ts','.tsx','.js','.jsx') and regexp_matches(source, '[^\s\x{{A0}}\x{{FEFF}}]'))""")
def chunk_routes(spark, d):
    """Which files have chunks of code, and in which language."""
    c = chunking.chunk_files(_current_files(spark, d)).where("kind = 'code'")
    return c.select("repo", F.expr("substring(file_path, length(repo) + 2)").alias("path"), "language").distinct()


# -- retrieval ------------------------------------------------------------------
@query(f"with {_sparse_sql(30, 'true')} select point_id, round(score, 6) as score, rank from sparse_top")
def sparse_topk(spark, d):
    return _rounded(vectors.sparse_topk(_points(spark, d), QUERY, 30))


@query(f"with pts as (select distinct on (point_id) * from points order by point_id), {_dense_sql(30, 'true')} select point_id, round(score, 6) as score, rank from dense_top")
def dense_topk(spark, d):
    return _rounded(vectors.dense_topk(_points(spark, d), QUERY_VECTOR, 30))


@query("""with q as (select embedding::DOUBLE[] as q from embeddings where vec_id = 0)
select vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) as score, row_number() over (order by list_cosine_similarity(embedding::DOUBLE[], q) desc, vec_id) as rank
from embeddings cross join q where len(embedding) = len(q) qualify rank <= 10""")
def embedding_topk(spark, d):
    e = read_table(spark, d, "embeddings")
    first = e.where("vec_id = 0").first()
    return _rounded(vectors.dense_topk(e, first["embedding"] if first else [0.0], 10, key="vec_id", column="embedding"))


def _fused_sql(where: str) -> str:
    return f"""with {_sparse_sql(30, where)}, {_dense_sql(30, where)},
parts as (select point_id, 1.0::DOUBLE / (60 + rank) as part from sparse_top union all select point_id, 1.0::DOUBLE / (60 + rank) from dense_top),
fused as (select point_id, sum(part) as score from parts group by 1)
select point_id, round(score, 6) as score, row_number() over (order by score desc, point_id) as rank from fused qualify rank <= 10"""


@query(_fused_sql("true"))
def hybrid_rrf(spark, d):
    return _rounded(vectors.hybrid_topk(_points(spark, d), QUERY, QUERY_VECTOR, 10))


@query(_fused_sql("kind is distinct from 'memory' and repo = 'meridian-core'"))
def filtered_hybrid(spark, d):
    return _rounded(vectors.hybrid_topk(_points(spark, d), QUERY, QUERY_VECTOR, 10, SearchFilters(repo="meridian-core", exclude_memory=True)))


@query(f"with {_sparse_sql(30, 'true')} select point_id, round(score, 6) as score, rank from sparse_top")
def stored_sparse_topk(spark, d):
    """The same ranking from stored postings."""
    folder = _scratch(spark)
    vectors.write_postings(_points(spark, d), folder)
    return _rounded(vectors.stored_topk(spark, folder, QUERY, 30))


def _answer(spark, d) -> DataFrame:
    """An answer of a reranking service about all vectors, in which some have no index and some no score."""
    e = read_table(spark, d, "embeddings")
    score = F.round(F.col("embedding")[0].cast("double"), 3)
    return e.select(
        F.col("vec_id").alias("input_pos"), F.when(score > -0.9, F.col("vec_id").cast("int")).alias("index"), F.when(score > 0.5, score).alias("relevance_score"), F.when(score > -0.2, score).alias("score")
    )


_ANSWER = """a as (select vec_id as pos, case when s > -0.9 then vec_id::INT end as idx, case when s > 0.5 then s when s > -0.2 then s else 0 end as s from (select vec_id, round(embedding[1]::DOUBLE, 3) as s from embeddings)),
o as (select row_number() over (order by s desc, pos) as rank, idx as "index" from a where idx is not null)"""


@query(f"with {_ANSWER} select * from o")
def rerank_order(spark, d):
    return vectors.rerank_order(_answer(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""with {_ANSWER}, {_sparse_sql(50, 'true')} select point_id, round(score, 6) as score, row_number() over (order by o.rank) as rank from o join sparse_top s on s.rank = o."index" + 1""")
def rerank_apply(spark, d):
    """Candidates in the order of an answer that also names positions that there aren't."""
    found = vectors.apply_rerank(vectors.sparse_topk(_points(spark, d), QUERY, 50), vectors.rerank_order(_answer(spark, d)), 50)
    return _rounded(found.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).select("point_id", "score", "rank"))


@query("""select event_id, case when n is null or isnan(n) then 10 else floor(greatest(1, least(50, n)))::INT end as "limit"
from (select event_id, hits[1].score * 80 - 10 as n from (select distinct event_id, hits from telemetry))""")
def limit_clamp(spark, d):
    t = read_table(spark, d, "telemetry").select("event_id", F.get("hits", F.lit(0))["score"].alias("s"), "hits").distinct()
    return t.select("event_id", vectors.clamped(F.col("s") * 80 - 10).alias("limit"))


@query(f"""with m as (select distinct point_id, memory_id, kind from chunks where kind = 'memory'),
p as (select point_id, memory_id, row_number() over (partition by memory_id order by point_id) as n from m where memory_id in ('WF-1002', 'CON-1001')),
pin as (select point_id, row_number() over (order by case memory_id when 'WF-1002' then 1 else 2 end, point_id) as rank from p where n <= 5),
{_sparse_sql(20, "kind = 'memory'")},
mix as (select point_id, 0 as tier, rank from pin union all select point_id, 1, rank from sparse_top where point_id not in (select point_id from pin))
select point_id, r as rank from (select point_id, tier, row_number() over (order by tier, rank, point_id) as r from mix) where r <= 10 or tier = 0""")
def id_pin_merge(spark, d):
    m = read_table(spark, d, "chunks").where("kind = 'memory'").select("point_id", "memory_id", "kind", "repo").distinct()
    found = memory.find_by_ids(m, ["WF-1002", "CON-1001"])
    pinned = found.select("point_id", F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy("id_order", "point_id")).alias("rank"))
    semantic = vectors.sparse_topk(_points(spark, d), QUERY, 20, SearchFilters(kind="memory"))
    return memory.pin_merge(pinned, semantic, 10).select("point_id", F.col("rank").cast("bigint").alias("rank"))


@query("""select memory_id, md5('[' || coalesce(memory_type, 'note') || '] ' || case when coalesce(memory_id, '') <> '' then memory_id || ' — ' else '' end || coalesce(title, '')
 || case when last_verified <> '' then chr(10) || 'Last verified: ' || last_verified else '' end
 || case when memory_type <> 'learning' and last_verified is null then chr(10) || '⚠ no verification date — confirm it still holds before relying on it'
   when memory_type <> 'learning' and date_diff('day', try_cast(last_verified as date), date '2026-02-01') > 60
   then chr(10) || '⚠ stale: unverified for ' || date_diff('day', try_cast(last_verified as date), date '2026-02-01')::varchar || ' days — confirm it still holds before relying on it' else '' end
 || chr(10) || 'Score: 0.2500' || chr(10) || chr(10)) as digest from core_memory""")
def render_memory(spark, d):
    none = F.lit(None).cast("string")
    m = read_table(spark, d, "core_memory").withColumns({"symbol_name": none, "when_relevant": none, "evidence": F.lit(None).cast("array<string>"), "score": F.lit(0.25), "text": none})
    return m.select("memory_id", F.md5(memory.render_memory(F.lit(NOW))).alias("digest"))


@query("""select distinct point_id, md5('File: ' || coalesce(file_path, '') || chr(10) || 'Repository: ' || coalesce(repo, '') || chr(10) || 'Lines: ' || start_line || '-' || end_line || chr(10)
 || 'Symbol: ' || coalesce(symbol_name, 'unknown') || ' (' || coalesce(symbol_type, 'unknown') || ')' || chr(10) || 'Score: 0.2500' || chr(10) || chr(10) || coalesce(text, '')) as digest from chunks where kind is distinct from 'memory'""")
def render_code(spark, d):
    c = read_table(spark, d, "chunks").where(SearchFilters(exclude_memory=True).condition()).withColumn("score", F.lit(0.25))
    return c.select("point_id", F.md5(memory.render_code()).alias("digest")).distinct()


# -- changes --------------------------------------------------------------------
def _status_lines(spark, d) -> DataFrame:
    f = read_table(spark, d, "files").select("file_id", "repo", "path").distinct()
    k = F.col("file_id") % 10
    line = (
        F.when(k < 4, F.concat(F.lit("A\t"), "path"))
        .when(k < 6, F.concat(F.lit("M\t"), "path"))
        .when(k == 6, F.concat(F.lit("D\t"), "path"))
        .when(k == 7, F.concat(F.lit("R090\t"), "path", F.lit("\tdist/"), "path"))
        .when(k == 8, F.concat(F.lit("R100\told/"), "path", F.lit("\t"), "path"))
        .otherwise(F.concat(F.lit("C100\t"), "path", F.lit("\tcopy/"), "path"))
    )
    return f.select("repo", line.alias("line"))


_LINES_SQL = """lines as (select file_id % 10 as k, path, repo from (select distinct file_id, repo, path from files)),
raw as (select repo, k, case when k = 7 then 'dist/' || path else path end as path, case when k < 4 then 'A' when k < 6 then 'M' when k = 6 then 'D' when k < 9 then 'R' else 'C' end as status,
  case when k = 7 then path when k = 8 then 'old/' || path end as old_path from lines)"""
_PARSED_SQL = f"""{_LINES_SQL},
parsed as (select path, status, old_path from raw where not regexp_matches(path, '{_SKIP}')
 union all select old_path, 'D', null from raw where regexp_matches(path, '{_SKIP}') and status = 'R' and not regexp_matches(old_path, '{_SKIP}'))"""


@query(f"with {_PARSED_SQL} select path, status, old_path from parsed")
def diff_parse(spark, d):
    return changes.parse_status_lines(_status_lines(spark, d))


def _change_rows(spark, d) -> DataFrame:
    f = read_table(spark, d, "files").select("file_id", "repo", "path").distinct()
    k = F.col("file_id") % 10
    return f.select("repo", "path", F.when(k < 2, "A").when(k < 5, "M").when(k < 7, "D").otherwise("C").alias("status"), F.lit(None).cast("string").alias("old_path"))


_CHANGES_SQL = """ch as (select repo, path, case when file_id % 10 < 2 then 'A' when file_id % 10 < 5 then 'M' when file_id % 10 < 7 then 'D' else 'C' end as status from (select distinct file_id, repo, path from files)),
old as (select distinct point_id, repo, file_path, chunk_index from chunks),
gone as (select distinct repo, repo || '/' || path as file_path from ch where status <> 'C'),
neu as (select point_id, old.repo, file_path, chunk_index + 1000 as chunk_index from old semi join (select repo, repo || '/' || path as file_path from ch where status in ('A', 'M')) using (repo, file_path))"""


def _old_and_new(spark, d):
    old = read_table(spark, d, "chunks").select("point_id", "repo", "file_path", "chunk_index").distinct()
    ch = _change_rows(spark, d)
    up = changes.paths_to_upsert(ch).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
    new = old.join(up, ["repo", "file_path"], "left_semi").select("point_id", "repo", "file_path", (F.col("chunk_index") + 1000).cast("int").alias("chunk_index"))
    return old, ch, new


@query(f"""with {_CHANGES_SQL} select point_id, repo, file_path, chunk_index::INT as chunk_index from old anti join gone using (repo, file_path) where point_id not in (select point_id from neu)
union all select point_id, repo, file_path, chunk_index::INT from neu""")
def cdc_apply(spark, d):
    return changes.apply_changes(*_old_and_new(spark, d)).select("point_id", "repo", "file_path", "chunk_index")


_COUNTERS_SQL = f"""{_CHANGES_SQL},
del as (select repo, count(*) as points_deleted from old semi join gone using (repo, file_path) group by 1),
pro as (select repo, count(*) as files_processed from ch group by 1), ups as (select repo, count(*) as points_upserted from neu group by 1),
cnt as (select repo, coalesce(files_processed, 0)::BIGINT as files_processed, coalesce(points_deleted, 0)::BIGINT as points_deleted, coalesce(points_upserted, 0)::BIGINT as points_upserted
 from pro full join del using (repo) full join ups using (repo))"""


@query(f"with {_COUNTERS_SQL} select * from cnt")
def cdc_counters(spark, d):
    return changes.change_counters(*_old_and_new(spark, d))


@query(f"with {_COUNTERS_SQL} select repo, greatest(0, coalesce(total_chunks, 0) + coalesce(points_upserted, 0) - coalesce(points_deleted, 0))::BIGINT as total_chunks from repo_state full join cnt using (repo)")
def running_totals(spark, d):
    return changes.next_totals(read_table(spark, d, "repo_state"), changes.change_counters(*_old_and_new(spark, d)))


@query(f"with {_CHANGES_SQL} select repo, file_path, count(*) as n_points from old semi join gone using (repo, file_path) group by 1, 2")
def count_by_file(spark, d):
    old, ch, _ = _old_and_new(spark, d)
    keys = changes.paths_to_delete(ch).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
    return changes.count_by_file(old, keys)


@query("select point_id from (select distinct point_id, repo from points) where repo is null or repo not in ('meridian-core', 'atlas-core')")
def delete_repos(spark, d):
    p = read_table(spark, d, "points").select("point_id", "repo").distinct()
    return changes.delete_repos(p, ["meridian-core", "atlas-core"]).select("point_id")


@query("""select repo, case when last_indexed is null then 'not indexed' else 'indexed' end as status, last_commit, strftime(last_indexed, '%Y-%m-%d %H:%M:%S') as last_indexed,
 coalesce(total_chunks, 0)::BIGINT as total_chunks, coalesce(n, 0)::BIGINT as stored_points
from (select distinct repo from files where repo is not null) left join repo_state using (repo) left join (select repo, count(distinct point_id) as n from points group by 1) using (repo)""")
def index_status(spark, d):
    repos = read_table(spark, d, "files").where("repo is not null").select("repo")
    out = changes.index_status(repos, read_table(spark, d, "repo_state"), _points(spark, d))
    return out.withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


# -- usage ----------------------------------------------------------------------
def _log(spark, d) -> DataFrame:
    """Each event once: the copy that was received first."""
    rows = read_table(spark, d, "telemetry")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("received_at"))).where("_n = 1").drop("_n")


_LOG = "log as (select * from telemetry qualify row_number() over (partition by event_id order by received_at) = 1)"


@query(f"with {_LOG} select strftime(ts, '%Y-%m-%d') as day, count(*) as calls, repeat('█', least(count(*), 40)::INT) as bar from log group by 1")
def calls_by_day(spark, d):
    return usage.calls_by_day(_log(spark, d))


@query(f"with {_LOG} select count(*) as calls, count(distinct strftime(ts, '%Y-%m-%d')) as days, min(strftime(ts, '%Y-%m-%d')) as first_day, max(strftime(ts, '%Y-%m-%d')) as last_day from log where collection = 'code_chunks_atlas_core' and ts >= timestamp '2025-11-03'")
def usage_summary(spark, d):
    return usage.usage_summary(usage.select_events(_log(spark, d), "code_chunks_atlas_core", 90, NOW))


_HITS_SQL = f"""{_LOG}, h as (select ts, event_id, unnest(hits) as h, generate_subscripts(hits, 1) as pos from log),
c as (select h.id as id, count(*) as n, min(row(ts, event_id, pos)) as f, arg_min(row(h.type), row(ts, event_id, pos)) as t from h where h.id <> '' group by 1)"""


@query(f"with {_HITS_SQL} select id, n, t[1] as type from c")
def hit_counts(spark, d):
    return usage.hit_counts(_log(spark, d)).select("id", "n", "type")


@query(f"with {_HITS_SQL} select id, n, t[1] as type from c order by n desc, f[1], id limit 15")
def top_hits(spark, d):
    return usage.top_hits(_log(spark, d))


@query(f"with {_LOG} select query, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts from log where hits is null or len(hits) = 0 group by 1")
def empty_queries(spark, d):
    return usage.empty_queries(_log(spark, d)).withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss"))


@query(f"with {_LOG}, e as (select query, count(*) as n, min(ts) as f from log where hits is null or len(hits) = 0 group by 1) select query, n, strftime(f, '%Y-%m-%d %H:%M:%S') as first_ts from e order by f, query nulls first limit 10")
def empty_query_report(spark, d):
    return usage.empty_query_report(_log(spark, d)).withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss"))


_DEAD = f"""{_LOG}, idx as (select memory_id, max(memory_type) as memory_type from chunks where kind = 'memory' and memory_id <> '' group by 1),
seen as (select distinct h.id as memory_id from (select unnest(hits) as h from log where collection = 'code_chunks_atlas_core') where h.id is not null), dead as (select * from idx anti join seen using (memory_id))"""


def _own_log(spark, d) -> DataFrame:
    return usage.select_events(_log(spark, d), "code_chunks_atlas_core")


@query(f"with {_DEAD} select memory_id, memory_type from dead")
def dead_entries(spark, d):
    return usage.dead_entries(read_table(spark, d, "chunks"), _own_log(spark, d))


@query(f"with {_DEAD} select (select count(*) from dead) as dead, (select count(*) from idx) as indexed, (select count(*) from dead) > 5 as consolidate")
def dead_summary(spark, d):
    return usage.dead_summary(read_table(spark, d, "chunks"), _own_log(spark, d))


@query(rf"""with f as (select doc_id, case doc_kind when 'readme' then 'x/openspec/changes/c' || doc_id || '/LEARNINGS.md' when 'design' then 'docs/c' || doc_id || '/learnings.md' else 'openspec/changes/c' || doc_id || '/learnings.md' end as path,
  replace(text, 'cache', 'Memory impact') as source from (select distinct doc_id, doc_kind, text from documents) where text is not null),
l as (select doc_id, path, unnest(string_split(source, chr(10))) as line from f where regexp_matches(path, '(^|/)openspec/changes/.*/learnings\.md$'))
select doc_id::varchar as repo, 'c' || doc_id as change, regexp_replace(line, '{_TRIM}', '', 'g') as line from l where regexp_matches(line, '(?i)memory impact')""")
def verdict_lines(spark, d):
    """All documents as learnings files, some under names or in folders that don't count."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", "doc_kind", "text").distinct()
    name = F.concat(F.lit("c"), "doc_id", F.lit("/"))
    path = F.when(F.col("doc_kind") == "readme", F.concat(F.lit("x/openspec/changes/"), name, F.lit("LEARNINGS.md"))).when(F.col("doc_kind") == "design", F.concat(F.lit("docs/"), name, F.lit("learnings.md")))
    path = F.coalesce(path, F.concat(F.lit("openspec/changes/"), name, F.lit("learnings.md")))
    return usage.verdict_lines(docs.select(F.col("doc_id").cast("string").alias("repo"), path.alias("path"), F.replace("text", F.lit("cache"), F.lit("Memory impact")).alias("source")))


@query(f"with {{}} select repo, entries, entries >= 70 as needs_review from ent")
def memory_entry_counts(spark, d):
    return usage.entry_counts(read_table(spark, d, "files").select("file_id", "repo", "path", "source").distinct())


# -- guard ----------------------------------------------------------------------
def _hooks(spark, d) -> DataFrame:
    return _hook_rows(read_table(spark, d, "events"))


def _hook_rows(e: DataFrame) -> DataFrame:
    k = F.col("user_id") % 4
    command = (
        F.when(k == 0, F.concat(F.lit("mv openspec/changes/c"), F.col("user_id"), F.lit(" openspec/changes/archive/")))
        .when(k == 1, F.lit("openspec new change x"))
        .when(k == 2, F.lit("openspec  instructions apply"))
        .otherwise(F.lit("ls"))
    )
    first = F.col("event_id") % 2 == 0
    return e.select(
        F.expr("cast(event_id div 2 as string)").alias("call_id"),
        F.when(first, "before").otherwise("after").alias("phase"),
        F.when(F.col("event_type") == "error", "edit").otherwise("bash").alias("tool"),
        F.when(first, command).alias("command"),
        F.when(~first, F.col("event_type")).alias("output"),
        F.col("ts"),
    )


_HOOKS_SQL = """hooks as (select (event_id // 2)::varchar as call_id, event_id % 2 = 0 as first, case when event_type = 'error' then 'edit' else 'bash' end as tool, user_id, event_type, ts,
 case user_id % 4 when 0 then 'mv openspec/changes/c' || user_id || ' openspec/changes/archive/' when 1 then 'openspec new change x' when 2 then 'openspec  instructions apply' else 'ls' end as command from events),
pairs as (select b.call_id, b.command, a.event_type as output from hooks b join hooks a on a.call_id = b.call_id and b.first and not a.first and a.tool = 'bash' and b.tool = 'bash')"""


@query(f"with {_HOOKS_SQL} select * from pairs")
def hook_correlate(spark, d):
    return guard.correlate(_hooks(spark, d)).select("call_id", "command", "output")


@query(f"with {_HOOKS_SQL} select call_id, 'c' || user_id as change from hooks where first and tool = 'bash' and user_id % 4 = 0 and user_id in (select user_id from events where event_type = 'error') and user_id % 8 <> 0")
def guard_block(spark, d):
    e = read_table(spark, d, "events").where("event_type = 'error'")
    known = e.select(F.concat(F.lit("c"), F.col("user_id")).alias("change"), (F.col("user_id") % 8 == 0).alias("has_learnings")).distinct()
    return guard.blocked(_hooks(spark, d), known)


_ENTRIES_SQL = r"""mem as (select distinct file_id, repo, path, source from files where regexp_matches(path, '(^|/)openspec/memory/[^/]+\.md$') and not regexp_matches(path, '/index\.md$')),
ent as (select repo, sum(len(regexp_extract_all(regexp_replace(source, '(?s)<!--.*?-->', '', 'g'), '(?m)^## ')))::BIGINT as entries from mem group by 1)"""
_NOTE_SQL = f"""case when command like 'mv %' then case when n >= 70 then '{guard.REVIEW.split("{}")[0]}' || n || '{guard.REVIEW.split("{}")[1]}' end
 when command like '%new%' then '{guard.BEFORE_WRITING}' when command like '%apply%' then '{guard.BEFORE_APPLYING}' end"""


@query(f"with {_HOOKS_SQL}, {_ENTRIES_SQL}, t as (select coalesce(sum(entries), 0)::BIGINT as n from ent) select call_id, {_NOTE_SQL} as note, md5(output || coalesce({_NOTE_SQL}, '')) as output from pairs cross join t")
def guard_notes(spark, d):
    entries = usage.entry_counts(read_table(spark, d, "files").select("file_id", "repo", "path", "source").distinct())
    return guard.annotate(guard.correlate(_hooks(spark, d)), entries).select("call_id", "note", F.md5("output").alias("output"))


# -- streams --------------------------------------------------------------------
def _stream(spark, d, name) -> DataFrame:
    """A table as a stream of its files."""
    at = os.path.join(d, f"{name}.parquet")
    reader = spark.readStream.schema(read_table(spark, d, name).schema)
    rows = reader.parquet(at) if os.path.isdir(at) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def _run(spark, frame: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out when its input is used up."""
    folder = _scratch(spark)
    if mode == "complete":
        started = frame.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        started = frame.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
    started.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as calls, count(*) filter (hits is null or len(hits) = 0) as empty from telemetry where ts is not null group by 1")
def stream_calls(spark, d):
    out = _run(spark, live.windowed_calls(_stream(spark, d, "telemetry")), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "calls", "empty")


@query("select strftime(ts, '%Y-%m-%d') as day, id, count(*) as n from (select ts, unnest(hits).id as id from telemetry where ts is not null) where id <> '' group by 1, 2")
def stream_hits(spark, d):
    out = _run(spark, live.windowed_hits(_stream(spark, d, "telemetry")), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "id", "n")


@query(f"""with {_HOOKS_SQL} select b.call_id, b.command, a.event_type as output from hooks b join hooks a on a.call_id = b.call_id and b.first and not a.first and a.tool = 'bash' and b.tool = 'bash'
 and a.ts >= b.ts and a.ts <= b.ts + interval 1 hour""")
def stream_pairs(spark, d):
    return _run(spark, live.paired_calls(_hook_rows(_stream(spark, d, "events"))), "append").select("call_id", "command", "output")


# -- stored state -----------------------------------------------------------------
@query("""select collection, count(*) as n, sum(len(hits))::BIGINT as hits, count(*) filter (via_id) as via_id, count(*) filter (len(id_hits) > 0) as with_ids, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts,
 count(query) as queries, round(sum(hits[1].score), 4) as score from telemetry group by 1""")
def log_roundtrip(spark, d):
    """The log written as JSON lines and read again."""
    folder = _scratch(spark)
    logs.append_log(read_table(spark, d, "telemetry").drop("event_id", "received_at"), folder)
    r = logs.read_log(spark, folder)
    return r.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("hits").isNotNull(), F.size("hits"))).alias("hits"), F.count(F.when(F.col("via_id"), 1)).alias("via_id"), F.count(F.when(F.size("id_hits") > 0, 1)).alias("with_ids"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.count("query").alias("queries"), F.round(F.sum(F.get("hits", F.lit(0))["score"]), 4).alias("score"),
    )


_STORED_SQL = """all_points as (select distinct on (point_id) * from chunks order by point_id),
ch as (select repo, path, file_id % 10 as k from (select distinct file_id, repo, path from files)),
kept as (select * from all_points where repo <> 'atlas-core' and file_path not in (select repo || '/' || path from ch where k < 7)),
new as (select * replace (upper(text) as text) from all_points where file_path in (select repo || '/' || path from ch where k < 5)),
now as (select * from kept union all select * from new)"""


@query(f"with {_STORED_SQL} select repo, kind, count(*) as n, sum(length(text))::BIGINT as characters, count(*) filter (text = upper(text)) as upper from now group by 1, 2")
def store_changes(spark, d):
    """A store that is filled, loses a repository, and takes a change set."""
    store = PointStore(spark, _scratch(spark), 64)
    store.ensure()
    none = {f.name: F.lit(None).cast(f.dataType) for f in store.empty().schema.fields}
    points = distinct_by_key(read_table(spark, d, "chunks"), "point_id")
    rows = points.select(*[F.col(c) if c in points.columns else none[c].alias(c) for c in none])
    store.write(rows)
    store.delete_repo("atlas-core")
    ch = _change_rows(spark, d)
    up = changes.paths_to_upsert(ch).select("repo", paths.with_repo(F.col("repo"), F.col("path")).alias("file_path"))
    store.apply(ch, rows.join(up, ["repo", "file_path"], "left_semi").withColumn("text", F.upper("text")))
    grouped = store.read().groupBy("repo", "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"), F.count(F.when(F.col("text") == F.upper("text"), 1)).alias("upper"))


_SQL["memory_entry_counts"] = _SQL["memory_entry_counts"].format(_ENTRIES_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
