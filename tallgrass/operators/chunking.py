"""Cutting files into chunks.

Everything except the reading of script syntax is array work on the row of one
file, so that cutting needs no shuffle: a file's lines never leave its task.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass import model
from tallgrass.functions import paths, script_parser, text

MAX_LINES, OVERLAP = 100, 20
MAX_RANGE_LINES, RANGE_OVERLAP = 200, 20

_RANGE = f"array<struct<{', '.join(p.replace(' ', ': ') for p in model.RANGES.split(', '))}>>"

def _none() -> Column:
    return F.lit(None).cast("string")


def window_count(n: Column, size: int, overlap: int) -> Column:
    return F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(size - overlap))).cast("int")


def line_windows(first: Column, n: Column, size: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """Windows over ``n`` lines from line ``first`` on, as array<struct<i, start_line, end_line>>."""
    step = size - overlap
    return F.transform(
        F.sequence(F.lit(0), window_count(n, size, overlap) - 1),
        lambda i: F.struct(
            i.alias("i"),
            (first + i * step).cast("int").alias("start_line"),
            F.least(first + i * step + size - 1, first + n - 1).cast("int").alias("end_line"),
        ),
    )


def dedup_ranges(ranges: Column) -> Column:
    """Sort by span and keep one range per span: the first that has a name, else the first."""
    numbered = F.transform(ranges, lambda r, i: F.struct(r.start_line, r.end_line, r.symbol_name.isNull(), i, r.symbol_name, r.symbol_type))

    def first_of_each(ordered: Column) -> Column:
        def new_span(r: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)
            return (i == 0) | (before["start_line"] != r["start_line"]) | (before["end_line"] != r["end_line"])

        return F.filter(ordered, new_span)

    kept = text.let(F.array_sort(numbered), first_of_each)
    return F.transform(kept, lambda r: F.struct(r["start_line"], r["end_line"], r["symbol_name"], r["symbol_type"]))


def split_ranges(ranges: Column, size: int = MAX_RANGE_LINES, overlap: int = RANGE_OVERLAP) -> Column:
    """Cut long ranges into overlapping pieces; only the first piece keeps name and type."""

    def pieces(r: Column) -> Column:
        cut = line_windows(r["start_line"], r["end_line"] - r["start_line"] + 1, size, overlap)
        return F.transform(
            cut,
            lambda w: F.struct(
                w["start_line"].alias("start_line"),
                w["end_line"].alias("end_line"),
                F.when(w["i"] == 0, r["symbol_name"]).alias("symbol_name"),
                F.when(w["i"] == 0, r["symbol_type"]).alias("symbol_type"),
            ),
        )

    return F.flatten(F.transform(ranges, pieces))


# Grammar kinds that are cut out and the symbol types they get.
SYMBOL_TYPES = {
    "function_declaration": "function",
    "class_declaration": "class",
    "method_definition": "method",
    "interface_declaration": "interface",
    "type_alias_declaration": "type",
}


def symbols(source: str, types: bool, jsx: bool) -> list[tuple[int, int, str | None, str | None]]:
    """Line ranges of the declarations in a script, in document order.

    In TypeScript an exported declaration takes the span of its export statement.
    In JavaScript the export statement is a range of its own that has the name and
    type of what it exports. Top-level constants count if they hold an arrow
    function or are three lines long; nested ones never do.
    """
    found = []
    line_of = _line_index(source)
    for d in script_parser.partial(source, types, jsx):
        kind, name = d.kind, d.name
        first, last = line_of(d.start), line_of(max(d.start, d.end - 1))
        symbol_type = SYMBOL_TYPES.get(kind)
        if kind == "export_statement":
            if types:
                continue
            if d.inner is not None:
                name = d.inner.name
                symbol_type = SYMBOL_TYPES.get(d.inner.kind) or ("component" if d.inner.arrow else None)
        elif kind == "lexical_declaration":
            symbol_type = "component" if d.arrow else None
            if d.nested or symbol_type is None and last - first + 1 < 3:
                continue
        if types and d.export is not None:
            first, last = line_of(d.export.start), line_of(max(d.export.start, d.export.end - 1))
        found.append((first, last, name, symbol_type))
    return found


def _line_index(source: str):
    from bisect import bisect_right

    starts, at = [0], source.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = source.find("\n", at + 1)
    return lambda offset: bisect_right(starts, offset)


def script_ranges(source: Column | str, path: Column | str) -> Column:
    """Declarations of each script as ranges; unreadable scripts give those before the error."""
    return F.pandas_udf(_script_ranges, _RANGE)(source, path)


def _script_ranges(source: pd.Series, path: pd.Series) -> pd.Series:

    def one(text_: str | None, path_: str | None):
        if text_ is None or path_ is None:
            return None
        types = path_.endswith((".ts", ".tsx"))
        return [
            {"start_line": a, "end_line": b, "symbol_name": n, "symbol_type": t}
            for a, b, n, t in symbols(text_, types, not path_.endswith(".ts"))
        ]

    return pd.Series([one(s, p) for s, p in zip(source, path)])


def with_context(chunk_text: Column, path: Column, start: Column, end: Column, name: Column, kind: Column) -> Column:
    """Put the path, and the symbol if there is one, in comment lines before a chunk."""
    label = F.concat(
        F.lit("// "), F.coalesce(kind, F.lit("symbol")), F.lit(": "), name, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")")
    )
    return F.concat_ws("\n", F.concat(F.lit("// "), path), F.when(name != "", label), chunk_text)


def _finish(df: DataFrame) -> DataFrame:
    """Bring the columns of a branch into the order of the chunk schema."""
    types = dict(part.strip().split(" ", 1) for part in model.CHUNKS.split(", "))
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in model.CHUNK_COLUMNS])


def chunk_by_lines(files: DataFrame, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping line windows of every file. A null source gives no rows, an empty one gives one."""
    n = F.size("_lines")
    cut = files.where("source is not null and path is not null").withColumn("_lines", text.lines(F.col("source")))
    ranges = F.transform(line_windows(F.lit(1), n, size, overlap), lambda w: F.struct(w.start_line, w.end_line, _none().alias("symbol_name"), _none().alias("symbol_type")))
    return _rows(cut.withColumn("_ranges", ranges))


def _rows(df: DataFrame) -> DataFrame:
    """One row per range of ``_ranges`` with its context comment.

    The text of each range is cut out before the ranges become rows, so that no row
    carries the lines of its whole file.
    """

    def cut(r: Column) -> Column:
        body = F.array_join(F.slice("_lines", r["start_line"], r["end_line"] - r["start_line"] + 1), "\n")
        whole = with_context(body, F.col("path"), r["start_line"], r["end_line"], r["symbol_name"], r["symbol_type"])
        return F.struct(*[r[c].alias(c) for c in ("start_line", "end_line", "symbol_name", "symbol_type")], whole.alias("text"))

    cuts = F.transform("_ranges", cut)
    out = df.select("repo", "path", "commit_hash", F.size("_ranges").alias("total_chunks"), F.posexplode(cuts).alias("chunk_index", "_r"))
    return _finish(
        out.select("repo", "path", "commit_hash", "total_chunks", "chunk_index", "_r.*").withColumns(
            {"file_path": paths.with_repo(F.col("repo"), F.col("path")), "language": paths.language_label(F.col("path")), "kind": F.lit("code")}
        )
    )


def chunk_scripts(files: DataFrame) -> DataFrame:
    """Declarations of TypeScript and JavaScript files; a file without any is cut by lines unless it is blank."""
    read = files.where(F.length(text.strip(F.col("source"))) > 0).withColumn("_found", script_ranges("source", "path"))
    lines_ = text.lines(F.col("source"))
    windows = F.transform(
        line_windows(F.lit(1), F.size(lines_)), lambda w: F.struct(w.start_line.alias("start_line"), w.end_line.alias("end_line"), _none().alias("symbol_name"), _none().alias("symbol_type"))
    )
    ranges = F.when(F.size("_found") > 0, split_ranges(dedup_ranges(F.col("_found")))).otherwise(windows)
    return _rows(read.withColumn("_ranges", ranges).withColumn("_lines", lines_))


def memory_sections(source: Column) -> Column:
    """Sections of a memory file as array<struct<start_line, end_line, heading, body>>.

    Comments are blanked first, so that headings in templates don't count. What
    stands before the first heading is no section.
    """
    def sections(lines_: Column) -> Column:
        numbered = F.transform(lines_, lambda l, i: F.struct((i + 1).alias("at"), F.regexp_extract(l, text.HEADING, 1).alias("heading")))

        def cut(heads: Column) -> Column:
            def section(h: Column, i: Column) -> Column:
                end = F.coalesce(F.get(heads, i + 1)["at"] - 1, F.size(lines_))
                body = text.strip(F.array_join(F.slice(lines_, h["at"], end - h["at"] + 1), "\n"))
                return F.struct(h["at"].cast("int").alias("start_line"), end.cast("int").alias("end_line"), text.strip(h["heading"]).alias("heading"), body.alias("body"))

            return F.transform(heads, section)

        return text.let(F.filter(numbered, lambda h: h["heading"] != ""), cut)

    return text.let(text.lines(text.blank_comments(source)), sections)


def chunk_memory(files: DataFrame) -> DataFrame:
    """Chunks of memory files: one per section, but one per learnings or skill file."""
    base = files.where("source is not null").withColumn("_name", F.lower(paths.base_name(F.col("path"))))
    common = {
        "file_path": paths.with_repo(F.col("repo"), F.col("path")),
        "language": F.lit("markdown"),
        "kind": F.lit("memory"),
        "memory_type": paths.memory_type(F.col("path")),
        "symbol_name": _none(),
        "symbol_type": _none(),
    }
    sections = base.where(~F.col("_name").isin("skill.md", "learnings.md")).withColumn("_sections", memory_sections(F.col("source")))
    sections = sections.select("repo", "path", "commit_hash", F.size("_sections").alias("total_chunks"), F.posexplode("_sections").alias("chunk_index", "_s"))
    sections = sections.withColumns(
        common
        | {
            "text": F.col("_s.body"),
            "start_line": F.col("_s.start_line"),
            "end_line": F.col("_s.end_line"),
            "memory_id": text.heading_id(F.col("_s.heading")),
            "title": text.heading_title(F.col("_s.heading")),
            "_fields": text.memory_fields(F.col("_s.body")),
        }
    )
    folder = F.regexp_extract(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), r"([^/]+)/[^/]*\z", 1)
    first_heading = text.strip(F.regexp_extract("source", r"(?m)^#\s+(.+)$", 1))
    skill_name = text.front_matter(F.col("source"), "name")
    is_skill = F.col("_name") == "skill.md"
    whole = base.where(F.col("_name").isin("skill.md", "learnings.md")).withColumns(
        common
        | {
            "total_chunks": F.lit(0),
            "chunk_index": F.lit(0),
            "text": F.col("source"),
            "start_line": F.lit(1),
            "end_line": F.size(text.lines(F.col("source"))),
            "memory_id": F.when(is_skill, F.coalesce(skill_name, text.slug(paths.base_name(F.col("path"))))).otherwise(text.slug(folder)),
            "title": F.when(is_skill, F.coalesce(skill_name, paths.base_name(F.col("path"))))
            .when(first_heading != "", first_heading)
            .otherwise(F.concat(F.lit("Learnings — "), folder)),
            "_fields": text.memory_fields(F.col("source")),
        }
    )
    relevant = F.when(is_skill, F.coalesce("_fields.when_relevant", text.front_matter(F.col("source"), "description"))).otherwise(F.col("_fields.when_relevant"))
    return _finish(_unpack(sections, F.col("_fields.when_relevant"))).unionByName(_finish(_unpack(whole, relevant)))


def _unpack(df: DataFrame, when_relevant: Column) -> DataFrame:
    return df.withColumns({"when_relevant": when_relevant, "evidence": F.col("_fields.evidence"), "last_verified": F.col("_fields.last_verified")})


def chunk_files(files: DataFrame, excludes: Iterable[str] = ()) -> DataFrame:
    """Chunks of all indexable files.

    ``files`` needs ``repo, path, source, commit_hash``; further columns are
    ignored. Skipped paths, extensions that aren't indexed, null paths and null
    sources give no chunks. Rows are not deduplicated: two rows of one path give
    two sets of chunks, so the caller passes the current row of each file.
    """
    base = files.select("repo", "path", "source", "commit_hash")
    wanted = base.where(~paths.is_skipped(F.col("path"), excludes, for_chunker=True)).withColumn("_branch", paths.branch(F.col("path")))
    part = {b: wanted.where(F.col("_branch") == b).drop("_branch") for b in ("memory", "script", "line")}
    return chunk_memory(part["memory"]).unionByName(chunk_scripts(part["script"])).unionByName(chunk_by_lines(part["line"]))


def with_point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select(paths.point_id(F.col("repo"), F.col("file_path"), F.col("chunk_index")).alias("point_id"), "*")
