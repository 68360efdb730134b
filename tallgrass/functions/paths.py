"""Paths: skip lists, exclude globs, kinds of files and language labels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and name endings that are never indexed.
SKIPPED_DIRECTORIES = ("node_modules", ".git", "dist", "build", ".next", ".tmp", "coverage", "__tests__", "vendor", ".turbo")
SKIPPED_BY_CHUNKER_ONLY = (".cache",)
SKIPPED_ENDINGS = (r"\.min\.(js|css|mjs)", r"\.d\.ts", r"\.bundle\.(js|mjs)")

# Language label by extension of the files that are cut by lines.
LINE_LANGUAGES = {
    ".json": "json",
    ".css": "css",
    ".scss": "scss",
    ".md": "markdown",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".html": "html",
    ".svg": "svg",
}
SCRIPT_LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx"}

# Memory type by lower-cased file name.
MEMORY_TYPES = {
    "architecture.md": "architecture",
    "conventions.md": "convention",
    "pitfalls.md": "pitfall",
    "decisions.md": "decision",
    "workflows.md": "workflow",
    "learnings.md": "learning",
    "skill.md": "skill",
}


def skip_pattern(for_chunker: bool = False) -> str:
    """One alternation for the whole skip list, so that a path is matched once."""
    names = SKIPPED_DIRECTORIES + (SKIPPED_BY_CHUNKER_ONLY if for_chunker else ())
    folders = "|".join(re.escape(n) for n in names)
    return rf"(^|[/\\])({folders})[/\\]|({'|'.join(SKIPPED_ENDINGS)})\z"


def glob_pattern(glob: str) -> str:
    """Regular expression of an exclude glob.

    ``**`` crosses folders, ``*`` and ``?`` don't. A glob with a slash is anchored
    at the root, one without may begin at any folder.
    """
    text = glob.replace("\\", "/").removeprefix("./")
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(wild.get(part) or re.escape(part) for part in re.findall(r"\*\*|\*|\?|[^*?]+", text))
    return ("^" if "/" in text else "(^|/)") + body + r"\z"


def is_skipped(path: Column, excludes: Iterable[str] = (), for_chunker: bool = False) -> Column:
    """True for paths on the skip list or matched by one of the globs; a null path gives null."""
    hit = path.rlike(skip_pattern(for_chunker))
    globs = [glob_pattern(g) for g in excludes]
    if globs:
        hit = hit | F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(f"(?:{g})" for g in globs))
    return hit


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, '' where there is none. Dotfiles have none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)\z", 1)


def _labels(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def branch(path: Column) -> Column:
    """How a file is cut: memory, script, line, or null when it is not indexed."""
    ext = extension(path)
    return (
        F.when(is_memory_path(path), F.lit("memory"))
        .when(ext.isin(*SCRIPT_LANGUAGES), F.lit("script"))
        .when(ext.isin(*LINE_LANGUAGES), F.lit("line"))
    )


def language_label(path: Column) -> Column:
    """Language by extension; an unknown extension is its own label."""
    ext = extension(path)
    return F.coalesce(_labels(SCRIPT_LANGUAGES | LINE_LANGUAGES, ext), F.substring(ext, 2, 100))


def is_memory_path(path: Column) -> Column:
    """Notes, learnings and skills, but no table of contents and no scaffold skill."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.lower(base_name(path))
    return (extension(path) == ".md") & F.when(name == "index.md", F.lit(False)).when(
        name == "skill.md", ~slashed.rlike("/skills/(openspec-|opsx-)")
    ).when(name == "learnings.md", F.lit(True)).otherwise(slashed.contains("openspec/memory/"))


def memory_type(path: Column) -> Column:
    return F.coalesce(_labels(MEMORY_TYPES, F.lower(base_name(path))), F.lit("note"))


def with_repo(repo: Column, path: Column) -> Column:
    """Stored path: repository, slash, path; null if either is."""
    return F.concat(repo, F.lit("/"), path)


def point_id(repo: Column, file_path: Column, chunk_index: Column) -> Column:
    """md5 of ``repo:file_path:chunk_index`` in the shape of a UUID; ``file_path`` is the stored path."""
    digest = F.md5(F.concat(repo, F.lit(":"), file_path, F.lit(":"), chunk_index.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
