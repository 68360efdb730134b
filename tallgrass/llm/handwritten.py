"""Source files that nobody wrote by hand here: generated, minified, dumped, or copied.

Each file gets layout statistics (line lengths, shares of white space, letters and
digits, number literals, encoded runs, repeated lines, numbered declarations), which
are compared with thresholds of its kind of language; remarks at its head and its
path are further signs. In a second step, files with the same code as a copy of
third-party code elsewhere are copies too, whatever their path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What kind of layout a language has; the rest is text or configuration and is judged by path only.
SCRIPT = frozenset("ts tsx js jsx mjs cjs mts cts vue py go java rb php c h cc cpp cs rs swift kt".split())
STYLE = frozenset("css scss sass less".split())


@dataclass(frozen=True)
class Limits:
    """Thresholds of a kind of language."""

    mean_line: float  # characters of an average line that isn't blank
    long_line: int  # a line is long from here
    long_share: float  # share of the characters in long lines
    space_share: float  # minified below this share of white space, together with long lines
    number_share: float  # share of number literals among words
    encoded_share: float  # share of characters in encoded runs
    repeated_share: float  # share of lines that differ from others by literals only


LIMITS = {"script": Limits(140.0, 240, 0.65, 0.16, 0.6, 0.45, 0.8), "style": Limits(120.0, 240, 0.6, 0.10, 0.75, 0.6, 0.9)}

# Folders of third-party code, of built and of generated files, and names of such files.
FOREIGN_FOLDERS = frozenset("node_modules bower_components jspm_packages vendor third_party third-party thirdparty external externals extern site-packages".split())
BUILT_FOLDERS = frozenset("dist build out target coverage .next .nuxt .output .turbo .cache .svelte-kit bin obj htmlcov storybook-static".split())
GENERATED_FOLDERS = frozenset("__generated__ generated gen autogen auto-generated __snapshots__".split())
SOURCE_FOLDERS = frozenset("src lib app source sources test tests tools scripts pkg internal cmd".split())
LOCK_FILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml pnpm-lock.yml bun.lock composer.lock cargo.lock gemfile.lock poetry.lock pdm.lock uv.lock pipfile.lock go.sum deno.lock packages.lock.json flake.lock".split())
GENERATED_NAME = re.compile(r"(?i)(?:[._-](?:gen|generated|autogen|pb|pb2|grpc|g)\.[a-z]+|_pb2?(?:_grpc)?\.\w+|\.designer\.cs|\.snap)$")
MINIFIED_NAME = re.compile(r"(?i)(?:[.\-]min\.(?:js|css|mjs|cjs)|\.(?:bundle|chunk|umd|iife|prod)\.(?:js|mjs|cjs|css)|[.\-](?=[0-9a-f]*\d)[0-9a-f]{6,20}\.(?:js|css|mjs))$")
VERSIONED_NAME = re.compile(r"(?i)^[a-z][\w.\-]*?[-_.@]v?\d+\.\d+(?:\.\d+)?(?:[-.][\w.]+)?\.(?:js|ts|mjs|cjs|css|jsx|tsx|scss)$")
API_CLIENT = re.compile(r"(?i)(?:^|/)(?:openapi|swagger|graphql-codegen|protobuf|grpc)(?:[-_]\w+)?/(?:client|generated|models?|api|types?|src)/")

#: Remarks that say so. They count in comments at the head only, and name the whole file.
GENERATED_REMARK = re.compile(
    r"(?im)^[\s/*#;<!\-\"']*(?:"
    r".{0,60}\bcode generated\b.{0,80}|@generated\b.*|.{0,60}\bauto(?:matically|matisch)?[- ]?generated\b.{0,80}|.{0,60}\b(?:machine|tool)[- ](?:written|generated|made|produced)\b.{0,80}"
    r"|.{0,20}\b(?:this|the) (?:file|code|class|module|source|header|document) (?:is|was|has been|were) (?:auto|automatically |machine[- ])?\s?(?:generated|produced|created|written|built|emitted) (?:by|from|with|using|automatically)\b.{0,80}"
    r"|generated (?:by|from|with|using|via)\b.{0,80}|.{0,40}\bdo not (?:edit|modify|change)\b(?: (?:this file|by hand|manually|directly|it))?\s*[.!*/\-]*\s*$"
    r"|.{0,40}automatisch (?:erzeugt|generiert|erstellt).{0,80}|.{0,40}(?:généré|créé)e? automatiquement.{0,80}|.{0,40}(?:generado|creado)a? automáticamente.{0,80}"
    r"|.{0,40}(?:changes|edits|modifications) (?:to this file )?(?:will be|are|get) (?:lost|overwritten).{0,40}"
    r")$"
)
FOREIGN_REMARK = re.compile(
    r"(?im)(?:^\s*/\*!.{0,120}(?:licen[cs]e|\bv\d|\(c\)|copyright)|@licen[cs]e\b|spdx-licen[cs]e-identifier|\breleased under\b|\blicen[cs]ed under\b|\bdistributed under\b|\bunder the terms\b|\bis free software\b"
    r"|\b(?:mit|bsd|isc|apache|mozilla public|gnu (?:lesser |affero )?general public|unlicense|zlib)(?:[- ]\d[\w.\-]*)*(?:[- ]clause)? licen[cs]e\b|\bpermission is hereby granted\b|\bcopyright (?:\(c\) )?(?:\d{4}[-, \d]*)?the [\w\-]+ (?:authors|contributors)\b|\bredistribut(?:e|ion)\b)"
)
OWN_REMARK = re.compile(r"(?i)all rights reserved|proprietary|confidential|internal use only")
SOURCE_MAP = re.compile(r"(?m)^[ \t]*(?://[#@]|/\*[#@])[ \t]*sourceMappingURL=|/\*[#@][ \t]*sourceMappingURL=[^*\n]*\*/[ \t\r]*$")
HEAD = re.compile(r"(?:\s*(?://[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|;+|['\"]use \w+['\"];?))*")
COMMENTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|<!--[\s\S]*?-->")
WORD = re.compile(r"[A-Za-z_$][\w$]*|-?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)")
ENCODED_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{100,}|(?:\\x[0-9a-fA-F]{2}){12,}|(?:\\u[0-9a-fA-F]{4}){12,}|(?:0x[0-9a-fA-F]{1,8},\s*){16,}")
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\b\d[\d_.]*(?:e[+-]?\d+)?\b")
DECLARED = re.compile(r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:interface|class|type|enum|function\*?|const|let|var|message|struct|def)\s+([A-Za-z_$][\w$]*)")


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def kind_of(path: str) -> str | None:
    e = extension(path)
    return "script" if e in SCRIPT else "style" if e in STYLE else None


def path_sign(path: str) -> str | None:
    """What the path says: 'lock', 'foreign', 'built', 'generated', 'minified', or null.

    Folders of built files count only outside of source folders, as ``src/build`` is
    where people write build scripts; folders of foreign and generated files count
    anywhere, but only by their whole name.
    """
    parts = path.replace("\\", "/").split("/")
    name, folders = parts[-1], [p.lower() for p in parts[:-1]]
    if name.lower() in LOCK_FILES:
        return "lock"
    if FOREIGN_FOLDERS & set(folders):
        return "foreign"
    code = kind_of(path) is not None
    for f in folders:
        if f in SOURCE_FOLDERS:
            break
        if f in BUILT_FOLDERS:
            return "built"
    if code and (GENERATED_FOLDERS & set(folders) or GENERATED_NAME.search(name) or API_CLIENT.search(path)):
        return "generated"
    if code and MINIFIED_NAME.search(name):
        return "minified"
    if code and VERSIONED_NAME.match(name):
        return "foreign"
    return None


@dataclass
class Layout:
    """Statistics of a file's layout."""

    max_line: int
    mean_line: float
    long_share: float
    space_share: float
    letter_share: float
    number_share: float
    encoded_share: float
    repeated_share: float
    numbered_share: float
    lines: int


def layout(source: str, long_line: int) -> Layout:
    lines = [x for x in source.split("\n") if x.strip()]
    total = max(1, sum(map(len, lines)))
    long = sum(len(x) for x in lines if len(x) >= long_line)
    spaces = sum(source.count(c) for c in " \t\n\r")
    letters = sum(map(str.isalnum, source))
    words = WORD.findall(source)
    numbers = sum(1 for w in words if w[0] not in "_$" and not w[0].isalpha())
    encoded = sum(m.end() - m.start() for m in ENCODED_RUN.finditer(source) if not m.group().isalpha())
    shapes: dict[str, int] = {}
    if len(lines) >= 20:
        for x in lines:
            s = LITERAL.sub("0", x.strip())
            if len(s) > 3:
                shapes[s] = shapes.get(s, 0) + 1
    counted = sum(shapes.values())
    repeated = max(shapes.values(), default=0) / counted if counted >= 20 else 0.0
    return Layout(
        max((len(x) for x in lines), default=0), total / max(1, len(lines)), long / total, spaces / max(1, len(source)), letters / max(1, len(source)),
        numbers / max(1, len(words)) if len(words) >= 60 else 0.0, encoded / total, repeated, _numbered(source), len(lines),
    )


def _numbered(source: str) -> float:
    """Share of declarations whose names end in the numbers 0, 1, 2, ... in this order; 0 if they are fewer than four."""
    names = DECLARED.findall(source)
    if len(names) < 4:
        return 0.0
    at, seen = -1, 0
    for n in names:
        m = re.search(r"\d+$", n)
        if m and int(m.group()) in (at, at + 1) or m and at < 0 and int(m.group()) in (0, 1):
            at, seen = int(m.group()), seen + 1
    return seen / len(names) if at >= 3 or at >= 1 and seen == len(names) else 0.0


def reason(path: str | None, source: str | None) -> str | None:
    """Why a file is not hand-written, or null. Null and blank sources are judged by their path."""
    if path is None:
        return None
    sign = path_sign(path)
    if sign:
        return sign
    kind = kind_of(path)
    if kind is None or not source or not source.strip():
        return None
    head = HEAD.match(source).group()
    if GENERATED_REMARK.search(head):
        return "generated"
    if FOREIGN_REMARK.search(head) and not (OWN_REMARK.search(head) and not re.search(r"(?i)\bv?\d+\.\d+\.\d+\b|https?://|free software|spdx|released under", head)):
        return "foreign"
    limits = LIMITS[kind]
    s = layout(source, limits.long_line)
    if s.encoded_share >= limits.encoded_share:
        return "dump"
    if s.number_share >= limits.number_share:
        return "dump"
    if s.repeated_share >= limits.repeated_share:
        return "dump"
    dense = s.long_share >= limits.long_share and (s.space_share < limits.space_share or s.mean_line >= 2 * limits.mean_line)
    if s.mean_line >= limits.mean_line and s.space_share < limits.space_share + 0.04 or dense and s.lines <= 6 + s.max_line // 40 and s.mean_line >= limits.mean_line / 2:
        return "minified"
    if SOURCE_MAP.search(source):
        return "built"
    if s.numbered_share >= 0.8:
        return "generated"
    return None


def fingerprint(source: str | None) -> str | None:
    """Digest of a file's code without its head, comments and white space; null if less than 200 characters are left."""
    if not source:
        return None
    import hashlib

    code = re.sub(r"\s+", "", COMMENTS.sub("", source))
    return hashlib.md5(code.encode("utf-8", "replace")).hexdigest() if len(code) >= 200 else None


def judged(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``(key, repo, path, reason, digest)`` of each file, once; the reason is null for hand-written ones.

    Repeated rows of a file are collapsed before anything is read: the row with the
    smallest source counts. Only digests are shuffled afterwards.
    """
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, repo string, path string, reason string, digest string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons = [reason(p, s) for p, s in zip(pdf["path"], pdf["source"])]
            digests = [fingerprint(s) if p and kind_of(p) == "script" and r in (None, "foreign") else None for p, s, r in zip(pdf["path"], pdf["source"], reasons)]
            yield pd.DataFrame({key: pdf[key], "repo": pdf["repo"], "path": pdf["path"], "reason": pd.Series(reasons, dtype=object, index=pdf.index), "digest": pd.Series(digests, dtype=object, index=pdf.index)})

    rows = files.where(F.col(key).isNotNull()).select(key, "repo", "path", "source").mapInPandas(run, schema)
    first = rows.groupBy(key).agg(F.min(F.struct(F.col("reason").isNull().alias("none"), "reason", "repo", "path", "digest")).alias("r"))
    return first.select(key, "r.repo", "r.path", "r.reason", "r.digest")


def not_handwritten(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``(key, repo, path, reason)`` of the files that are generated, minified, built, dumped, locked or foreign.

    Copies of foreign code are found by digest among all files. The digests of foreign
    files are made distinct first, so a library that a third of all files copy is one
    row on its side of the join, and the other side can be split.
    """
    from tallgrass.session import cut_lineage

    all_files = cut_lineage(judged(files, key))
    foreign = all_files.where("reason = 'foreign' and digest is not null").select("digest").distinct()
    copies = all_files.where("reason is null").join(foreign, "digest", "left_semi").select(key, "repo", "path", F.lit("foreign").alias("reason"))
    return all_files.where("reason is not null").select(key, "repo", "path", "reason").unionByName(copies)
