"""Source files that don't parse, and whether that is a wrong extension or corruption.

A file is parsed by the grammar of its extension and by all others, in the order in
which the file's tokens suggest their languages. If its own fails, the first one that
accepts the file tells what it really is, and if none does, the file is corrupt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import grammars

# Tokens that are typical of a language.
TYPICAL = {
    "ts": re.compile(r"\b(?:interface|readonly|enum|implements|declare|namespace|as const)\b|:\s*(?:string|number|boolean|any|void|unknown)\b|\btype\s+\w+\s*=|<[A-Z]\w*(?:,\s*\w+)*>\("),
    "tsx": re.compile(r"</[A-Za-z]|/>|\bclassName=|:\s*(?:string|number|boolean|any)\b|\buseState\b"),
    "js": re.compile(r"\b(?:const|let|var|function|return|require|module\.exports|import|export|=>|async|await)\b|=>"),
    "jsx": re.compile(r"</[A-Za-z]|/>|\bclassName=|\buseState\b|\bfunction\b"),
    "json": re.compile(r"^[ \t]*\"[^\"\n]+\"[ \t]*:", re.M),
    "css": re.compile(r"^[ \t.#a-z\-:,>*\[\]=\"]+\{[ \t]*$|^[ \t]*[a-z\-]+[ \t]*:[ \t]*[^;{}\n]+;[ \t]*$", re.M),
    "scss": re.compile(r"^[ \t]*\$[\w\-]+[ \t]*:|@(?:include|mixin|extend|use)\b|&[:.\-]", re.M),
    "yaml": re.compile(r"^[ \t]*(?:-[ \t]+)?[\w.\-]+:(?:[ \t]|$)", re.M),
    "toml": re.compile(r"^[ \t]*\[{1,2}[\w.\-\"]+\]{1,2}[ \t]*$|^[ \t]*[\w.\-]+[ \t]*=[ \t]*\S", re.M),
    "xml": re.compile(r"<\?xml|</?[A-Za-z][\w:.\-]*[^<>]*>"),
    "svg": re.compile(r"<svg\b|</?(?:path|g|rect|circle|line|polygon)\b"),
    "python": re.compile(r"^[ \t]*(?:def|class|from|import|elif|except|with)\b.*$|\bself\b|\bNone\b", re.M),
    "html": re.compile(r"(?i)<!doctype html|</?(?:html|head|body|div|p|h\d|title)\b"),
    "markdown": re.compile(r"^#{1,6}[ \t]+\S|^```|^[ \t]*[-*][ \t]+\S|\*\*[^*\n]+\*\*", re.M),
}
#: Languages whose grammar accepts any text; they are recognised by their tokens.
WITHOUT_GRAMMAR = {"html": 3, "markdown": 2}
#: Grammars that a text is tried against when its own fails.
FOREIGN = {name: parse for name, parse in grammars.GRAMMARS.items() if name != "yml"} | {"python": grammars.python_error}


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1] if "." in name else ""


def ranking(text: str) -> list[str]:
    """Languages by the number of their typical tokens per line, most likely first; those without any are last."""
    lines = max(1, text.count("\n") + 1)
    score = {name: len(pattern.findall(text)) / lines for name, pattern in TYPICAL.items()}
    return sorted(score, key=lambda name: -score[name])


#: Elements, and assertions or generic arrows, which only one of the two forms of TypeScript has.
_ELEMENT = re.compile(r"</|/>")
_ANGLE = re.compile(r"(?<![\w$)\]>\s])\s*<\s*[A-Za-z_$]")


def _included(name: str, known: dict[str, bool], text: str) -> bool | None:
    """Whether a grammar accepts a text, where that follows from what another one said; else null.

    Every JSON text is YAML; a script without elements that is valid JavaScript is valid
    TypeScript, and one without angle brackets before an operand that is valid TypeScript
    is valid with elements too. The two names of JavaScript and of YAML are one grammar each.
    """
    if name in ("js", "jsx"):
        return known.get("jsx" if name == "js" else "js")
    if name == "yaml" and known.get("json"):
        return True
    if name == "ts" and (known.get("js") or known.get("jsx")) and not _ELEMENT.search(text):
        return True
    if name == "tsx" and (known.get("js") or known.get("jsx")):
        return True
    if name == "tsx" and known.get("ts") and not _ANGLE.search(text):
        return True
    return None


def accepting(text: str, own: str) -> tuple[str | None, list[str]]:
    """The error of a text in its own grammar, and all grammars that accept it, most likely language first.

    The languages are ranked by their typical tokens, and every grammar is tried, unless
    it follows from another one's answer. Most reject a foreign text within a few lines.
    """
    error = grammars.GRAMMARS[own](text)
    own = "yaml" if own == "yml" else own
    known = {own: error is None}
    order = [name for name in ranking(text) if name in FOREIGN]
    for name in order:
        if name not in known:
            said = _included(name, known, text)
            known[name] = FOREIGN[name](text) is None if said is None else said
    return error, [name for name in order if known[name]]


def judge(path: str | None, source: str | None) -> tuple[str | None, str | None, str | None, list[str]]:
    """``(verdict, error, language, languages)``.

    The verdict is 'valid', 'wrong extension' (then with the language that the text is
    in), 'corrupt', or null for extensions without a grammar and for null sources. An
    empty text is a valid module, style sheet, YAML and TOML, but no JSON or XML.
    ``languages`` are all whose grammar accepts the text, most likely first.
    """
    own = extension(path) if path else ""
    if source is None or own not in grammars.GRAMMARS:
        return None, None, None, []
    error, languages = accepting(source, own)
    if error is None:
        return "valid", None, own, languages
    if not source.strip() or re.search(r"(?m)^(?:<{7} |>{7} |<{7}$)", source):
        return "corrupt", error, None, languages
    order = ranking(source)
    for name in order:
        if name in WITHOUT_GRAMMAR:
            found = len(TYPICAL[name].findall(source))
            if found >= WITHOUT_GRAMMAR[name] and (name == "html" or order.index(name) <= 1):
                return "wrong extension", error, name, languages
        elif name == "yaml" and source.lstrip("\ufeff \t\r\n")[:1] in ("{", "["):
            continue  # broken JSON often is a collection of YAML, but nobody means it so
        elif name in languages:
            return "wrong extension", error, name, languages
    return "corrupt", error, None, languages


def judged(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``(key, repo, path, language, verdict, error, found_language, languages)`` of every file, once.

    ``language`` is what the extension claims, ``languages`` are all that accept the file. Repeated rows of a file are collapsed
    after parsing, where a row is only a few words. Files are parsed whole.
    """
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, repo string, path string, language string, verdict string, error string, found_language string, languages array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [judge(p, s) for p, s in zip(pdf["path"], pdf["source"])]
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "repo": pdf["repo"],
                    "path": pdf["path"],
                    "language": [extension(p) if p else None for p in pdf["path"]],
                    "verdict": pd.Series([r[0] for r in rows], dtype=object, index=pdf.index),
                    "error": pd.Series([r[1] for r in rows], dtype=object, index=pdf.index),
                    "found_language": pd.Series([r[2] for r in rows], dtype=object, index=pdf.index),
                    "languages": pd.Series([r[3] for r in rows], dtype=object, index=pdf.index),
                }
            )

    rest = ["repo", "path", "language", "verdict", "error", "found_language", "languages"]
    rows = files.where(F.col(key).isNotNull()).select(key, "repo", "path", "source").mapInPandas(run, schema)
    first = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(key, *[f"r.{c}" for c in rest])


def invalid(files: DataFrame, key: str = "file_id") -> DataFrame:
    """The files that are not valid in the language of their extension."""
    return judged(files, key).where(F.col("verdict").isin("wrong extension", "corrupt"))


def rates(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``(repo, language, files, invalid, wrong_extension, share)`` over the files that have a grammar."""
    known = judged(files, key).where("verdict is not null")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = known.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), count(F.col("verdict") != "valid").alias("invalid"), count(F.col("verdict") == "wrong extension").alias("wrong_extension")
    )
    return out.withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
