"""Tokens, term hashes, slugs and the fields of memory markdown as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the part separators and the FNV-1a constants.
TOKEN = r"[A-Za-z][A-Za-z0-9_\-.]*|[0-9]+"
PART_SEPARATOR = r"[\s_\-.]+"
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295
MAX_TERMS = 512

#: Characters that a script engine's trim() takes off; Spark's trim() only takes spaces.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where lambdas in the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more, each followed by the parts of an identifier.

    A word without inner boundaries is its own part and so is counted twice; this
    weighting is part of the feature. Null gives null, an empty text an empty array.
    """
    words = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))

    def expand(word: Column) -> Column:
        parts = F.split(F.lower(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2")), PART_SEPARATOR)
        both = F.concat(F.array(F.lower(word)), parts)
        return F.filter(both, lambda t: F.length(t) >= 2)

    return F.flatten(F.transform(words, expand))


def term_hash(term: Column) -> Column:
    """32-bit FNV-1a of an ASCII term, as a non-negative long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.ascii(F.substr(term, i, F.lit(1))).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK_32).cast("long"))
    return F.when(F.length(term) > 0, F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step)).when(
        term.isNotNull(), F.lit(FNV_OFFSET).cast("long")
    )


def slug(text: Column) -> Column:
    """Lower-cased words joined by dashes, cut to 48 characters."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, 48)


def blank_comments(text: Column) -> Column:
    """Take the characters out of ``<!-- -->`` blocks but keep their line breaks.

    The blocks are replaced one distinct block at a time, longest first, so that a
    block which is contained in another one can't break it.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(<!--[\s\S]*?-->)"), F.lit(1)))
    longest_first = F.array_sort(
        found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    )
    return F.aggregate(longest_first, text, lambda acc, m: F.replace(acc, m, F.regexp_replace(m, "[^\n]", "")))


def lines(text: Column) -> Column:
    """Lines of a text; an empty text has one empty line, a null text is null."""
    return F.split(text, "\n", -1)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start``..``end`` (1-based, inclusive); a null bound means first or last, no line gives ''."""
    all_lines = lines(text)
    size = F.size(all_lines)
    low = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    high = F.least(F.coalesce(end, size), size)
    wanted = F.slice(all_lines, low, F.greatest(high - low + 1, F.lit(0)))
    return F.when(low > high, F.when(text.isNotNull(), F.lit(""))).otherwise(F.array_join(wanted, "\n"))


# Memory headings and field labels.
HEADING = r"^##\s+(.+)\z"
HEADING_WITH_ID = r"^([A-Za-z][A-Za-z0-9_\-]{1,14}):\s+(.+)\z"
WHEN_RELEVANT = r"(?i)^(?:[-*]\s+)?(?:\*\*)?When relevant:?(?:\*\*)?:?\s*(.*)\z"
LAST_VERIFIED = r"(?i)^(?:[-*]\s+)?(?:\*\*)?Last verified:?(?:\*\*)?:?\s*(.*)\z"
EVIDENCE = r"(?i)^(?:\*\*)?Evidence[^:]*:(?:\*\*)?\s*\z"
BULLET = r"^[-*]\s+(.+)\z"
DATE = r"(\d{4}-\d{2}-\d{2})"
MEMORY_ID = r"(?<![A-Za-z0-9_])([A-Za-z]{2,5}-\d+)(?![A-Za-z0-9_])"


def heading_id(heading: Column) -> Column:
    named = F.regexp_extract(heading, HEADING_WITH_ID, 1)
    return F.when(named != "", named).otherwise(slug(strip(heading)))


def heading_title(heading: Column) -> Column:
    titled = strip(F.regexp_extract(heading, HEADING_WITH_ID, 2))
    return F.when(F.regexp_extract(heading, HEADING_WITH_ID, 1) != "", titled).otherwise(strip(heading))


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def memory_fields(body: Column) -> Column:
    """Struct of ``when_relevant``, ``evidence`` and ``last_verified`` of a memory body.

    The last non-empty value of each field wins. Evidence is the run of bullets
    after its label; blank lines inside the run are passed over and any other line
    ends it. Everything is array work on the lines of one row.
    """
    stripped = F.transform(lines(body), strip)

    def values(pattern: str) -> Column:
        texts = F.transform(stripped, lambda l: F.regexp_extract(l, pattern, 1))
        return F.filter(texts, lambda t: t != "")

    dates = F.filter(F.transform(values(LAST_VERIFIED), lambda t: F.regexp_extract(t, DATE, 1)), lambda d: d != "")

    # state: current run, best run so far, whether a run is open
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("run"), empty.alias("best"), F.lit(False).alias("open"))

    def step(state: Column, line: Column) -> Column:
        bullet = F.regexp_extract(line, BULLET, 1)
        label = line.rlike(EVIDENCE)
        adds = state["open"] & (bullet != "")
        stays = state["open"] & (line == "")
        run = F.when(label, empty).when(adds, F.concat(state["run"], F.array(strip(bullet)))).when(stays, state["run"]).otherwise(empty)
        best = F.when(adds, run).otherwise(state["best"])
        return F.struct(run.alias("run"), best.alias("best"), (label | adds | stays).alias("open"))

    best = F.aggregate(stripped, start, step)["best"]
    return F.struct(
        strip(_last(values(WHEN_RELEVANT))).alias("when_relevant"),
        F.when(F.size(best) > 0, best).alias("evidence"),
        _last(dates).alias("last_verified"),
    )


def front_matter(text: Column, key: str) -> Column:
    """Value of ``name`` or ``description`` in a leading block between ``---`` lines; the last one wins."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1)
    hits = F.regexp_extract_all(block, F.lit(rf"(?m)^{key}:[ \t]*(\S[^\n]*)$"), F.lit(1))
    return F.when(F.size(hits) > 0, strip(_last(hits)))


def mentioned_ids(text: Column) -> Column:
    """Entry ids in a query, upper-cased, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MEMORY_ID), F.lit(1)), F.upper))


def is_bare_id(text: Column) -> Column:
    """True if a query is nothing but one entry id."""
    ids = mentioned_ids(text)
    return (F.size(ids) == 1) & (F.upper(strip(text)) == F.get(ids, F.lit(0)))


def verified_date(text: Column) -> Column:
    """Date of a ``last_verified`` value; malformed and impossible dates give null."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})\z", 1), F.lit("yyyy-MM-dd")).cast("date")


def age_days(text: Column, now: Column) -> Column:
    return F.datediff(now.cast("date"), verified_date(text))


def staleness(memory_type: Column, last_verified: Column, now: Column, limit_days: int = 60) -> Column:
    """'stale', 'undated' or null. Learnings are records of one moment and never go stale."""
    age = age_days(last_verified, now)
    return F.when(memory_type.eqNullSafe(F.lit("learning")), F.lit(None)).when(age.isNull(), F.lit("undated")).when(age > limit_days, F.lit("stale"))


def collection_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]+", "_")


def replace_once(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence only; a text without it stays as it is."""
    at = F.locate(old, text)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)
