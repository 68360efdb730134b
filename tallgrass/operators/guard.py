"""Rules over tool calls: pairing of before and after events, blocking, reminders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The commands that the rules look for.
ARCHIVE_MOVE = (
    r"""mv\s+(?:-\S+\s+)?["']?(?:\./)?openspec/changes/([A-Za-z0-9._-]+)/?["']?\s+["']?(?:\./)?openspec/changes/archive/"""
)
NEW_CHANGE = r"openspec\s+new\s+change"
APPLY_CHANGE = r"openspec\s+instructions\s+apply"


def correlate(events: DataFrame) -> DataFrame:
    """``(call_id, command, output, before_ts, after_ts)`` of calls that have both events.

    The last command of a call id counts. One aggregate instead of a self-join, so
    every event is shuffled once.
    """
    bash = events.where("tool = 'bash'")
    before = F.when(F.col("phase") == "before", F.struct("ts", "command"))
    after = F.when(F.col("phase") == "after", F.struct("ts", "output"))
    paired = bash.groupBy("call_id").agg(F.max(before).alias("b"), F.min(after).alias("a"))
    rows = paired.where("b is not null and a is not null and call_id is not null")
    return rows.select("call_id", F.col("b.command").alias("command"), F.col("a.output").alias("output"), F.col("b.ts").alias("before_ts"), F.col("a.ts").alias("after_ts"))


def archived_change(command):
    """Name of the change that a command archives, '' if it archives none."""
    return F.regexp_extract(command, ARCHIVE_MOVE, 1)


def blocked(events: DataFrame, changes: DataFrame) -> DataFrame:
    """``(call_id, change)`` of archive moves to refuse.

    ``changes`` lists ``(change, has_learnings)`` of the existing change folders. A
    move is refused if its folder exists without learnings; unknown folders pass.
    """
    moves = events.where("tool = 'bash' and phase = 'before'").select("call_id", archived_change(F.col("command")).alias("change")).where("change <> ''")
    open_changes = changes.groupBy("change").agg(F.max(F.coalesce("has_learnings", F.lit(False))).alias("_has"))
    return moves.join(open_changes.where("not _has"), "change", "left_semi").select("call_id", "change")


# What is appended to the output of a call.
REVIEW = "\n\n[memory-guard] Project memory has {} entries — retrieval precision degrades without curation. Run /memory-review to merge duplicates, refresh stale entries, and drop dead weight."
BEFORE_WRITING = (
    "\n\n[memory-guard] Before writing artifacts: call search_memory with a one-line task summary "
    "and keep the top results as a Project Context Pack (≤10 entries). If search_memory is unavailable, proceed without it."
)
BEFORE_APPLYING = (
    "\n\n[memory-guard] Before implementing: call search_memory with a one-line summary of this change "
    "(prioritize type=pitfall) and treat the hits as constraints. If search_memory is unavailable, proceed without it."
)


def annotate(calls: DataFrame, entries: DataFrame | int, threshold: int = 70) -> DataFrame:
    """Add ``note``, the text that is appended to a call's output, and append it.

    After archiving it asks for curation if there are ``threshold`` entries, with their
    number; before writing or applying it reminds of the search. ``entries`` is the number
    or a table of one row (``entries``), such as a sum of ``usage.entry_counts``. Calls
    without an output get none.
    """
    c = F.col("command")
    known = calls.crossJoin(F.broadcast(entries.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("_entries")))) if isinstance(entries, DataFrame) else calls.withColumn("_entries", F.lit(entries))  # one row
    before, after = REVIEW.split("{}")
    note = (
        F.when((archived_change(c) != "") & (F.col("_entries") >= threshold), F.concat(F.lit(before), F.col("_entries").cast("string"), F.lit(after)))
        .when(archived_change(c) != "", F.lit(None))
        .when(c.rlike(NEW_CHANGE), F.lit(BEFORE_WRITING))
        .when(c.rlike(APPLY_CHANGE), F.lit(BEFORE_APPLYING))
    )
    noted = known.withColumn("note", F.when(F.col("output").isNotNull(), note)).drop("_entries")
    return noted.withColumn("output", F.concat("output", F.coalesce("note", F.lit(""))))
