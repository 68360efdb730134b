"""Occurrences and records of every value or term, in a vertical layout.

Each term has a compressed bitmap of the records that contain it. As in other
compressed bitmaps, the record numbers are cut into ranges, and of each range in
which the term occurs there is a container: the 64-bit words that are not zero,
each with its place. Beside each container stands a counter of occurrences.
Bitmaps are merged by union, word by word; the cardinality of a term's bitmap is
the number of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of a container's range, as a power of 2.
RANGE = 12


def bitmaps(occurrences: DataFrame, key: str = "record", *by: str) -> DataFrame:
    """``(*by, range, words, occurrences)`` from rows ``(*by, key)``, one per occurrence.

    ``key`` is a whole number per record (negative ones too). ``words`` is the container,
    ``array<struct<word, bits>>`` in the order of ``word``. All records of a range meet
    in one task, which a shuffle of the records by range before this makes the only one:
    a range has at most 2 ** ``RANGE`` records, whatever terms they have, so no key of
    it is hot.
    """
    own = occurrences.withColumns({"_range": F.shiftright(F.col(key).cast("bigint"), RANGE), "_word": F.shiftright(F.col(key).cast("bigint"), 6).bitwiseAND(F.lit((1 << RANGE - 6) - 1)).cast("int")})
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = own.groupBy("_range", *by, "_word").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("_n"))
    return _containers(words, *by)


def _containers(words: DataFrame, *by: str) -> DataFrame:
    packed = words.groupBy("_range", *by).agg(F.array_sort(F.collect_list(F.struct(F.col("_word").alias("word"), "bits"))).alias("words"), F.sum("_n").alias("occurrences"))
    return packed.select(*by, F.col("_range").alias("range"), "words", "occurrences")


def union(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Union of the bitmaps of two sets of records, with the sums of their counters."""
    every = left.unionByName(right).select(*by, F.col("range").alias("_range"), "occurrences", F.posexplode("words").alias("_i", "_w"))
    # The counter of a container goes with its first word.
    words = every.groupBy("_range", *by, F.col("_w.word").alias("_word")).agg(F.bit_or("_w.bits").alias("bits"), F.sum(F.when(F.col("_i") == 0, F.col("occurrences")).otherwise(0)).alias("_n"))
    return _containers(words, *by)


def cardinality(words: Column) -> Column:
    """Records of a container."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w["bits"]))


def frequencies(vertical: DataFrame, *by: str) -> DataFrame:
    """``(*by, occurrences, records)`` of bitmaps; only numbers are shuffled, combined on the map side."""
    return vertical.select(*by, "occurrences", cardinality(F.col("words")).alias("_records")).groupBy(*by).agg(F.sum("occurrences").alias("occurrences"), F.sum("_records").alias("records"))


def by_range(records: DataFrame, key: str) -> DataFrame:
    """The records dealt out by the ranges of their numbers, as ``bitmaps`` needs them."""
    return records.repartition(F.shiftright(F.col(key).cast("bigint"), RANGE).alias("_range"))


def unique_events(log: DataFrame) -> DataFrame:
    """``(event_id, query, ids)``, each event once. Copies of an event that differ keep the smallest values."""
    ids = F.transform("hits", lambda h: h["id"])
    slim = log.where("event_id is not null").select("event_id", F.struct(F.col("query"), ids.alias("ids")).alias("_e"))
    return slim.groupBy("event_id").agg(F.min("_e").alias("_e")).select("event_id", "_e.query", "_e.ids")


def hit_terms(ids: Column) -> Column:
    return F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.upper(F.trim(i)))


def query_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)


def term_frequencies(log: DataFrame, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``(field, term, occurrences, records, mark)`` of all hit ids and query words of a search log.

    ``mark`` is 'rare', 'common' (in more than a share of all events) or null. Null
    ids, null queries and events without an id count for nothing; an id of blanks is
    the empty term. Where both marks hold, as in a log of a few events, 'rare' wins.
    """
    # Copies of an event are combined on the map side before the events are dealt out by range.
    events = by_range(unique_events(log), "event_id")
    fields = F.array(
        F.struct(F.lit("hits").alias("field"), hit_terms(F.col("ids")).alias("terms")), F.struct(F.lit("query").alias("field"), query_terms(F.col("query")).alias("terms"))
    )
    both = events.select("event_id", F.explode(fields).alias("_f"))
    cells = both.select(F.col("event_id").alias("record"), F.col("_f.field").alias("field"), F.explode("_f.terms").alias("term"))
    counted = frequencies(bitmaps(cells, "record", "field", "term"), "field", "term")
    total = log.where("event_id is not null").agg(F.countDistinct("event_id").alias("_all"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("_all"), "common")
    return counted.crossJoin(F.broadcast(total)).select("field", "term", "occurrences", "records", mark.alias("mark"))
