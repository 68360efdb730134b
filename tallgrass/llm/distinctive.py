"""How distinctive each term of a record is.

A term's count in a record is compared with the count expected from the margins of
the record-by-term table. The score is the residual of correspondence analysis,
(observed - expected) / sqrt(expected), divided by sqrt((1 - row share) (1 - column
share)), which gives it unit variance under independence. Common terms come out
near 0, rare shared terms high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more than so many terms are joined by broadcast.
MOST_HOT = 400_000
HOT_AT_LEAST = 16


def counted_terms(records: DataFrame, key: str, column: str = "sparse") -> DataFrame:
    """``(key, _row, terms)``: each record once, with the total of its counts and its terms.

    ``column`` holds parallel arrays ``indices`` and ``values`` with values of
    ln(1 + count). Records with a null vector are left out; positions that only one
    array has, or whose value is null or not positive, are dropped. If a key comes
    with different vectors, the smallest one counts, so that reruns agree.
    """
    # The two arrays are shuffled as they are; pairs of them take twice the room.
    own = records.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.struct(F.col(column)["indices"].alias("i"), F.col(column)["values"].alias("v")).alias("_s"))
    once = own.groupBy(key).agg(F.min("_s").alias("_s"))
    zipped = F.arrays_zip(F.col("_s.i").alias("term"), F.col("_s.v").alias("value"))
    pairs = F.filter(zipped, lambda p: p["term"].isNotNull() & (F.coalesce(p["value"], F.lit(0.0)) > 0))
    once = once.select(key, pairs.alias("terms"))
    total = F.aggregate("terms", F.lit(0.0), lambda s, p: s + F.round(F.expm1(p["value"])))
    return once.select(key, total.alias("_row"), "terms")


def residuals(records: DataFrame, key: str, column: str = "sparse", min_value: float | None = None) -> DataFrame:
    """``(key, term, value, n, df, score)`` of every term of every record.

    ``n`` is the count, ``df`` the number of records that have the term.
    ``min_value`` leaves out terms at or below a value; margins and frequencies are
    always of all records and terms. Empty tables give no rows.
    """
    return _scored(records, key, column, min_value).select(key, "term", "value", F.col("n").cast("bigint").alias("n"), "df", "score")


def _scored(records: DataFrame, key: str, column: str, min_value: float | None) -> DataFrame:
    """The residuals with the margins that they come from: ``_row``, ``_column``, ``_all`` and ``_largest`` (the largest row).

    The frequencies are an aggregate that combines on the map side. They are joined
    to the terms in two ways: those of hot terms by broadcast, the rest by a shuffle in
    which no key is heavy. A term is hot if it is in more than a ``MOST_HOT``-th of all
    (record, term) cells, so there are fewer than ``MOST_HOT`` of them whatever the
    data, about 10 MB. All uses of the frequencies ask for the same columns, so that they
    are worked out once.
    """
    rows = counted_terms(records, key, column)
    exploded = rows.select(key, "_row", F.explode("terms").alias("_t"))
    cells = exploded.select(key, "_row", F.col("_t.term").alias("term"), F.col("_t.value").alias("value"), F.round(F.expm1("_t.value")).alias("n"))
    columns = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("_column"))
    whole = F.broadcast(rows.agg(F.sum("_row").alias("_all"), F.max("_row").alias("_largest"), F.sum(F.size("terms")).alias("_cells")))  # one row
    hot = F.col("df") > F.greatest(F.col("_cells") / MOST_HOT, F.lit(HOT_AT_LEAST))
    flagged = columns.crossJoin(whole).select("term", "df", "_column", hot.alias("_hot"))
    wanted = cells if min_value is None else cells.where(F.col("value") > min_value)
    marked = wanted.join(F.broadcast(flagged.where("_hot").drop("_hot")), "term", "left")
    heavy = marked.where("df is not null and _column is not null")
    light = marked.where("df is null and _column is null").drop("df", "_column").join(flagged.where("not _hot").drop("_hot").hint("shuffle_hash"), "term")
    both = heavy.unionByName(light).crossJoin(whole.drop("_cells"))
    return both.withColumn("score", residual(F.col("n"), F.col("_row"), F.col("_column"), F.col("_all")))


def residual(n: Column, row: Column, column: Column, total: Column) -> Column:
    """The adjusted residual of a cell; 0 where it can't vary."""
    expected = row * column / total
    spread = F.sqrt(expected * (1 - row / total) * (1 - column / total))
    return F.when(spread > 0, (n - expected) / spread).otherwise(F.lit(0.0))


def least_residual(n: Column, row: Column, total: Column, largest: Column, most: int) -> Column:
    """What a cell of count ``n`` scores at least if its term is in no more than ``most`` records.

    The other cells of the term hold at most a ``largest`` row each, which bounds the column's
    total, and the residual falls as that total grows up to half of all. A column that
    may hold more than half has no bound.
    """
    worst = n + (most - 1) * largest
    return F.when((2 * worst <= total) & (row < total), residual(n, row, worst, total)).otherwise(F.lit(float("-inf")))


def rare_repeated(records: DataFrame, key: str, column: str = "sparse", min_value: float = 1.38, least: int = 2, most: int = 5) -> DataFrame:
    """Terms that mark a record out: it repeats them, and no more than ``most`` records have them.

    They are chosen by their residuals, which must reach what such a term scores at
    least; common terms stay below that. ``least``..``most`` is then checked exactly.
    """
    scored = _scored(records, key, column, min_value)
    floor = least_residual(F.col("n"), F.col("_row"), F.col("_all"), F.col("_largest"), most)
    distinctive = scored.where(F.col("score") >= floor - 1e-9 * F.abs(floor))
    return distinctive.where(F.col("df").between(least, most)).select(key, "term", "value", F.col("n").cast("bigint").alias("n"), "df", "score")
