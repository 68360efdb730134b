"""Evaluation texts inside training text, by a stored positional inverted index.

Words are the longest runs of ASCII letters and digits, without regard to case. The
index holds every word of the training text: it is made once, in segments of some
million words, and stored by the hash of the word; a posting list of a segment says
where the word stands, with the words of the segment's documents numbered through.

A search takes the runs of ``n`` words of the items. Of each run the two rarest words
are looked up, their lists are shifted by their distance in the run and intersected,
and what is left are places where the run may stand; it is then compared word by word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.session import checkpoint_dir, cut_lineage

N_WORDS = 13
#: Proximity matches are chains of shared runs of so many words, in which the places
#: in the two texts drift apart by no more than SLACK words from one to the next, and
#: which cover this share of the words on either side.
NEAR_WORDS, SLACK, NEAR_SHARE = 5, 4, 0.8
#: Words of a segment, parts of the index, and words of a block in which documents are looked up by place.
SEGMENT, BUCKETS, BLOCK = 2_000_000, 64, 4096
#: Rows that a join may broadcast, of a few dozen bytes each; beyond this number it shuffles.
BROADCAST = 500_000
#: Words between two documents of a segment that no run reaches over.
GAP = 64


def plain(text: Column) -> Column:
    """Lower-cased text. The two characters whose lower case has an ASCII letter are no words and are blanked first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit("([a-z0-9]+)"), F.lit(1))


# -- the index ----------------------------------------------------------------------
def _lists(texts: list[str], keys: list, segment: int, key: str):
    """Rows of one segment: a posting list per word, and a row per document."""
    import re

    import numpy as np
    import pyarrow as pa

    find = re.compile("[a-z0-9]+").findall
    numbers: dict[str, int] = {}
    parts, bases, sizes, at = [], [], [], 0
    for t in texts:
        found = find(t.replace("\u0130", " ").replace("\u212a", " ").lower())
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
        bases.append(at)
        sizes.append(len(found))
        at += len(found) + GAP
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    size_of, base_of = np.array(sizes, np.int64), np.array(bases, np.int64)
    first = np.cumsum(size_of) - size_of
    places = np.arange(len(ids), dtype=np.int64) + np.repeat(base_of - first, size_of)
    owner = np.repeat(np.arange(len(texts)), size_of)
    order = np.argsort(ids, kind="stable")
    ids, places, owner = ids[order], places[order], owner[order]
    starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1] if len(ids) else np.empty(0, np.int64)
    new_document = (np.r_[True, (np.diff(ids) != 0) | (np.diff(owner) != 0)] if len(ids) else np.empty(0, bool)).astype(np.int64)
    frequency = np.add.reduceat(new_document, starts) if len(ids) else np.empty(0, np.int64)
    names = np.array(list(numbers), object)
    n, m = len(names), len(texts)
    order, packed = _pack(places, starts)
    names = names[order].tolist()
    nothing = lambda kind: pa.nulls(m, kind)
    return pa.table(
        {
            "bucket": pa.array([_bucket(w) for w in names] + [-1] * m, pa.int32()),
            "segment": pa.array([segment] * (n + m), pa.int64()),
            "word": pa.array(names + [None] * m, pa.string()),
            "df": pa.chunked_array([pa.array(frequency[order].astype(np.int32)), nothing(pa.int32())]),
            "postings": pa.chunked_array([packed, nothing(pa.binary())]),
            key: pa.array([None] * n + keys),
            "base": pa.array([None] * n + bases, pa.int32()),
            "size": pa.array([None] * n + sizes, pa.int32()),
        }
    ).combine_chunks()


def _bucket(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode()) % BUCKETS


def _pack(places, starts):
    """The order in which the lists come out, and the lists as binaries.

    A list is its first place in 4 bytes and the steps to the next ones in 1, 2 or 4
    bytes each, which a byte before says.
    """
    import numpy as np
    import pyarrow as pa

    places = np.asarray(places, np.int64)
    ends = np.r_[starts[1:], len(places)].astype(np.int64) if len(starts) else np.empty(0, np.int64)
    steps = np.diff(places, prepend=0)
    steps[starts] = 0
    most = np.maximum.reduceat(steps, starts) if len(starts) else np.empty(0, np.int64)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    orders, pieces = [], []
    for w in (1, 2, 4):
        which = np.flatnonzero(width == w)
        if not len(which):
            continue
        count = (ends - starts)[which] - 1
        size = 5 + count * w
        offsets = np.r_[0, np.cumsum(size)]
        out = np.zeros(offsets[-1], np.uint8)
        out[offsets[:-1]] = w
        for k in range(4):
            out[offsets[:-1] + 1 + k] = (places[starts[which]] >> 8 * k) & 255
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        values = steps[np.repeat(starts[which] + 1, count) + inside]
        at = np.repeat(offsets[:-1] + 5, count) + inside * w
        for k in range(w):
            out[at + k] = (values >> 8 * k) & 255
        orders.append(which)
        pieces.append(pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]))
    return (np.concatenate(orders), pa.concat_arrays(pieces)) if orders else (np.empty(0, np.int64), pa.array([], pa.binary()))


def _unpack(packed: bytes):
    import numpy as np

    first = np.frombuffer(packed, np.uint32, 1, 1).astype(np.int64)
    if len(packed) == 5:
        return first
    steps = np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32}[packed[0]], -1, 5)
    return np.cumsum(np.concatenate([first, steps]), dtype=np.int64)


class Index:
    """The stored index of a collection of texts."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id") -> None:
        self.spark, self.folder, self.key = spark, folder, key

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None, key: str = "doc_id", column: str = "text", segment: int = SEGMENT) -> Index:
        """Index all words of all texts, in ``folder`` or else in a new folder beside the checkpoints.

        A task cuts its documents into segments of about ``segment`` words, so no word's
        list is ever held whole, however frequent it is; documents are not cut. The lists
        are then dealt out by the hash of their word, where parts that a frequent word
        makes large are split. Null texts and rows without a key are not indexed.
        """
        spark = docs.sparkSession
        folder = folder or os.path.join(checkpoint_dir(spark), f"postings-{uuid.uuid4().hex}")
        kind = docs.schema[key].dataType
        schema = T.StructType(
            [T.StructField("bucket", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("word", T.StringType()), T.StructField("df", T.IntegerType())]
            + [T.StructField("postings", T.BinaryType()), T.StructField(key, kind), T.StructField("base", T.IntegerType()), T.StructField("size", T.IntegerType())]
        )

        def run(batches: Iterator) -> Iterator:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            keys, texts, room = [], [], 0
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys.append(k)
                    texts.append(t)
                    room += len(t) // 4
                    if room >= segment:
                        yield from _lists(texts, keys, number, key).to_batches(20_000)
                        keys, texts, room, number = [], [], 0, number + 1
            if texts:
                yield from _lists(texts, keys, number, key).to_batches(20_000)

        rows = docs.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column).mapInArrow(run, schema)
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
        return cls(spark, folder, key)

    def _rows(self, condition: str) -> DataFrame:
        return self.spark.read.schema(f"segment bigint, word string, df int, postings binary, {self.key} {self._kind()}, base int, size int, bucket int").parquet(self.folder).where(condition)

    def _kind(self) -> str:
        return {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(self.folder).schema.fields}[self.key] if self._filled() else "bigint"

    def _filled(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return any(s.isDirectory() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))

    def documents(self) -> DataFrame:
        """``(segment, key, base, size)``: where the words of each document stand in its segment."""
        return self._rows("bucket = -1").select("segment", self.key, "base", "size")

    def lists(self) -> DataFrame:
        """``(word, segment, df, postings)``: the lists of all words; a filter or join on the word is for the caller."""
        return self._rows("bucket >= 0").select("word", "segment", "df", "postings")

    def frequency(self, wanted: DataFrame) -> DataFrame:
        """``(word, df)`` of the wanted words: the number of documents that have them. Posting lists are not read for it."""
        return self.lists().select("word", "df").join(wanted.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("df").alias("df"))

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the number of rows says that it is small; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST else df


# -- runs of words of the items --------------------------------------------------------
def item_runs(items: DataFrame, index: Index, n: int) -> DataFrame:
    """``(item_id, at, run, first, second, lead, apart)`` of every run of ``n`` words that may occur.

    ``run`` is its words with blanks between, ``first`` and ``second`` are the two that
    the fewest documents have, ``lead`` is the place of the first in the run and ``apart``
    that of the second minus that of the first. A run with a word that the corpus lacks
    is left out. Null and empty texts have none, repeated rows count once.
    """
    once = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    positions = cut_lineage(once.select("item_id", F.posexplode(words(F.col("text"))).alias("at", "word")))
    vocabulary = cut_lineage(positions.select("word").distinct())
    size = vocabulary.count()
    frequency = index.frequency(_small(vocabulary, size))
    known = positions.join(_small(frequency, size), "word", "left").select("item_id", F.struct("at", "word", F.coalesce("df", F.lit(0)).alias("df")).alias("w"))
    # An item's words are those of one text.
    packed = known.groupBy("item_id").agg(F.array_sort(F.collect_list("w")).alias("_w")).where(F.size("_w") >= n)
    windows = packed.select("item_id", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - n + 1)).alias("_from"))
    inside = windows.select("item_id", F.slice("_w", F.col("_from"), n).alias("_w")).where(F.forall("_w", lambda x: x["df"] > 0))
    rarest = F.slice(F.array_sort(F.transform("_w", lambda x: F.struct(x["df"].alias("df"), x["at"].alias("at"), x["word"].alias("word")))), 1, 2)
    rows = inside.select("item_id", F.col("_w")[0]["at"].alias("at"), F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("run"), rarest.alias("_r"))
    return rows.select(
        "item_id", "at", "run", F.col("_r")[0]["word"].alias("first"), F.col("_r")[1]["word"].alias("second"), (F.col("_r")[0]["at"] - F.col("at")).alias("lead"), (F.col("_r")[1]["at"] - F.col("_r")[0]["at"]).alias("apart")
    )


def _starts(batches: Iterator) -> Iterator:
    """Places at which a run may start, from rows of two posting lists, their distance and the leads of their runs."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        segments, found = [], []
        for segment, apart, leads, first, second in zip(*(c.to_pylist() for c in b.columns)):
            both = np.intersect1d(_unpack(first), _unpack(second) - apart, assume_unique=True)
            if len(both):
                at = (both[:, None] - np.array(leads)[None, :]).ravel()
                segments.append(np.full(len(at), segment))
                found.append(at)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(segments), pa.int64()), pa.array(np.concatenate(found), pa.int64())], names=["segment", "_at"])


def occurrences(index: Index, docs: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """``(run, doc_id, pos)``: every place at which a run stands in a document.

    Each pair of rare words at a distance is intersected once for all runs that have
    it, inside a segment. What comes out are places and not (place, run) rows, so a turn
    of phrase that many runs share costs no more than its places; which run stands there
    is told by its words. Pairs are broadcast only behind a count of them.
    """
    pairs = cut_lineage(runs.groupBy("first", "second", "apart").agg(F.collect_set("lead").alias("leads")))
    size = pairs.count()
    lists = index.lists()
    firsts = lists.join(_small(pairs.withColumnRenamed("first", "word"), size), "word").select("second", "segment", "apart", "leads", F.col("postings").alias("_a"))
    seconds = lists.join(_small(pairs.select(F.col("second").alias("word")).distinct(), size), "word", "left_semi").select(F.col("word").alias("second"), "segment", F.col("postings").alias("_b"))
    both = firsts.join(seconds, ["second", "segment"]).select("segment", "apart", "leads", "_a", "_b")
    starts = both.mapInArrow(_starts, "segment bigint, _at bigint").distinct()
    blocks = index.documents().where("size > 0").select("segment", F.col(index.key).alias("doc_id"), "base", "size", F.explode(F.sequence(F.expr(f"base div {BLOCK}"), F.expr(f"(base + size - 1) div {BLOCK}"))).alias("_block"))
    placed = starts.withColumn("_block", F.expr(f"_at div {BLOCK}")).join(blocks, ["segment", "_block"]).where(f"_at >= base and _at + {n} <= base + size")
    # The places of a document are no more than its words.
    by_doc = cut_lineage(placed.groupBy("doc_id").agg(F.collect_set((F.col("_at") - F.col("base")).cast("int")).alias("_places")))
    # Only documents with places are read again. Eight places are counted as a row.
    n_docs, n_places = by_doc.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_places")), F.lit(0))).first()
    texts = docs.select(F.col(index.key).alias("doc_id"), F.col("text").alias("_text")).join(_small(by_doc, n_docs + n_places // 8), "doc_id").select("doc_id", "_places", words(F.col("_text")).alias("_words"))
    there = F.transform("_places", lambda p: F.struct(p.alias("pos"), F.array_join(F.slice("_words", p + 1, n), " ").alias("run")))
    rows = texts.select("doc_id", F.explode(there).alias("_o")).select("_o.run", "doc_id", "_o.pos")
    return rows.join(_small(runs.select("run").distinct(), runs.count()), "run", "left_semi")


def matches(docs: DataFrame, items: DataFrame, n: int = N_WORDS, index: Index | None = None) -> DataFrame:
    """``(item_id, doc_id)``: the documents that have at least ``n`` consecutive words of an item, once each.

    Null and empty texts match nothing, nor do items of fewer than ``n`` words. An
    ``index`` of ``docs`` may be given; else one is built and removed again.
    """
    docs = docs.select("doc_id", "text")
    with _index(docs, index) as own:
        runs = cut_lineage(item_runs(items, own, n))
        found = occurrences(own, docs, runs, n)
    return found.select("run", "doc_id").distinct().join(runs.select("item_id", "run"), "run").select("item_id", "doc_id").distinct()


class _index:
    """The given index, or a new one that is removed at the end. What is read from it must be cut before that."""

    def __init__(self, docs: DataFrame, index: Index | None) -> None:
        self.docs, self.given = docs, index

    def __enter__(self) -> Index:
        self.index = self.given or Index.build(self.docs)
        return self.index

    def __exit__(self, *_) -> None:
        if self.given is None:
            self.index.remove()


def passages(docs: DataFrame, items: DataFrame, n: int = N_WORDS, index: Index | None = None, near: int = NEAR_WORDS, slack: int = SLACK, share: float = NEAR_SHARE) -> DataFrame:
    """``(item_id, doc_id, kind, item_from, item_to, doc_from, doc_to, similarity)``: the best match of each item in each document.

    ``kind`` is 'phrase' if at least ``n`` consecutive words of the item stand in the
    document, else 'proximity': a passage of at least ``n`` words of the item is there
    with changes. For that, runs of ``near`` words that both have are chained: in the
    same order, with no more than ``slack`` words left out, put in or replaced between
    one and the next. The similarity is the share of words inside such runs, of the longer one
    of the two stretches, and must reach ``share``. Items share turns of phrase; so more
    than half of a proximity match must be places of the document that no other item
    covers by a longer chain. Words count from 0, ends are included.

    Chains are made of the matches of one item in one document, so no window is larger
    than two texts allow.
    """
    docs = docs.select("doc_id", "text")
    with _index(docs, index) as own:
        runs = cut_lineage(item_runs(items, own, near))
        found = occurrences(own, docs, runs, near)
    hits = found.distinct().join(runs.select("item_id", "at", "run"), "run").select("item_id", "doc_id", "at", "pos", (F.col("pos") - F.col("at")).alias("shift"))
    # Runs in a row on one diagonal make a phrase.
    row = F.col("at") - F.row_number().over(Window.partitionBy("item_id", "doc_id", "shift").orderBy("at"))
    straight = hits.withColumn("_row", row).groupBy("item_id", "doc_id", "shift", "_row").agg(F.min("at").alias("item_from"), (F.max("at") + near - 1).alias("item_to"))
    longest = F.max(F.struct((F.col("item_to") - F.col("item_from") + 1).alias("words"), "item_from", "item_to", "shift")).alias("b")
    phrases = straight.where(F.col("item_to") - F.col("item_from") + 1 >= n).groupBy("item_id", "doc_id").agg(longest)
    phrases = phrases.select("item_id", "doc_id", F.lit("phrase").alias("kind"), "b.item_from", "b.item_to", (F.col("b.item_from") + F.col("b.shift")).alias("doc_from"), (F.col("b.item_to") + F.col("b.shift")).alias("doc_to"), F.lit(1.0).alias("similarity"))
    pair = Window.partitionBy("item_id", "doc_id")
    # A band: diagonals that are no more than ``slack`` apart.
    by_shift = pair.orderBy("shift", "at")
    wide = F.coalesce((F.col("shift") - F.lag("shift").over(by_shift) > slack).cast("int"), F.lit(0))
    banded = hits.withColumn("_wide", wide).withColumn("_band", F.sum("_wide").over(by_shift.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("item_id", "doc_id", "_band").orderBy("at", "pos")
    step = F.col("at") - F.lag("at").over(along)
    drift = F.abs(F.col("shift") - F.lag("shift").over(along))
    follows = (step > 0) & (step <= near + slack) & (drift <= slack) & (F.col("pos") > F.lag("pos").over(along))
    rows = banded.withColumns({"_new": F.coalesce((~follows).cast("int"), F.lit(1)), "_step": step})
    rows = rows.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.when(F.col("_new") == 1, near).otherwise(F.least("_step", F.lit(near)))
    # A place belongs to the items whose chains cover most; the others only share common turns of phrase with these.
    rows = rows.withColumn("_covered", F.sum(covered).over(Window.partitionBy("item_id", "doc_id", "_band", "_chain")))
    rows = rows.withColumn("_best", F.max("_covered").over(Window.partitionBy("doc_id", "pos")))
    chains = rows.groupBy("item_id", "doc_id", "_band", "_chain").agg(
        F.max("_covered").alias("_covered"), F.avg((F.col("_covered") == F.col("_best")).cast("int")).alias("_own"),
        F.min("at").alias("item_from"), (F.max("at") + near - 1).alias("item_to"), F.min("pos").alias("doc_from"), (F.max("pos") + near - 1).alias("doc_to"),
    )
    longer = F.greatest(F.col("item_to") - F.col("item_from"), F.col("doc_to") - F.col("doc_from")) + 1
    good = chains.withColumn("similarity", F.round(F.col("_covered") / longer, 4)).where((F.col("item_to") - F.col("item_from") + 1 >= n) & (F.col("similarity") >= share))
    best = good.where("_own > 0.5").groupBy("item_id", "doc_id").agg(F.max(F.struct("_covered", "similarity", "item_from", "item_to", "doc_from", "doc_to")).alias("b"))
    changed = best.join(phrases.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    return phrases.unionByName(changed.select("item_id", "doc_id", F.lit("proximity").alias("kind"), *[f"b.{c}" for c in ("item_from", "item_to", "doc_from", "doc_to", "similarity")]))
