"""Filling containers of fixed capacity with texts of varying length.

The plan is made over the histogram of lengths and not over texts: best fit in
decreasing length, placing all texts of a length at once. It says which ranks
within a length go to which containers; then every text takes its place by a join
on its rank.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.session import cut_lineage

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts of one length are ranked in parts of about so many, so that a frequent length is no single task.
PART = 100_000
#: The plan has fewer places than lengths and groups of containers that were opened or split for
#: them; it is refused beyond this number, which is about 100 MB.
MOST_PLACES = 2_000_000

# Fixed value: how the tokenizer's vocabulary expects a text to be cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def tokenizer(vocabulary: str = VOCABULARY):
    """The byte-level tokenizer of a file of ranks; one per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _LOADED[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def token_counts(docs: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, n_tokens)``: each text once, null and empty ones 0 tokens; null keys are dropped.

    If a key comes with different texts, the longest one counts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            # A lone surrogate can't be encoded; it counts as a replacement character.
            sizes = [len(encode(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.where(F.col(key).isNotNull()).select(key, column).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
    return counted.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places ``(length, first rank, past last rank, first container, texts of this length per container)``.

    Best fit decreasing: texts of a length go to the containers with the least room
    in which at least one fits, as many in each as fit; new containers are opened
    when there are none. Containers with equal room are kept together as ranges.
    """
    rooms: list[int] = []  # sorted, each once
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first container, how many)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if n <= 0 or room <= 0:
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((first, n))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("texts longer than the capacity must be divided first")
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, per = capacity, capacity // length
                n = -(-left // per)
                first, opened = opened, opened + n
            per = room // length
            full = min(n, left // per)  # containers that get as many as fit
            if full:
                out.append((length, rank, rank + full * per, first, per))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            if full < n and left:
                out.append((length, rank, rank + left, first + full, left))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            else:
                put(room, first + full, n - full)
    return out


def pieces(counts: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, token_from, token_to, length)``: whole texts, but those over the capacity in full pieces and a rest."""
    n = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    rows = counts.where("n_tokens > 0").select(key, "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece") * F.lit(capacity).cast("bigint")
    end = F.least(F.col("n_tokens"), start + capacity)
    return rows.select(key, "piece", start.alias("token_from"), end.alias("token_to"), (end - start).cast("int").alias("length"))


def ranked(items: DataFrame, key: str, histogram: dict[int, int], part: int = PART) -> DataFrame:
    """Add ``rank`` (from 0, without gaps) within ``length``, by parts.

    A length gets a part for each ``part`` texts that the histogram counts. Ranks inside
    a part come from a window over (length, part); what the parts before hold comes from
    a table with a row per part, which is broadcast: a row per hundred thousand
    texts, and at least one per length.
    """
    spark = items.sparkSession
    counts = spark.createDataFrame([(length, -(-n // part)) for length, n in histogram.items()], "length int, _parts int")
    parted = items.join(F.broadcast(counts), "length").withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.col("_parts")).cast("int")).drop("_parts")
    sizes = parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy(key, "piece")) - 1
    return parted.withColumn("_inside", inside).join(F.broadcast(offsets), ["length", "_part"]).withColumn("rank", F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def pack(docs: DataFrame, key: str = "doc_id", column: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, part: int = PART) -> DataFrame:
    """``(key, piece, token_from, token_to, container)``: where each text, or each piece of an oversized one, goes.

    Null and empty texts take no room and have no rows. Containers are numbered from
    0 without gaps and hold at most ``capacity`` tokens. Only the histogram (at most
    ``capacity`` rows) comes to the driver. The plan made from it is broadcast; its size
    is checked (see ``MOST_PLACES``).
    """
    items = pieces(cut_lineage(token_counts(docs, key, column, vocabulary)), key, capacity)
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan_rows = plan(histogram, capacity)
    if len(plan_rows) > MOST_PLACES:
        raise ValueError(f"the plan has {len(plan_rows)} places; choose a smaller capacity")
    places = docs.sparkSession.createDataFrame(plan_rows, "length int, first bigint, past bigint, container bigint, per bigint")
    placed = ranked(items, key, histogram, part).join(F.broadcast(places), "length").where("rank >= first and rank < past")
    return placed.select(key, "piece", "token_from", "token_to", F.expr("container + (rank - first) div per").alias("container"))
