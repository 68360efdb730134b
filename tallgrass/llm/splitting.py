"""Cutting oversized texts at natural boundaries, with overlap.

One regular expression with bounded quantifiers takes a text apart. Its
alternatives are tried in the order of the strength of the boundary they end at,
each as far as the limit allows, and the last one takes any characters. The overlap
is read back from the segment before. All of it is array work on the row of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: Chunks of a file per bucket when indexes are made anew.
BUCKET = 1024


def segment_pattern(size: int) -> str:
    """Consumes up to ``size`` characters; a boundary counts if at least half of them come before it."""
    half = size // 2
    up_to = lambda tail, width: rf".{{{half},{size - width}}}{tail}"
    alternatives = [
        rf".{{1,{size}}}\z",  # the rest
        up_to(r"\n[ \t\r]{0,3}\n", 5),  # a blank line
        up_to(r"\n(?=[^\s})\]])", 1),  # a line after which a new unit begins
        up_to(r"\n", 1),
        up_to(r"[.!?;}](?=\s)", 1),  # a sentence or statement
        up_to(r"[,:)\]](?=\s)", 1),
        up_to(r"\s", 1),
        up_to(r"[,;:)\]}>]", 1),
        rf".{{1,{size}}}",
    ]
    return "(?s)(" + "|".join(alternatives) + ")"


_PIECE = "array<struct<start:int,length:int,before:int,inside:int,text:string>>"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start, length, before, inside, text>> of a text.

    ``start`` is the number of characters before the piece, ``before`` that of line
    feeds before it and ``inside`` that of line feeds in it, a last one left out. They
    are carried along, so the work is linear in the text.

    A text of at most ``limit`` characters is one piece, an empty one none, a null
    one null. No piece has more than ``limit`` characters; all but the first begin
    ``overlap`` characters, or up to a quarter less to begin at a word, before the
    end of the piece before.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    segments = F.when(F.length(text) <= limit, F.filter(F.array(text), lambda t: F.length(t) > 0)).otherwise(
        F.regexp_extract_all(text, F.lit(segment_pattern(limit - overlap)), F.lit(1))
    )
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit("").alias("tail"), F.array().cast(_PIECE).alias("out"))

    def step(s: Column, segment: Column) -> Column:
        # Up to a quarter of the overlap is given up so that the piece begins at a word.
        tail = F.regexp_replace(s["tail"], rf"(?s)\A\S{{0,{overlap // 4}}}\s(?=\S)", "")
        body = F.concat(tail, segment)
        piece = F.struct(
            (s["at"] - F.length(tail)).alias("start"),
            F.length(body).alias("length"),
            (s["line"] - _newlines(tail)).alias("before"),
            (_newlines(body) - F.when(F.endswith(body, F.lit("\n")), 1).otherwise(0)).alias("inside"),
            body.alias("text"),
        )
        kept = F.substring(segment, -overlap, overlap) if overlap else F.lit("")
        return F.struct(
            (s["at"] + F.length(segment)).alias("at"), (s["line"] + _newlines(segment)).alias("line"), kept.alias("tail"), F.concat(s["out"], F.array(piece)).alias("out")
        )

    return F.aggregate(segments, state, step, lambda s: s["out"])


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def context_lines(text: Column, file_path: Column, repo: Column, kind: Column) -> Column:
    """Number of comment lines before the code of a chunk, 0..2; memory sections have none."""
    path = F.substring(file_path, F.length(repo) + 2, F.length(file_path))
    first = F.startswith(text, F.concat(F.lit("// "), path, F.lit("\n")))
    second = F.substring_index(F.substring_index(text, "\n", 2), "\n", -1).rlike(r"^// [A-Za-z_]+: .* \(lines \d+-\d+\)\r?$")
    return F.when(kind.eqNullSafe("memory") | ~F.coalesce(first, F.lit(False)), 0).when(second, 2).otherwise(1)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The chunks that are too long, each once; of repeated rows that differ the smallest counts."""
    from tallgrass.session import distinct_by_key

    return distinct_by_key(chunks.where((F.length("text") > limit) & F.col("point_id").isNotNull()), "point_id")


#: Columns that the pieces add. Columns of the input that have these names are dropped.
ADDED = ("piece", "n_pieces", "start")
_USED = ("point_id", "repo", "file_path", "text", "start_line", "end_line", "chunk_index", "kind")


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks that are longer than ``limit``, with their lines and indexes.

    The columns are those of ``chunks``, with ``text, start_line, end_line,
    chunk_index`` of the piece, and ``piece``, ``n_pieces`` and ``start`` (characters
    before the piece). The index counts on from the chunk's own, shifted by the
    pieces that longer chunks before it in the file have added, so it is unique in a
    file whose short chunks are shifted alike (see ``reindexed``). Lines are those of
    the file: the comment lines before the code don't count, and no piece reaches beyond
    the chunk's own lines; null lines and indexes stay null. Null and short texts give no
    rows; repeated points count once.
    """
    extra = [c for c in chunks.columns if c not in _USED and c not in ADDED]
    own = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in _USED]
    packed = chunks.select(*own, F.struct(*[F.col(f"`{c}`") for c in extra] or [F.lit(None).alias("none")]).alias("_extra"))
    lead = context_lines(F.col("text"), F.col("file_path"), F.col("repo"), F.col("kind"))
    # What follows carries the pieces and no longer the text that they are cut from.
    long = oversized(packed, limit).withColumn("_pieces", pieces(F.col("text"), limit, overlap)).withColumn("_lead", lead).drop("text")
    sizes = long.select("point_id", "repo", "file_path", "chunk_index", (F.size("_pieces") - 1).alias("_more"))
    rows = long.join(index_shifts(sizes), "point_id")
    rows = rows.select("*", F.size("_pieces").alias("n_pieces"), F.posexplode("_pieces").alias("piece", "_p")).drop("_pieces")
    last = F.greatest("end_line", "start_line")
    first_line = F.least(F.greatest(F.col("start_line"), F.col("start_line") + F.col("_p.before") - F.col("_lead")), last)
    last_line = F.greatest(first_line, F.least(F.col("start_line") + F.col("_p.before") + F.col("_p.inside") - F.col("_lead"), last))
    changed = {
        "text": F.col("_p.text"),
        "start_line": first_line.cast("int"),
        "end_line": last_line.cast("int"),
        "chunk_index": (F.col("chunk_index") + F.col("_shift") + F.col("piece")).cast("int"),
    }
    kept = [c for c in chunks.columns if c not in ADDED]
    return rows.select(*[changed.get(c, F.col(c) if c in _USED else F.col("_extra")[c]).alias(c) for c in kept], "piece", "n_pieces", F.col("_p.start").alias("start"))


def reindexed(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(point_id, piece, chunk_index, total_chunks)`` of all chunks of the files that have one longer than ``limit``.

    Short chunks are one piece and move behind the pieces before them, so indexes are
    unique in a file as before; ``total_chunks`` counts the pieces. Together with
    ``split_chunks`` this replaces the chunks of such a file. Chunks of other files keep
    what they have and are not listed; repeated points count once; null indexes stay null.
    """
    from tallgrass.session import distinct_by_key

    slim = chunks.where("point_id is not null").select("point_id", "repo", "file_path", "chunk_index", F.length("text").alias("_length"), "text")
    # Only long texts are cut; of the others the length is enough.
    many = F.when(F.col("_length") > limit, F.size(pieces(F.col("text"), limit, overlap)) - 1).otherwise(0)
    sizes = distinct_by_key(slim.select("point_id", "repo", "file_path", "chunk_index", many.alias("_more")), "point_id")
    affected = sizes.where("_more > 0").select("repo", "file_path").distinct()
    on = [sizes[c].eqNullSafe(affected[c]) for c in ("repo", "file_path")]
    own = sizes.join(affected, on, "left_semi")
    totals = own.groupBy("repo", "file_path").agg(F.sum(F.col("_more") + 1).cast("bigint").alias("total_chunks"))
    shifted = own.join(index_shifts(own), "point_id")
    rows = shifted.join(totals, [shifted[c].eqNullSafe(totals[c]) for c in ("repo", "file_path")])
    rows = rows.select("point_id", "chunk_index", "_shift", "total_chunks", F.explode(F.sequence(F.lit(0), F.col("_more"))).alias("piece"))
    return rows.select("point_id", "piece", (F.col("chunk_index") + F.col("_shift") + F.col("piece")).cast("int").alias("chunk_index"), "total_chunks")


def index_shifts(sizes: DataFrame) -> DataFrame:
    """``(point_id, _shift)``: pieces added by earlier chunks of the same file.

    The running sum is made in two steps, inside buckets of ``BUCKET`` indexes and
    over the buckets, so that no task has to sort all chunks of one huge file.
    """
    w = sizes.withColumn("_bucket", F.floor(F.col("chunk_index") / BUCKET))
    totals = w.groupBy("repo", "file_path", "_bucket").agg(F.sum("_more").alias("_total"))
    before = Window.partitionBy("repo", "file_path").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("repo", "file_path", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("repo", "file_path", "_bucket").orderBy("chunk_index", "point_id").rowsBetween(Window.unboundedPreceding, -1)
    own = w.withColumn("_own", F.coalesce(F.sum("_more").over(inside), F.lit(0)))
    same = [own[c].eqNullSafe(bases[c]) for c in ("repo", "file_path", "_bucket")]
    return own.join(bases, same).select("point_id", (F.col("_base") + F.col("_own")).alias("_shift"))
