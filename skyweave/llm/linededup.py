"""Line dedup: shelves of sorted line hashes, answered with keep bitmaps.

A line's key is the line without blanks at its ends and with A-Z in lower case.
Only its 128-bit hash travels, with the document's handle and the line's place.
The hashes are range-partitioned and sorted by document and place, so that a
task streams the occurrences of a key in order and marks the first of each
document.  A key is common if enough documents hold it.  What comes back to a
document is no text but a bitmap, one bit a line, of which only the 64-line
words that lose a line are stored.  Everything is DataFrame functions.

A key's rows are ranged by (hash, share); a share is a bounded part of the
documents, so that a line found in every document spans many tasks.  Counts are
summed within tasks before they move.

Defined results: a null or empty text is one empty line.  Every row is a document
of its own, also one that repeats an id and a text, or has no id; rows that agree
in both get the same answer.  Keys shorter than ``min_chars`` never go.  Columns
other than the id and the text are not read.  An empty table gives no rows.  A
long text is split into lines in one row; its bitmap has a bit a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.llm.texts import id_text
from skyweave.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a bitmap with all of its lines kept.
ALL = -1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The stripped line with A-Z in lower case; other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _handle() -> Column:
    """128 bits that tell a document by its id and text."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.unhex(F.md5(named))


def sorted_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``key, share, doc_id, handle, place, first``, ranged by key and share and sorted.

    ``docs``: ``doc_id, text``.  ``first`` marks a key's first line within its document.
    """
    spark = docs.sparkSession
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select("doc_id", "text", _handle().alias("handle"))  # below the generator: once a document
    placed = named.select("doc_id", "handle", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keyed = placed.withColumn("line", line_key(F.col("line"))).filter(F.char_length("line") >= max(0, min_chars))
    rows = keyed.select(
        F.unhex(F.md5("line")).alias("key"),
        F.pmod(F.xxhash64("handle"), F.lit(shares)).cast("int").alias("share"),
        "doc_id",
        "handle",
        "place",
    )
    ranged = rows.repartitionByRange("key", "share")
    order = Window.partitionBy("key", "share", "doc_id", "handle").orderBy("place")
    return ranged.withColumn("first", F.rank().over(order) == 1)


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``key, share, n_docs, head`` of the keys in ``min_docs`` documents or more.

    ``head`` is the key's very first occurrence (document, place).  A key has a row
    for each of its shares, so that joining it to its lines meets no hot key.
    """
    whole = Window.partitionBy("key")
    return (
        lines.groupBy("key", "share")
        .agg(
            F.sum(F.col("first").cast("bigint")).alias("_n"),
            F.min(F.struct("doc_id", "handle", "place")).alias("_head"),
        )
        .withColumn("n_docs", F.sum("_n").over(whole))
        .withColumn("head", F.min("_head").over(whole))
        .filter(F.col("n_docs") >= min_docs)
        .select("key", "share", "n_docs", "head")
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``handle, words``: the keep bitmap of every document that loses a line.

    ``words`` is sorted and holds (word, bits) for each 64 lines of which some go.
    With ``keep_first`` the first occurrence of a common line stays in the corpus.
    """
    lines = cut_lineage(sorted_lines(docs, min_chars))
    common = cut_lineage(common_lines(lines, min_docs))
    lost = lines.join(common, ["key", "share"])
    if keep_first:
        lost = lost.filter(~F.struct("doc_id", "handle", "place").eqNullSafe(F.col("head")))
    masks = lost.groupBy("handle", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("_lost")
    )
    entry = F.struct(F.col("word"), F.bitwise_not("_lost").alias("bits"))
    return masks.groupBy("handle").agg(F.sort_array(F.collect_list(entry)).alias("words"))


def _dense(words: Column) -> Column:
    """The bits of all words up to the last that loses a line, gaps filled."""

    def filled(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(ALL).cast("bigint"), entry["word"] - before - 1), F.array(entry["bits"]))

    return F.flatten(F.transform(words, filled))


def lines_kept(lines: Column, bits: Column) -> Column:
    """The lines whose bit is set; words beyond ``bits`` are kept whole."""

    def kept(_: Column, i: Column) -> Column:
        word = F.coalesce(F.get(bits, (i / 64).cast("int")), F.lit(ALL).cast("bigint"))
        return F.getbit(word, i % 64) == 1

    return F.filter(lines, kept)


def deduped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, words`` of every document, without its common lines.

    ``words`` is the keep bitmap, null where nothing goes.
    """
    narrow = id_text(docs)
    maps = keep_bitmaps(narrow, min_docs, min_chars, keep_first)
    joined = narrow.withColumn("handle", _handle()).join(maps, "handle", "left")
    whole = F.coalesce("text", F.lit(""))

    def without(bits: Column) -> Column:
        gone = F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, w: n + 64 - F.bit_count(w))
        return F.struct(F.array_join(lines_kept(lines_of(whole), bits), "\n").alias("text"), gone.alias("n"))

    # The bitmap is a lambda's argument, so that it is filled once a row and not once a line.
    cut = F.transform(F.array(_dense(F.col("words"))), without)[0]
    done = joined.withColumn("_cut", F.when(F.col("words").isNotNull(), cut))
    return done.select(
        "doc_id",
        F.coalesce(F.col("_cut.text"), whole).alias("text"),
        F.size(lines_of(whole)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("_cut.n"), F.lit(0)).cast("bigint").alias("n_dropped"),
        "words",
    )


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    kept = deduped_lines(docs, min_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
