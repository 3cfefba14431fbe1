"""SimHash near-duplicates: 64-bit fingerprints linked by pigeonring filtering.

Two fingerprints at ``max_bits`` or fewer differing bits, cut into
``max_bits + 1`` segments on a ring, have a segment from which every chain of
``l`` consecutive segments differs in at most ``l * max_bits / segments`` bits.
A chain of one segment may not differ at all, so that segment is the join key;
the longer chains prune the candidates before the full Hamming check.

A bucket of many fingerprints is not paired.  There the chain is run around the
whole ring at once: each member emits itself and its 64 variants of one flipped
bit.  Two members meet in a variant exactly when they differ in at most two
bits, a variant has at most 65 members, and the work is linear.

Null texts and texts without words have fingerprint zero and are linked like
any other.  Null ids are kept; a group of null ids only has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.graph import connected_components
from skyweave.llm.texts import id_text, map_batches, prepare, texts_of
from skyweave.session import cut_lineage

SEED = 42
BITS = 64
#: Fingerprints of a bucket that are compared pair by pair; larger buckets meet in variants.
BUCKET = 64
#: Bits of the lookup of ids that lose a row; a fuller lookup only sends more rows to the join.
LOOKUP_BITS = 1 << 24
#: Shingle hashes unpacked to bits at a time.
BLOCK = 1 << 17


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each shingle of ``width`` words (or of the whole shorter sequence)."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = ends - size
    last = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``sizes`` hashes: bits set in over half of them."""
    out = np.zeros((len(sizes), BITS), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), BLOCK):
        part, own = hashes[at : at + BLOCK], owner[at : at + BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        np.add.at(out, own[first], np.add.reduceat(bits, first, axis=0, dtype=np.int32))
    wins = (2 * out > sizes[:, None]).astype(np.uint8)
    return np.packbits(wins, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, bits`` for every row (a null text has no words)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [np.array(shingle_hashes(t, shingle), np.uint64) for t in texts_of(batch)]
        sizes = np.array([len(h) for h in each], np.int64)
        bits = majority_bits(np.concatenate(each), sizes)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"]
        )

    return map_batches(id_text(docs), run, "doc_id bigint, bits bigint")


def _segments(count: int) -> list[int]:
    """Bit masks of the ring's segments, of near equal width."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _differing(mask: Column | None = None) -> Column:
    x = F.col("a").bitwiseXOR(F.col("b"))
    return F.bit_count(x if mask is None else x.bitwiseAND(mask))


def near_links(prints: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``u, v`` whose closure joins all distinct ``bits`` within ``max_bits``.

    Buckets up to ``bucket`` give every pair in range, larger ones a star for
    each meeting variant, all of whose members are in range of each other.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("variants of one flipped bit meet at two differing bits at most")
    count = max_bits + 1
    masks = _segments(count)
    starts = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("start"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("segment"))
                for i, m in enumerate(masks)
            ]
        )
    )
    keys = ["start", "segment"]
    placed = prints.select("bits", starts.alias("s")).select("bits", "s.*")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    sized = cut_lineage(placed.join(sizes, keys))
    cold = sized.filter(F.col("n") <= bucket)
    left, right = cold.select(*keys, F.col("bits").alias("a")), cold.select(*keys, F.col("bits").alias("b"))
    viable = F.col("a") < F.col("b")
    for length in range(2, count + 1):
        chains = [_signed(sum(masks[(i + j) % count] for j in range(length))) for i in range(count)]
        chain = F.element_at(F.array(*[F.lit(c) for c in chains]), F.col("start") + 1)
        viable = viable & (_differing(chain) <= length * max_bits // count)
    viable = viable & (_differing() <= max_bits)
    pairs = left.join(right, keys).filter(viable).select(F.col("a").alias("u"), F.col("b").alias("v"))
    hot = sized.filter((F.col("n") > bucket) & F.lit(max_bits > 0)).select("bits").distinct()
    flips = [F.lit(_signed(f)).cast("bigint") for f in (0, *(1 << j for j in range(BITS)))]
    variants = hot.select("bits", F.explode(F.array(*flips)).alias("f")).select(
        "bits", F.col("bits").bitwiseXOR(F.col("f")).alias("variant")
    )
    met = variants.groupBy("variant").agg(F.collect_set("bits").alias("members")).filter("size(members) > 1")
    # At two bits every pair of a variant's members is in range, at one bit only those with the variant itself.
    centre = F.array_min("members") if max_bits == 2 else F.col("variant")
    member = F.array_contains("members", centre)
    stars = met.filter(member).select(centre.alias("u"), F.explode("members").alias("v")).filter("u != v")
    return pairs.union(stars)


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, bits, component_id`` per row; the component is its smallest doc_id."""
    prepare(docs.sparkSession)
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct, max_bits))
    placed = distinct.join(roots, F.col("bits") == F.col("node"), "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(placed.join(named, "root").select("bits", "component_id"))
    return prints.join(labels, "bits").select("doc_id", "bits", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, with the smallest ``doc_id`` of each group of near copies only.

    The groups are those of ``nearcopies``: fingerprints at few bits miss most pairs at the bound.
    Of repeated rows of that id one stays.  A group without any id keeps all of
    its rows, as nothing tells them apart.
    """
    from skyweave.llm.nearcopies import near_copy_groups

    groups = cut_lineage(near_copy_groups(docs, shingle, similarity))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    counted = groups.filter(own).groupBy("doc_id").agg(F.count("*").alias("_copies"))
    counted = cut_lineage(counted.select(F.col("doc_id").alias("_stays"), "_copies"))
    # Only ids that lose a row have to be looked up; a bitmap of fixed size tells which may.
    losing = groups.filter(~own).select("doc_id").union(counted.filter("_copies > 1").select("_stays"))
    bits = cut_lineage(
        losing.filter("doc_id IS NOT NULL")
        .select(_place("doc_id").alias("_at"))
        .groupBy(F.floor(F.col("_at") / BITS).alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % BITS).cast("int"))).alias("_bits"))
    )

    def suspected(df: DataFrame, id_col: str) -> DataFrame:
        at = df.withColumn("_at", _place(id_col))
        # At most LOOKUP_BITS / 64 rows.
        met = at.join(F.broadcast(bits), F.floor(F.col("_at") / BITS) == F.col("_word"), "left")
        bit = F.call_function("shiftright", F.col("_bits"), (F.col("_at") % BITS).cast("int")).bitwiseAND(F.lit(1))
        return met.withColumn("_suspect", F.col(id_col).isNull() | (F.coalesce(bit, F.lit(0)) == 1)).drop("_at", "_word", "_bits")

    marked = suspected(docs, "doc_id")
    sure = marked.filter(~F.col("_suspect")).drop("_suspect")
    stays = suspected(counted, "_stays").filter("_suspect").drop("_suspect")
    unsure = marked.filter("_suspect").drop("_suspect")
    kept = unsure.join(stays, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_stays")))
    if counted.filter("_copies > 1 and _stays is not null").isEmpty():
        return sure.unionByName(kept.drop("_stays", "_copies"))
    several = (F.col("_copies") > 1) & F.col("_stays").isNotNull()
    again = kept.filter(several).dropDuplicates(["_stays"])
    return sure.unionByName(kept.filter(~several).unionByName(again).drop("_stays", "_copies"))


def _place(id_col: str) -> Column:
    """Place of an id in the lookup bitmap."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(LOOKUP_BITS))
