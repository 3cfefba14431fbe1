"""Groups of near copies: word shingle sets of a Jaccard similarity of at least a bound.

Candidates come from SimHash fingerprints of the sets, linked by pigeonring chains
(``simhash.near_links``), and, as those miss most pairs at the bound, from prefix
filtering, which finds every pair.  The shingles of all texts
stand in one order; two sets at the bound share one of their first
``n - ceil(bound * n) + 1`` shingles, and behind the first one they share each
has enough left to reach the bound.  Any order is right, rare shingles first is
fast: they are ordered by the count of their slot in a table of fixed size.  That
table blurs as the corpus grows, so the first shingles are taken twice: shingles
that crowd a bucket the first time are counted exactly, marked in a bitmap of fixed
size and come last the second time.  What still crowds a bucket is then most of its
texts, as in a group of copies.  Candidates are held against the whole sets.

No bucket is paired at once: all its sets are held against one of them first.  A
crowded bucket that still holds several groups meets further centres, drawn anew in
each round, until what they find tells that few candidates are left.  Then each set
outside a bucket's largest group is paired with those of other groups, so the links of
a group of copies grow with its members.  A pair whose parity sketches differ in more
bits than two sets at the bound can differ in shingles is no candidate.

Texts without words have the same, empty set.  Null ids are kept; a group of
null ids only has a null component.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.llm.graph import connected_components
from skyweave.llm.simhash import SEED, majority_bits, near_links, shingle_hashes
from skyweave.llm.texts import free_memory, id_text, prepare, texts_of
from skyweave.session import cut_lineage

#: Words of a shingle, and the similarity from which two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Sets of a bucket from which its shingle counts as crowding.
BUCKET = 64
#: Rounds of further centres at most; all pairs that these leave are found by the last join.
ROUNDS = 8
#: Centres of a crowded bucket in a round.
CENTRES = 16
#: Words of 64 bits of a set's parity sketch: bit i tells whether an odd number of its shingles fall on i.
SKETCH = 32
#: Slots of the shingle counts, as a power of two, and slots of one row of them.
SLOT_BITS, CHUNK = 20, 1 << 16
#: Bits of the lookup of sets that take part in a candidate; a fuller lookup only sends more sets to the join.
LOOKUP_BITS = 1 << 24
#: Bits of the marks of crowding shingles; a fuller bitmap only moves more shingles to the end.
MARK_BITS = 1 << 25
#: Keys that a task remembers as already sent; a forgotten one is only sent again.
REMEMBERED = 1 << 16


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Key and sorted distinct shingle hashes of each text."""
    for text in texts:
        own = np.unique(np.array(shingle_hashes(text, width), np.uint64))
        key = xxhash.xxh64_intdigest(own.tobytes(), SEED)
        yield key - (1 << 64) if key >> 63 else key, own


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles on each of the sketch's bits; two sketches differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _keys_and_counts(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, key, bits, sketch`` per row (fingerprint and sketch of its set), and how many shingles fall into each slot."""

    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        names = ["doc_id", "key", "bits", "sketch", "chunk", "counts"]
        for batch in batches:
            keys, sets, sketches = [], [], []
            for key, own in _sets(texts_of(batch), width):
                keys.append(key)
                sets.append(own)
                sketches.append(_sketch(own))
                np.add.at(counts, _slots(own), 1)
            if not keys:
                continue
            bits = majority_bits(np.concatenate(sets), np.array(list(map(len, sets)), np.int64)).view(np.int64)
            edges = np.arange(0, SKETCH * len(keys) + 1, SKETCH, dtype=np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sketches)))
            none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(bits), sketch, *none], names=names
            )
        for chunk, part in enumerate(counts.reshape(-1, CHUNK)):
            if part.any():
                # Most slots of a task are empty: compressed, a small task sends little.
                row = [[None], [None], [None], [None], [chunk], [zlib.compress(part.astype("<u8").tobytes(), 1)]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)
        free_memory()

    done = cut_lineage(docs.mapInArrow(run, "doc_id bigint, key bigint, bits bigint, sketch array<bigint>, chunk int, counts binary"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(part), "<u8").astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()])], names=["chunk", "counts"]
            )

    chunks = done.filter("chunk IS NOT NULL").select("chunk", "counts")
    total = np.zeros((1 << SLOT_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for row in chunks.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        total[row.chunk] += np.frombuffer(row.counts, np.int64)
    return done.filter("chunk IS NULL").select("doc_id", "key", "bits", "sketch"), total.ravel()


def _bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the place (value modulo ``bits``) of every value of the only column set."""
    place = F.pmod(F.col(values.columns[0]), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    words = np.zeros(bits // 64, np.int64)
    for row in values.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toLocalIterator():
        words[row.word] = row.bits
    return words.view(np.uint64)


def _marked(own: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which shingles are marked as crowding (``own`` are the hashes, the marks are by signed value)."""
    place = own & np.uint64(MARK_BITS - 1)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)


def _prefixes(docs: DataFrame, width: int, bound: Fraction, counts: np.ndarray, marks: np.ndarray | None = None) -> DataFrame:
    """``token, key, n, rest``: the first shingles of each set, its size and what follows; a written table."""
    sent = docs.sparkSession.sparkContext.broadcast((counts, marks))

    def run(batches):
        told: set[int] = set()
        for batch in batches:
            tokens, keys, sizes, rests = [], [], [], []
            for key, own in _sets(texts_of(batch), width):
                n = len(own)
                if not n or key in told:
                    continue
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add(key)
                first = n + 1 + (-bound.numerator * n) // bound.denominator
                counts, marks = sent.value
                order = [own, counts[_slots(own)]] + ([] if marks is None else [_marked(own, marks)])
                tokens.append(own[np.lexsort(order)[:first]])
                keys.append(np.full(first, key, np.int64))
                sizes.append(np.full(first, n, np.int32))
                rests.append(np.arange(n - 1, n - 1 - first, -1, dtype=np.int32))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), *map(np.concatenate, (keys, sizes, rests))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "key", "n", "rest"])

        free_memory()

    done = cut_lineage(docs.select("text").mapInArrow(run, "token bigint, key bigint, n int, rest int"))
    sent.destroy()
    return done


def _in_reach(bound: Fraction) -> Column:
    """Whether sets ``a`` and ``b`` can reach the bound if this shingle is the first they share."""
    need = F.lit(bound.numerator) * (F.col("an").cast("bigint") + F.col("bn"))
    return (F.lit(1) + F.least("arest", "brest")) * F.lit(bound.numerator + bound.denominator) >= need


def _close(bound: Fraction) -> Column:
    """Whether the sketches of sets ``a`` and ``b`` differ in no more bits than sets at the bound in shingles."""
    differ = sum((F.bit_count(F.col("asketch")[i].bitwiseXOR(F.col("bsketch")[i])) for i in range(SKETCH)), F.lit(0))
    most = F.lit(bound.denominator - bound.numerator) * (F.col("an").cast("bigint") + F.col("bn"))
    return differ * F.lit(bound.numerator + bound.denominator) <= most


def _chained(named: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of keys whose closure joins all sets with linked fingerprints."""
    sets = named.select("key", "bits").distinct()
    firsts = cut_lineage(sets.groupBy("bits").agg(F.min("key").alias("first")))
    same = sets.join(firsts, "bits").filter("key > first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    ends = [firsts.select(F.col("bits").alias(c), F.col("first").alias(f"{c}first")) for c in "uv"]
    near = near_links(firsts.select("bits")).join(ends[0], "u").join(ends[1], "v")
    return same.union(near.select(F.least("ufirst", "vfirst"), F.greatest("ufirst", "vfirst")))


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(s) for c, s in (("key", side), ("n", f"{side}n"), ("rest", f"{side}rest"), *((m, side + m) for m in more))])


def _whole_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """``key, tokens``: the whole sets of the written, distinct ``keys``; a written table."""
    lookup = _bitmap(keys, LOOKUP_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(lookup)

    def sets(batches):
        told: set[int] = set()
        for batch in batches:
            found = []
            for key, own in _sets(texts_of(batch), width):
                at = key % LOOKUP_BITS
                if int(sent.value[at >> 6]) >> (at & 63) & 1 and key not in told:
                    if len(told) >= REMEMBERED:
                        told.clear()
                    told.add(key)
                    found.append((key, own.tobytes()))
            if found:
                arrays = [pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "tokens"])
        free_memory()

    own = docs.select("text").mapInArrow(sets, "key bigint, tokens binary").join(keys, "key")
    own = cut_lineage(own.dropDuplicates(["key"]))
    sent.destroy()
    return own


def _checked(own: DataFrame, pairs: DataFrame, bound: Fraction) -> DataFrame:
    """The pairs ``a, b`` of keys whose sets in ``own`` reach the bound, as ``u, v``; a written table."""

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("at").to_pylist(), batch.column("bt").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * bound.denominator >= (len(a) + len(b) - both) * bound.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = (own.select(F.col("key").alias(s), F.col("tokens").alias(f"{s}t")) for s in "ab")
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "at", "bt").mapInArrow(check, "u bigint, v bigint"))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, bound: Fraction) -> DataFrame:
    """The written pairs ``a, b`` of keys whose whole sets reach the bound, as ``u, v``."""
    keys = cut_lineage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    return _checked(_whole_sets(docs, keys, width), pairs, bound)


def _apart(bound: Fraction) -> Column:
    """Whether sets ``a`` and ``b`` of a bucket are of different groups and may reach the bound."""
    return (F.col("aroot") != F.col("broot")) & _in_reach(bound) & _close(bound)


def _torn(placed: DataFrame) -> DataFrame:
    """The buckets that hold several groups: ``token``, its sets ``m`` and the group ``major`` of most of them."""
    groups = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    major = F.max(F.struct("c", "root"))["root"]
    return groups.groupBy("token").agg(F.sum("c").alias("m"), major.alias("major"), F.count("*").alias("k")).filter("k > 1").drop("k")


def _more_centres(docs: DataFrame, placed: DataFrame, width: int, bound: Fraction, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """``placed`` with the groups that further centres of crowded buckets join, and the links they found.

    A bucket of m sets and E pairs that pass the filters shows 2 E / m of them to a
    centre drawn at random, so the rows of a round, each counted m / 2 / ``CENTRES``
    times, tell how many the last join would make.
    """
    links, own = None, None
    for turn in range(ROUNDS):
        crowded = placed.join(_torn(placed).filter(F.col("m") > bucket).select("token", "m"), "token")
        crowded = cut_lineage(crowded)
        draw = Window.partitionBy("token").orderBy(F.xxhash64("key", "token", F.lit(turn)))
        drawn = crowded.withColumn("draw", F.row_number().over(draw)).filter(F.col("draw") <= CENTRES)
        centre = _side(drawn, "a", "root", "sketch")
        met = centre.join(_side(crowded, "b", "root", "sketch", "m"), "token").filter(_apart(bound))
        met = cut_lineage(met.select("a", "b", "aroot", "broot", "bm"))
        left = met.agg(F.coalesce(F.sum("bm"), F.lit(0)).alias("s")).first().s / 2 / CENTRES
        if left <= crowded.count() / 4:
            break
        if own is None:
            own = _whole_sets(docs, cut_lineage(crowded.select("key").distinct()), width)
        found = _checked(own, met.select("a", "b").distinct(), bound)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        joined = met.join(found, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v")))
        roots = connected_components(joined.select(F.col("aroot").alias("u"), F.col("broot").alias("v")).distinct())
        moved = placed.join(roots.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left")
        placed = cut_lineage(moved.select("token", "key", "n", "rest", F.coalesce("to", "root").alias("root"), "sketch"))
    return placed, links


def near_copy_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket: int = BUCKET
) -> DataFrame:
    """``doc_id, component_id`` per row; the component is its smallest doc_id."""
    prepare(docs.sparkSession)
    bound, texts = Fraction(str(similarity)), id_text(docs)
    if not 0 < bound <= 1:
        raise ValueError("a similarity lies above 0 and is at most 1")
    named, counts = _keys_and_counts(texts, shingle)
    prefixes = _prefixes(texts, shingle, bound, counts)
    # Copies of a text may count more than once: that marks more shingles, and any order is right.
    crowding = prefixes.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > bucket)
    crowding = cut_lineage(crowding.select("token"))
    if not crowding.isEmpty():
        prefixes = _prefixes(texts, shingle, bound, counts, _bitmap(crowding, MARK_BITS))
    shared = prefixes.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    rows = cut_lineage(prefixes.join(shared.select("token", "low"), "token").distinct())
    centre = _side(rows.filter("key = low"), "a").join(_side(rows.filter("key > low"), "b"), "token").filter(_in_reach(bound))
    chained = _chained(named)
    links = _verified(texts, cut_lineage(centre.select("a", "b").union(chained).distinct()), shingle, bound)
    roots = connected_components(links)
    # Sets of a bucket that are in one group by now need not meet, nor those that met its centre.
    placed = rows.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    rest = placed.filter("key > low").groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"))
    placed = placed.filter("key > low").join(rest.filter("r < s").select("token"), "token")
    sketches = named.select("key", "sketch").dropDuplicates(["key"])
    placed = cut_lineage(placed.select("token", "key", "n", "rest", "root").join(sketches, "key"))
    if not placed.isEmpty():
        placed, found = _more_centres(texts, placed, shingle, bound, bucket)
        links = links if found is None else links.union(found)
        placed = cut_lineage(placed.join(_torn(placed), "token"))
        # Of two sets, that outside the largest group of the bucket is on the left.
        left = _side(placed.filter("root != major"), "a", "root", "sketch")
        right = _side(placed, "b", "root", "sketch", "major")
        once = (F.col("broot") == F.col("bmajor")) | (F.col("a") < F.col("b"))
        more = left.join(right, "token").filter(once & _apart(bound))
        more = cut_lineage(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = links if more.isEmpty() else links.union(_verified(texts, more, shingle, bound))
        roots = connected_components(links)
    least = named.groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = cut_lineage(least)
    labels = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(least.join(labels, "root").select("key", "component_id"))
    return named.join(labels, "key").select("doc_id", "component_id")
