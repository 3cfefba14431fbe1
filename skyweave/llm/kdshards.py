"""K-d tree shards: split at distributed weighted medians along the widest dimension.

A node of the tree is split until its bytes reach the target.  Each level finds,
for all of its nodes at once, the dimension with the widest spread (relative to
the whole table) and the row at which the wanted share of the bytes lies.  That
row is found by zooming: a bounded histogram of bytes per node, then a histogram
of the one bin that holds the cut, first over the dimension, then over the hash
of the text, then over the id.  Only those histograms reach the driver; their
size depends on the number of shards alone.

Equal texts are a group: they share their place (size, smallest source, smallest
language), are neighbours in every order and go to one shard.  A group at a cut
goes wholly to the nearer side.  One that is too heavy for that to be near equal
is pinned to a side, and the cut is sought again among the others, so that they
make up for it.  Only a group that is larger than a shard, or that fits into
neither side beside those pinned there, is cut by its ids.  So the law ``bytes``
holds: at each cut the sizes are off by a ``SHARE``-th of a shard or by one row.

Null text has no bytes (size 1) and is a group of its own; null metadata counts
as its own value below all others; rows with equal text and id stay in one shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.llm.texts import numbered_within, prepare
from skyweave.session import cut_lineage

#: Bins of a node's histogram.
BINS = 512
#: Order key of a null id, and the bounds of a long.
NO_ID = -(2**62)
LEAST, MOST = -(2**63), 2**63 - 1
#: A group above this part of a shard is heavy; there are at most that many a shard.
SHARE = 200


@dataclass
class Node:
    """A node of the tree, the shards it shall give, and its cut while that is sought."""

    number: int
    shards: int
    first_shard: int
    weight: int = 0
    dim: int = 0
    span: tuple[int, int] = (0, 0)
    pins: dict[int, bool] = field(default_factory=dict)
    room: list[int] = field(default_factory=list)
    goal: int = 0
    below: int = 0
    phase: int = 0
    low: int = 0
    high: int = 0
    cut: list[int] = field(default_factory=list)
    takes_equal: bool = False

    def begin(self) -> None:
        """Seek the cut (again) among the groups that are not pinned."""
        self.phase, self.below, self.cut = 0, 0, []
        self.low, self.high = self.span

    def end(self, *rest: int, takes_equal: bool) -> None:
        self.cut += rest
        self.phase, self.takes_equal = 3, takes_equal

    def met(self, group: int, weight: int, single: bool, shard: int) -> None:
        """The group at the cut: one side takes it, it is pinned, or it is cut by its ids."""
        over, under = self.below + weight - self.goal, self.goal - self.below
        if single or min(over, under) * SHARE <= shard:
            left = over <= under
            return self.end(MOST if left else LEAST, takes_equal=left)
        if weight <= shard:
            for left in (over <= under, over > under):
                if weight <= self.room[not left]:
                    self.pins[group] = left
                    self.room[not left] -= weight
                    self.goal -= weight * left
                    return self.begin()
        self.phase, self.low, self.high = 2, LEAST, MOST


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, h, id, dims``: what the tree sees of a document."""
    text = F.col("text").cast("string")
    coded = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("bigint")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.array(size, coded("source"), coded("lang")).alias("dims"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """``h, w, place``: the bytes and the place of each group of equal texts, written."""
    least = [F.min(F.col("dims")[d]) for d in range(3)]
    return cut_lineage(rows.groupBy("h").agg(F.sum("size").alias("w"), F.array(*least).alias("place")))


def _at_their_groups(rows: DataFrame, groups: DataFrame, heavy: int) -> DataFrame:
    """``rows`` with the place of their group; groups above ``heavy`` bytes are not shuffled."""
    # Fewer than all bytes over ``heavy`` of them: SHARE a shard.
    big = F.broadcast(groups.filter(F.col("w") > heavy).select("h", "place"))
    small = groups.filter(F.col("w") <= heavy).select("h", "place")
    rows = rows.drop("dims")
    parts = rows.join(big, "h").unionByName(rows.join(big.select("h"), "h", "left_anti").join(small, "h"))
    return cut_lineage(parts.withColumnRenamed("place", "dims"))


def _placed(rows: DataFrame, levels: list[list[Node]]) -> DataFrame:
    """``rows`` with the number of the node each belongs to after the cuts so far."""
    spark = rows.sparkSession
    out = rows.withColumn("node", F.lit(0).cast("bigint"))
    for nodes in levels:
        cuts = spark.createDataFrame(
            [(n.number, n.dim, *n.cut, n.takes_equal) for n in nodes],
            "node long, _dim int, _v long, _c long, _i long, _eq boolean",
        )
        value = F.element_at("dims", F.col("_dim") + 1)
        at, cut = F.struct(value, F.col("h"), F.col("id")), F.struct("_v", "_c", "_i")
        left = (at < cut) | (F.col("_eq") & (at == cut))
        pins = [(n.number, h, side) for n in nodes for h, side in n.pins.items()]
        if pins:  # heavy groups: a bounded number a shard
            out = out.join(F.broadcast(spark.createDataFrame(pins, "node long, h long, _pin boolean")), ["node", "h"], "left")
            left = F.coalesce(F.col("_pin"), left)
        child = F.when(F.col("_dim").isNull(), F.col("node")).when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        # One row per node: never more than shards.
        out = out.join(F.broadcast(cuts), "node", "left").withColumn("node", child).drop("_dim", "_v", "_c", "_i", "_eq", "_pin")
    return out


def _value(phase: int) -> Column:
    return [F.element_at("dims", F.col("_dim") + 1), F.col("h"), F.col("id")][phase]


def _zoom(rows: DataFrame, nodes: list[Node], bins: int, shard: int) -> None:
    """One histogram of every node whose cut is still open, and what follows from it."""
    spark = rows.sparkSession
    state = spark.createDataFrame(
        [(n.number, n.dim, n.phase, n.low, n.high, *(n.cut + [0, 0])[:2], list(n.pins)) for n in nodes],
        "node long, _dim int, _phase int, _low long, _high long, _v long, _c long, _pins array<long>",
    )
    value = F.when(F.col("_phase") == 0, _value(0)).when(F.col("_phase") == 1, _value(1)).otherwise(_value(2))
    inside = ((F.col("_phase") < 1) | (_value(0) == F.col("_v"))) & ((F.col("_phase") < 2) | (_value(1) == F.col("_c")))
    wide = F.expr(f"(cast(_high as decimal(20,0)) - _low) div {bins} + 1")
    step = F.expr("cast(_value as decimal(20,0)) - _low")
    found = (
        rows.join(F.broadcast(state), "node")
        .withColumn("_value", value)
        .filter(~F.array_contains("_pins", F.col("h")) & inside & F.col("_value").between(F.col("_low"), F.col("_high")))
        .withColumn("_bin", F.floor(step / wide).cast("int"))
        .groupBy("node", "_bin")
        .agg(
            F.sum("size").alias("w"),
            F.max("size").alias("top"),
            F.min("_value").alias("low"),
            F.max("_value").alias("high"),
        )
        .collect()
    )
    per: dict[int, list] = {}
    for r in found:
        per.setdefault(r.node, []).append(r)
    for n in nodes:
        if n.number not in per:  # all groups are pinned
            n.end(n.low, LEAST, LEAST, takes_equal=False)
            continue
        for r in sorted(per[n.number], key=lambda r: r._bin):
            if n.below + r.w >= n.goal:
                break
            n.below += r.w
        if r.low < r.high:
            n.low, n.high = r.low, r.high
            continue
        n.cut.append(r.low)
        if n.phase == 0:
            n.phase, n.low, n.high = 1, LEAST, MOST
        elif n.phase == 1:
            n.met(r.low, r.w, r.top == r.w, shard)
        else:
            n.end(takes_equal=n.below + r.w - n.goal <= n.goal - n.below)


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, bins: int = BINS) -> DataFrame:
    """``doc_id, size, text_crc32, shard`` for all rows.

    Either the number of ``shards`` is given or the ``target_bytes`` of a leaf.
    """
    prepare(docs.sparkSession)
    rows = cut_lineage(sized(docs))
    groups = _groups(rows)
    whole = groups.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("w"),
        *[F.max(F.col("place")[d]).alias(f"hi{d}") for d in range(3)],
        *[F.min(F.col("place")[d]).alias(f"lo{d}") for d in range(3)],
    ).first()
    if shards is None:
        shards = max(1, -(-whole.w // target_bytes)) if target_bytes else 1
    shard = -(-whole.w // shards)
    rows = _at_their_groups(rows, groups, shard // SHARE)
    spread = [max(1, (whole[f"hi{d}"] or 0) - (whole[f"lo{d}"] or 0)) for d in range(3)]
    levels: list[list[Node]] = []
    leaves: list[Node] = []
    level = [Node(0, shards, 0)]
    while level and whole.w:
        placed = _placed(rows, levels)
        ranges = placed.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(F.col("dims")[d]).alias(f"{n}{d}") for d in range(3) for n, f in (("lo", F.min), ("hi", F.max))]
        )
        known = {r.node: r for r in ranges.collect()}
        split = []
        for n in level:
            r = known.get(n.number)
            if n.shards == 1 or r is None:
                leaves.append(n)
                continue
            n.weight = r.w
            n.dim = max(range(3), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / spread[d], -d))
            n.goal = -(-n.weight * (n.shards // 2) // n.shards)
            n.span, n.room = (r[f"lo{n.dim}"], r[f"hi{n.dim}"]), [n.goal, n.weight - n.goal]
            n.begin()
            split.append(n)
        if split:
            placed = cut_lineage(placed) if len(levels) % 4 == 3 else placed
            while open_ := [n for n in split if n.phase < 3]:
                _zoom(placed, open_, bins, shard)
            levels.append(split)
        level = []
        for n in split:
            half = n.shards // 2
            level += [Node(2 * n.number + 1, half, n.first_shard), Node(2 * n.number + 2, n.shards - half, n.first_shard + half)]
    named = docs.sparkSession.createDataFrame([(n.number, n.first_shard) for n in leaves], "node long, shard int")
    return (
        _placed(rows, levels)
        .join(F.broadcast(named), "node", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("shard", F.lit(0)).alias("shard"))
    )


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: shards of near equal bytes."""
    placed = cut_lineage(kd_shards(docs, shards=shards))
    numbered = numbered_within(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
