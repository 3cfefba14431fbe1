"""Exact order statistics by radix selection.

A pass counts the values of each group into bins that rise with the value and
keeps count, least and largest value of each; Spark combines the counts before
they move.  A wanted rank falls into one bin.  If it is that bin's first or last
value, or all of the bin's values are equal, it is found; otherwise the bin is
open, and the next pass reads only values between its ends, in finer bins.  The
first bins are those of the leading bits of a floating-point number (sign,
exponent and the first bits of the fraction), so a far outlier costs nothing; later
bins divide the open range evenly.  Two or three passes find every rank.  Nothing
is sorted, sampled or written but counts, and a group of any size is only counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.shelves import join_null_safe
from skyweave.session import cut_lineage

#: Bins of a power of two in the first pass, and bins of an open range in later ones.
PER_OCTAVE, BINS = 8, 4096
#: Above the number of the lowest bin of positive values.
_OFFSET = 1200 * PER_OCTAVE


def leading_bits(v: Column) -> Column:
    """A whole number that rises with ``v``: sign, exponent and leading bits."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * PER_OCTAVE) + _OFFSET
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)


def even_bins(v: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that holds ``v``; the largest value has a bin of its own."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    part = F.least(F.floor(F.nanvl(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
    return F.when(v == high, F.lit(BINS).cast("bigint")).otherwise(part)


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group and bin: ``_n, _lo, _hi``, and ``_before``, the values in lower bins."""
    bins = rows.groupBy(*by, "_bin").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_bin")))
    return bins.withColumn("_before", upto - F.col("_n"))


#: What is known of a percentile between passes: its two neighbouring values once found (``_v0, _v1``),
#: the share of the way from one to the other, and for what is open the range and the ranks inside it.
_KNOWN = ["_part", "_v0", "_v1", "_r0", "_r1", "_from", "_to"]


def _narrowed(bins: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of ``by`` (which holds ``_slot, _part, _v0, _v1, _r0, _r1``) after a pass."""
    here = {e: (F.col("_before") <= F.col(f"_r{e}")) & (F.col(f"_r{e}") < F.col("_before") + F.col("_n")) for e in (0, 1)}
    seen = []
    for e, inside in here.items():
        rank = F.col(f"_r{e}") - F.col("_before")
        last = (rank == F.col("_n") - 1) | (F.col("_lo") == F.col("_hi"))
        found = F.when(rank == 0, F.col("_lo")).when(last, F.col("_hi"))
        seen.append(F.max(F.when(inside, found)).alias(f"_f{e}"))
        seen += [F.max(F.when(inside, F.col(c))).alias(f"{c}{e}") for c in ("_before", "_lo", "_hi")]
    whole = bins.filter(here[0] | here[1] | F.col("_r0").isNull()).groupBy(*by).agg(*seen)
    keep = [c for c in by if c not in _KNOWN]
    done = whole.withColumns({f"_w{e}": F.coalesce(f"_v{e}", f"_f{e}") for e in (0, 1)})
    # Two open neighbours lie in neighbouring bins, or in one: nothing else lies between.
    first, second = F.col("_w0").isNull(), F.col("_w1").isNull()
    base = F.when(first, F.col("_before0")).otherwise(F.col("_before1"))
    return done.select(
        *keep,
        "_part",
        F.col("_w0").alias("_v0"),
        F.col("_w1").alias("_v1"),
        (F.col("_r0") - base).alias("_r0"),
        (F.col("_r1") - base).alias("_r1"),
        F.when(first, F.col("_lo0")).when(second, F.col("_lo1")).alias("_from"),
        F.when(second, F.col("_hi1")).when(first, F.col("_hi0")).alias("_to"),
    )


def _open() -> Column:
    return F.col("_from").isNotNull()


def selected(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``keys`` and, for each output of ``wanted`` (column, p), the percentile by linear interpolation.

    Groups without any value keep their row; NULL and NaN are no values; a NULL
    key is a group like others.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    by = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k0")]
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(columns)]
    wide = df.select(*named, *numbers)
    slots = [columns.index(c) for c, _ in wanted.values()]

    long = wide.unpivot(by, [f"_c{i}" for i in range(len(columns))], "_col", "_v")
    bins = _counted(long.withColumn("_bin", leading_bits(F.col("_v"))), [*by, "_col"])
    bins = bins.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by, "_col")))
    wants = F.array(
        *[
            F.struct(F.lit(i).alias("_slot"), F.lit(f"_c{at}").alias("of"), F.lit(float(p)).alias("p"))
            for i, (at, (_, p)) in enumerate(zip(slots, wanted.values()))
        ]
    )
    own = bins.withColumn("_w", F.explode(F.filter(wants, lambda w: w["of"] == F.col("_col"))))
    at = F.when(F.col("_total") > 0, F.col("_w.p") * (F.col("_total") - 1))
    none = F.lit(None).cast("double")
    asked = own.withColumns(
        {"_slot": F.col("_w._slot"), "_r0": F.floor(at), "_r1": F.ceil(at), "_part": at - F.floor(at), "_v0": none, "_v1": none}
    )
    state = cut_lineage(_narrowed(asked, [*by, "_slot", "_part", "_v0", "_v1", "_r0", "_r1"]))
    done = [state.filter(~_open())]
    while not state.filter(_open()).isEmpty():
        known = F.struct(*_KNOWN)
        ranges = state.filter(_open()).groupBy(*by).agg(
            *[F.max(F.when(F.col("_slot") == i, known)).alias(f"_s{i}") for i in range(len(slots))]
        )
        met = join_null_safe(wide, ranges, by)
        hits = []
        for i, c in enumerate(slots):
            v, s = F.col(f"_c{c}"), F.col(f"_s{i}")
            hit = F.struct(v.alias("_v"), *[s[name].alias(name) for name in _KNOWN])
            hits.append(F.when(v.between(s["_from"], s["_to"]), hit).alias(f"_h{i}"))
        rows = met.select(*by, *hits).unpivot(by, [f"_h{i}" for i in range(len(slots))], "_slot", "_h").filter("_h IS NOT NULL")
        rows = rows.select(*by, F.substring("_slot", 3, 9).cast("int").alias("_slot"), "_h.*")
        binned = rows.withColumn("_bin", even_bins(F.col("_v"), F.col("_from"), F.col("_to"))).drop("_from", "_to")
        group = [*by, "_slot", "_part", "_v0", "_v1", "_r0", "_r1"]
        state = cut_lineage(_narrowed(_counted(binned, group), group))
        done.append(state.filter(~_open()))
    value = F.col("_v0") + F.coalesce((F.col("_v1") - F.col("_v0")) * F.col("_part"), F.lit(0.0))
    outs = [F.max(F.when(F.col("_slot") == i, value)).alias(o) for i, o in enumerate(wanted)]
    return reduce(DataFrame.unionAll, done).groupBy(*by).agg(*outs).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *wanted)
