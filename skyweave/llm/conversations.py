"""Conversation structure repair by weighted CYK interval parsing.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The repair grammar
is in Chomsky normal form: a nonterminal [p q] derives a span of turns that takes
the role pattern from state p to state q, with rules [p q] -> [p r] [r q], and a
leaf is one turn kept, given another role, or deleted, between insertions (the
closure of inserted turns).  A cell of the chart holds for every [p q] the least
(cost, audit) of its span.  Cells are combined bottom-up by span length: 1, 2, 4,
8 ... turns.  Two audits of one span and cost are never a prefix of one another
(they would differ by insertions, which cost), so the least pair does not depend
on what stands around a span, nor a span's cell on where it is split; one split
per span is enough, and a span may end where a task ends.

Rows are ranged by conversation and turn into a written table.  Each task reduces
its run of a conversation to one cell, the few cells of a conversation that spans
tasks are joined, and the audit meets the texts in one ordered stream, hashed as it
goes.  No task holds a conversation's texts, whatever its length.

Defined results: rows of a conversation stand by turn (nulls first), then role,
then the first 100 characters of the text, then its MD5.  Null roles and texts are
one space, a null turn counts as one space in damage; null conversations form one.
Repeated rows are duplicates after the first.  An empty role has no initial, so its
row is given another role or deleted.  A conversation that lost all rows has zeros,
an empty audit and the hash of the empty text.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
STATES = 4
#: States: nothing yet, after s, after u, after a; the pattern may end in the first and the last.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
#: Spans of up to so many turns are remembered; they recur everywhere.
SHORT = 8

Cell = tuple  # STATES * STATES of (cost, audit) or None


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None or (b is not None and b < a) else a


def joined(left: Cell, right: Cell) -> Cell:
    """[p q] of the span of both: the least [p r] [r q]."""
    out = []
    for p in range(STATES):
        row = [(r, c) for r in range(STATES) if (c := left[STATES * p + r]) is not None]
        for q in range(STATES):
            best = None
            for r, a in row:
                b = right[STATES * r + q]
                if b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost <= best[0]:
                        best = _better(best, (cost, a[1] + b[1]))
            out.append(best)
    return tuple(out)


_joined_short = lru_cache(maxsize=20_000)(joined)


@lru_cache(maxsize=1)
def closure() -> Cell:
    """The empty span: what insertions alone can do."""
    cell: list = [(0, "") if p == q else None for p in range(STATES) for q in range(STATES)]
    for _ in range(STATES):
        for p in range(STATES):
            for (r, initial), q in STEP.items():
                before = cell[STATES * p + r]
                if initial in ROLE and before is not None:
                    at = STATES * p + q
                    cell[at] = _better(cell[at], (before[0] + INSERT, before[1] + "I"))
    return tuple(cell)


@lru_cache(maxsize=None)
def leaf(initial: str, fault: int) -> Cell:
    """One turn between insertions; ``initial`` is s, u, a or anything else."""
    cell: list = [None] * (STATES * STATES)
    for p in range(STATES):
        cell[STATES * p + p] = (DELETE, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        for (r, to), q in STEP.items():
            if r == p:
                at = STATES * p + q
                if to == initial:
                    cell[at] = _better(cell[at], (KEEP + more, "K"))
                if to in ROLE:
                    cell[at] = _better(cell[at], (REROLE + more, "R"))
    return joined(joined(closure(), tuple(cell)), closure())


def chart(cells: list[Cell], span: int = 1) -> Cell:
    """One cell for neighbouring cells, combined by doubling the span."""
    if not cells:
        return closure()
    while len(cells) > 1:
        join = _joined_short if span < SHORT else joined
        pairs = [join(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + ([cells[-1]] if len(cells) % 2 else [])
        span *= 2
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cell[q] for q in ENDS if cell[q] is not None)


class Repair:
    """Applies an audit to the turns of one conversation as they come."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            initial = "a" if self.state == 2 else "u"
            self.state = STEP[self.state, initial]
            self.at += 1
            yield ROLE[initial], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The turns that stand in the repaired conversation up to and with this one."""
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            initial = role[0] if edit == "K" else ("a" if self.state == 2 else "u")
            self.state = STEP[self.state, initial]
            yield (role if edit == "K" else ROLE[initial]), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the rows that damage by checksum leaves, repeats included."""
    rows = table.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    rows = rows.withColumns({"role": _or_space("role"), "text": _or_space("text")})
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    rows = rows.withColumn("_kind", kind).filter(F.col("_kind") != 0)
    rows = rows.withColumns({"text": text.otherwise(F.col("text")), "role": F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))})
    times = F.when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", "turn", "role", "text", times.alias("times"))


ORDER = ["turn", "role", "head", "said"]


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``times``, and ``fault``: the first that holds for the first of them.

    A row repeats an earlier one if its role and text have a lesser turn in the
    conversation; that least turn is summed before it moves.
    """
    said = F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    keyed = merged.withColumns({"said": said, "_turn": F.struct("turn")})
    firsts = (
        rows.select(F.col("conv_id").alias("_c"), said.alias("_s"), F.struct("turn").alias("_t"))
        .groupBy("_c", "_s")
        .agg(F.min("_t").alias("_least"))
    )
    both = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    fault = (
        F.when(last == "", BLANK)
        .when(~F.col("_turn").eqNullSafe(F.col("_least")), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    return both.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.substring("text", 1, 100).alias("head"),
        "said",
        "times",
        F.substring("role", 1, 1).alias("initial"),
        fault.cast("int").alias("fault"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` ranged by conversation and place; ``at`` rises with both.  A written table."""
    ranged = rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()).drop("head", "said"))


class Run:
    """Neighbouring turns of one conversation, reduced to a cell and a few counts."""

    BLOCK = 256

    def __init__(self, conv_id: int | None, at: int):
        self.conv_id, self.at = conv_id, at
        self.done: list[Cell] = []
        self.leaves: list[Cell] = []
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal = self.turns = 0
        self.initials: list[str | None] = [None, None]  # first and last
        self.least = self.most = None

    def add(self, turn: int | None, initial: str, fault: int, times: int) -> None:
        again = fault if fault == BLANK else DUPLICATE
        self.leaves.append(leaf(initial if initial in ("s", "u", "a") else "", fault))
        self.leaves.extend([leaf("", again)] * (times - 1))
        while len(self.leaves) >= self.BLOCK:
            self.done.append(chart(self.leaves[: self.BLOCK]))
            del self.leaves[: self.BLOCK]
        self.counts[fault] += 1
        self.counts[again] += times - 1
        if self.initials[1] is not None and self.initials[1] + initial not in LEGAL:
            self.illegal += 1
        self.illegal += (times - 1) * (initial + initial not in LEGAL)
        self.initials = [initial if self.initials[0] is None else self.initials[0], initial]
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def cell(self) -> Cell:
        tail = [chart(self.leaves)] if self.leaves else []
        return chart(self.done + tail, SHORT)

    def packed(self) -> str:
        rest = [self.counts, self.illegal, self.turns, self.initials, self.least, self.most]
        return json.dumps([self.cell(), *rest])


def whole(runs: list[str]) -> tuple[list[int], str]:
    """gaps, blank, duplicate, truncated, illegal and cost of a conversation, and its audit; ``runs`` in order."""
    cells, counts, illegal, turns, last, least, most = [], [0] * 4, 0, 0, None, None, None
    for run in map(json.loads, runs):
        cells.append(tuple(c and tuple(c) for c in run[0]))
        counts = [a + b for a, b in zip(counts, run[1])]
        illegal += run[2] + (last is not None and last + run[4][0] not in LEGAL)
        last = run[4][1]
        if run[5] is not None:
            turns += run[3] - (run[5] == most)
            least, most = (run[5] if least is None else least), run[6]
    cost, audit = cheapest(chart(cells, SHORT))
    gaps = 0 if least is None else most - least + 1 - turns
    return [gaps, *counts[1:], illegal, cost], audit


def runs_of(rows: DataFrame) -> DataFrame:
    """``conv_id, at, packed``: one row for each run of a conversation within a task."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out = None, []
        for batch in batches:
            for conv, at, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if run is None or conv != run.conv_id or at >> 33 != run.at >> 33:
                    if run is not None:
                        out.append(run)
                    run = Run(conv, at)
                run.add(*turn)
            if out:
                yield packed(out)
                out = []
        if run is not None:
            yield packed([run])

    def packed(runs: list[Run]) -> pa.RecordBatch:
        columns = [[r.conv_id for r in runs], [r.at for r in runs], [r.packed() for r in runs]]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            ["conv_id", "at", "packed"],
        )

    return rows.select("conv_id", "at", "turn", "initial", "fault", "times").mapInArrow(spans, "conv_id long, at long, packed string")


class Report:
    """Collects one conversation from the ordered stream of its marker, runs and turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.runs, self.repair = conv_id, [], None
        self.numbers, self.audit = [0] * 6, ""
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, packed: str | None, role: str | None, text: str | None, times: int | None) -> None:
        if packed is not None:
            self.runs.append(packed)
        elif role is not None:
            self._open()
            for _ in range(times):
                self._write(self.repair.turn(role, text))

    def _open(self) -> None:
        if self.repair is None:
            if self.runs:
                self.numbers, self.audit = whole(self.runs)
            self.runs = []
            self.repair = Repair(self.audit)

    def _write(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
            self.empty = False

    def row(self) -> tuple:
        self._open()
        self._write(self.repair.end())
        return (self.conv_id, *self.numbers, self.audit, self.hash.hexdigest())


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = f"conv_id long, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, repaired_sha256 string"


def repaired(table: DataFrame) -> DataFrame:
    """One row per conversation of ``table`` with the faults of its damaged form and the cheapest repair."""
    rows = in_order(with_faults(damaged(table)))
    stream = (
        table.select(F.col("conv_id").cast("bigint").alias("conv_id"))
        .distinct()
        .withColumns({"kind": F.lit(0), "at": F.lit(0).cast("bigint")})
        .unionByName(runs_of(rows).withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(rows.select("conv_id", F.lit(2).alias("kind"), "at", "role", "text", "times"), allowMissingColumns=True)
    )
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at")

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = Report(conv)
                now.add(*rest)
            if out:
                yield filled(out)
                out = []
        if now is not None:
            yield filled([now.row()])

    def filled(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        columns = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *NUMBERS, "audit", "repaired_sha256"])

    return ordered.select("conv_id", "packed", "role", "text", "times").mapInArrow(reports, SCHEMA)
