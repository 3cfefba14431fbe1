import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from skyweave.llm import conversations as cv
from skyweave.llm.queries import QUERIES
from skyweave.llm.texts import prepare

SCHEMA = "conv_id long, turn long, role string, text string, at long, kind int, times long, fault int, _c long"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def least_repair(rows):
    """(cost, audit, repaired) by trying, row by row, every edit in every state of the pattern."""

    @lru_cache(maxsize=None)
    def rest(i, made):
        """Least of the remaining rows, with ``made`` the last initial, '' or 's' at first; inserts up to two at a place."""
        best = []
        if i == len(rows) and made in ("", "a"):
            best.append((0, "", ()))
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
        if i < len(rows):
            role, text, fault = rows[i]
            choices = [("D", 2, None)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role and role[0] in following:
                    choices.append(("K", more, role))
                choices += [("R", 1 + more, r) for r in ("user", "assistant") if r[0] in following]
            for edit, cost, to in choices:
                c, a, out = rest(i + 1, made if to is None else to[0])
                best.append((cost + c, edit + a, (() if to is None else (f"{to}:{text}",)) + out))
        return min(best + inserted(i, made), default=(10**9, "", ()))

    def inserted(i, made):
        out = []
        for role in ("user", "assistant"):
            if role[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[made] and depth[0] < 4:
                depth[0] += 1
                c, a, made_rows = rest.__wrapped__(i, role[0])
                depth[0] -= 1
                out.append((5 + c, "I" + a, (f"{role}:",) + made_rows))
        return out

    depth = [0]
    return rest(0, "")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = BLANK.findall(text)
        if not last:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(table_rows):
    convs = {r[0]: [] for r in table_rows}
    for conv, turn, role, text in table_rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = faults([r[1:] for r in rows])
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, made = least_repair(tuple((r, t, f) for (_, r, t), f in zip(rows, found)))
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        numbers = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *numbers, illegal, cost, audit, digest)
    return sorted(out.values(), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_is_brute_force(spark, sf):
    df = QUERIES["op13_conversation_repair"](spark, sf)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    assert df.dtypes == [(n, "bigint") for n in names] + [("audit", "string"), ("repaired_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == brute(rows)


def test_random_conversations(spark):
    prepare(spark)
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "User", "u", "s", "a", None]
    texts = ["Yes.", "no", "", " \t\n\x0b\f\r", "Go on! \x0b", "é?", "é", "什么。", None, "a.b"]
    rows = [
        (conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts))
        for conv in range(300)
        for turn in range(rng.choice([1, 2, 3, 5, 8]) * (1 if conv % 3 else 2))
    ]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes.")]
    assert got(cv.repaired(table(spark, rows))) == brute(rows)


def test_ties_repeats_and_empty(spark):
    prepare(spark)
    rows = [(1, t, r, x) for t in range(4) for r, x in (("user", "A."), ("assistant", "B?"))]
    rows += [(2, 3, "user", "same.")] * 7 + [(3, 0, "system", "S.")] * 2 + [(4, None, "user", " ")] * 3 + [(5, 2**61, "", "x")]
    assert got(cv.repaired(table(spark, rows))) == brute(rows)
    assert got(cv.repaired(table(spark, []))) == []


def test_long_conversation_over_many_tasks(spark):
    """One conversation of thousands of turns, ranged over tasks, against the chart of all its turns in one list."""
    prepare(spark)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"text {t % 900}" + rng.choice([".", ""])) for t in range(6000)]
    df = table(spark, rows + [(2, 0, "user", "Hi.")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = cv.in_order(cv.with_faults(cv.damaged(df)))
    runs = [r for r in cv.runs_of(ordered).collect() if r.conv_id == 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(runs) > 1
    turns = [r for r in ordered.orderBy("at").collect() if r.conv_id == 1]
    cell = cv.closure()
    for r in turns:
        cell = cv.joined(cell, cv.leaf(r.initial, r.fault))
        for _ in range(r.times - 1):
            cell = cv.joined(cell, cv.leaf("", cv.DUPLICATE))
    row = next(r for r in cv.repaired(df).collect() if r.conv_id == 1)
    assert (row.cost, row.audit) == cv.cheapest(cell)


@pytest.mark.parametrize("seed", range(4))
def test_every_split_gives_the_same_cell(seed):
    """Full CYK, trying every split of every span, against doubling."""
    rng = random.Random(seed)
    leaves = [cv.leaf(rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(13)]
    cells = {(i, i + 1): c for i, c in enumerate(leaves)}
    for span in range(2, len(leaves) + 1):
        for i in range(len(leaves) - span + 1):
            found = [cv.joined(cells[i, k], cells[k, i + span]) for k in range(i + 1, i + span)]
            assert len(set(found)) == 1
            cells[i, i + span] = found[0]
    assert cv.chart(leaves) == cells[0, len(leaves)]
