import hashlib
import random
import re

import pytest

from skyweave.llm.decontaminate import contamination, decontaminated
from skyweave.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    grams = []
    for item, text in items:
        w = words(text)
        if w:
            grams += [(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))]
    for doc, text in docs:
        w = words(text)
        hit, seen = set(), set()
        sizes = {len(g) for _, g in grams}
        at = {}
        for n in sizes:
            for i in range(len(w) - n + 1):
                at.setdefault(tuple(w[i : i + n]), []).append(i)
        for item, g in grams:
            for i in at.get(g, ()):
                hit |= set(range(i, i + len(g)))
                if item is not None:
                    seen.add(str(item))
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(seen), digest, bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block_words", [1, 60, 10**6])
@pytest.mark.parametrize("window", [2, 4, 10])
def test_matches_brute_force(spark, make, edges, block_words, window):
    rng = random.Random(window)
    pool = ["a", "B", "c", "dé", "漢", "7"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(8)]
    items += [(3, "a b c"), (None, "c c c"), (50, None), (51, "!?")]
    docs = [(i, ", ".join(rng.choice(pool + ["zz"]) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + edges
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(make(docs), bench, window, block_words)) == brute(docs, items, window)


def test_query(spark, sf, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(QUERIES["op7_benchmark_decontamination"](spark, sf))
    assert got == brute(sample, items)
    assert sum(r[-1] for r in got) > 0


def test_empty_sides(spark, make, sample):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(contamination(make(sample[:5]), none)) == brute(sample[:5], [])
    assert contamination(make([]), none).count() == 0


def test_spans_are_cut_and_covered_documents_dropped(spark, make):
    item = "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    filler = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"{filler}; {item.upper()}! {filler}"), (2, item), (3, filler), (4, None), (5, "")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in decontaminated(make(docs), bench).collect()}
    cut = f"{filler}; ! {filler}"
    assert got == {1: (cut, len(cut), True), 3: (filler, len(filler), True), 4: (None, None, True), 5: ("", 0, True)}


def test_stage_is_the_same_for_every_block_size(spark, make, edges):
    first, second = (" ".join(f"{c}{i}" for i in range(12)) for c in "qr")
    over = " ".join([*first.split()[6:], *second.split()[:6]])
    filler = " ".join(f"w{i}" for i in range(8))
    docs = [(1, f"{first} {filler} {second}"), (2, f"{filler * 6} {first} {second.split()[6]} {filler}"), (3, f"{filler} x {first} {filler} {filler} {over} {filler}")]
    docs += [(4, " ".join([filler, filler, filler, *first.split()[:6], *over.split(), *second.split()[6:], filler]))] + edges
    bench = spark.createDataFrame(list(enumerate([first, over, second])), "item_id long, text string")
    whole, *others = (rows(decontaminated(make(docs), bench, block_words=n)) for n in (10**6, 1, 20))
    assert all(o == whole for o in others) and 1 not in {r[0] for r in whole}


def test_stage_keeps_one_worker_in_a_task(spark, make):
    """Steps behind each other hold a Python process each in every task; the stage takes all blocks in one."""
    bench = spark.createDataFrame([(i, f"q{i} r{i} s{i}") for i in range(3)], "item_id long, text string")
    plan = decontaminated(make([(1, "a b c")]), bench, block_words=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
