import hashlib
import re
from collections import Counter

from skyweave.llm.linededup import deduped_lines, keep_bitmaps, line_digests, sorted_lines
from skyweave.llm.queries import QUERIES
from skyweave.llm.texts import id_text, prepare

AZ = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(AZ)


def brute(rows, min_docs=10, keep_first=False):
    """(doc_id, lines, dropped, text) of every row, in plain Python."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    common, seen, out = {k for k, n in held.items() if n >= min_docs}, set(), {}
    for at in sorted(range(len(split)), key=lambda j: (split[j][0] is not None, split[j][0])):
        kept = []
        for line in split[at][1]:
            k = key(line)
            if k not in common or (keep_first and k not in seen):
                kept.append(line)
            seen.add(k)
        i, lines = split[at]
        out[at] = (i, len(lines), len(lines) - len(kept), "\n".join(kept))
    return [out[at] for at in range(len(split))]


def same(df, want):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == sorted(((i, n, d, digest(t)) for i, n, d, t in want), key=str)


def test_query_is_brute_force(spark, sf, sample):
    df = QUERIES["op11_line_dedup"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    want = brute(sample)
    assert sum(d for _, _, d, _ in want)
    same(df, want)


def test_odd_rows(spark, make, edges):
    prepare(spark)
    line = [" Terms Apply.\t", "TERMS APPLY.", "terms apply.\r", "\x0bterms apply."]
    odd = [(i, f"head {i}\n{line[i % 4]}\n\nÉtÉ\n{'été' if i % 2 else 'ÉtÉ'}\n") for i in range(12)]
    long = "\n".join(["terms apply."] * 70 + [f"own {i}" for i in range(40_000)] + [" "] * 70 + ["Terms apply."])
    rows = edges + odd + [(50, long), (51, " terms apply."), (52, "terms apply."), (53, "\n\n"), (None, "terms apply.")]
    same(line_digests(make(rows)), brute(rows))
    same(line_digests(make(rows), min_docs=1), brute(rows, 1))
    same(line_digests(make([])), [])


def test_repeated_rows_count_each(spark, make):
    prepare(spark)
    rows = [(7, "again\nand again")] * 10 + [(8, "only\nnine")] * 9
    same(line_digests(make(rows)), brute(rows))


def test_first_occurrence_stays(spark, make):
    prepare(spark)
    rows = [(i, f"common\nown {i}\nCOMMON ") for i in range(30)]
    got = {r.doc_id: r for r in deduped_lines(make(rows), keep_first=True).collect()}
    assert {i: (r.n_lines, r.n_dropped, r.text) for i, r in got.items()} == {i: (n, d, t) for i, n, d, t in brute(rows, keep_first=True)}


def test_bitmaps_store_only_words_that_lose(spark, make):
    prepare(spark)
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(200)] + ["shared"] + [f"more {i} {j}" for j in range(300)])) for i in range(10)]
    maps = [r.words for r in keep_bitmaps(id_text(make(rows))).collect()]
    assert len(maps) == 10 and all(len(w) == 1 and w[0].word == 3 and w[0].bits == ~(1 << 8) for w in maps)


def test_hot_line_spans_tasks_without_another_exchange(spark, make):
    """One line in every document: its rows are dealt over the tasks, and the window adds no shuffle."""
    prepare(spark)
    rows = [(i, "the same line\nown " + str(i)) for i in range(4000)]
    lines = sorted_lines(id_text(make(rows)))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan
    sizes = [r["count"] for r in lines.groupBy("key", "share").count().collect()]
    assert max(sizes) < 4000 / 4
