import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skyweave.llm.queries import vocabulary
from skyweave.llm.simhash import one_of_each_group
from skyweave.session import cut_lineage

from test_decontaminate import brute as brute_marks
from test_nearcopies import brute as brute_copies
from test_quality import brute_rules
from test_secret_scan import brute as brute_secrets
from test_tokens import check_packing


def test_stages_replayed(spark, sf):
    """Each stage on its own input against what plain Python says of it."""
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5

    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf))
        assert docs.columns == names
        after.append({r.doc_id: r for r in docs.collect()})
    first, second, third, fourth = after

    rules = {i: brute_rules(r.text) for i, r in rows.items()}
    passing = {i for i, r in rules.items() if r[0] >= 20 and 100 * r[4] <= 30 * r[0]}
    assert set(first) <= passing
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1} & passing
    assert len(good & set(first)) >= 0.97 * len(good)
    assert all(first[i] == rows[i] for i in first)

    kept = {c for _, c in brute_copies([(i, r.text) for i, r in first.items()])}
    assert set(second) == kept and all(second[i] == first[i] for i in second)

    marks = {m[0]: m for m in brute_marks([(i, r.text) for i, r in second.items()], items)}
    assert set(third) == {i for i in second if marks[i][2] <= 0.5 * marks[i][1]}
    assert all(third[i] == second[i] for i in third if not marks[i][2])
    assert all(len(third[i].text) < len(second[i].text) for i in third if marks[i][2])
    assert any(marks[i][2] for i in second)
    assert not any(m[2] for m in brute_marks([(i, r.text) for i, r in third.items() if marks[i][2]], items))

    assert set(fourth) == set(third)
    assert all(not brute_secrets(fourth[i].text) for i in fourth)
    assert all(fourth[i] == third[i] for i in fourth if not brute_secrets(third[i].text) and "[SECRET]" not in fourth[i].text)
    assert all(r.n_chars == len(r.text) for r in fourth.values())

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    library = Tokenizer.from_file(vocabulary())
    used, fewest = check_packing(packed, [(i, r.text) for i, r in fourth.items()], library, 1024)
    assert used <= fewest + 2
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, packed))


def test_every_stage_takes_odd_and_empty_tables(spark, sf, make, edges):
    for rows in (edges, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, make(rows), sf).collect()


def test_repeated_rows_stay_once(make):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z"), (None, "n o p q")]
    got = sorted((r.doc_id or 0, r.text) for r in one_of_each_group(make(rows)).collect())
    assert got == [(0, "n o p q"), (1, "a b c d"), (3, "x y z")]


@pytest.mark.parametrize("name", ["queries", "oracle_sql"])
def test_registered(name):
    import __spark_entry__ as entry

    found = getattr(entry, name)()
    assert len(found) > 200
    if name == "queries":
        assert {f"op{i}_" for i in range(1, 14)} <= {q.split("_")[0] + "_" for q in found} and "pipeline" in found
