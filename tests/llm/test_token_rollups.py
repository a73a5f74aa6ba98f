"""Totals after batches, against a dictionary; batches that come again or fail half way."""

import random
from collections import defaultdict

import pytest

from gradeloom.llm import token_rollups as tr


@pytest.fixture
def rollup(spark, tmp_path):
    return tr.TokenRollup(spark, f"file://{tmp_path}/rollup")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def plain(state):
    out = defaultdict(lambda: [0, 0])
    for (_, tokenizer), (source, lang, n) in state.items():
        out[source, lang, tokenizer][0] += 1
        out[source, lang, tokenizer][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_batches(spark, rollup):
    rnd = random.Random(4)
    state = {}
    for number in range(5):
        rows = []
        for seq in range(60):
            doc, tokenizer = rnd.choice([None, *range(25)]), rnd.choice(["a", "b"])
            op = rnd.choice(["insert", "delete", "revise", "revise"])
            source, lang = rnd.choice([("x", "en"), ("y", None), (None, "de")])
            if op == "revise" and rnd.random() < 0.5:
                source = lang = None
            rows.append((doc, source, lang, tokenizer, None if op == "delete" else rnd.randint(0, 99), op, seq))
        last = {}
        for row in rows:
            last[row[0], row[3]] = row
        for key, (_, source, lang, _, n, op, _) in last.items():
            if op == "delete":
                state.pop(key, None)
            elif op == "revise" and source is None and lang is None and key in state:
                state[key] = (*state[key][:2], n)
            else:
                state[key] = (source, lang, n)
        changes = spark.createDataFrame(rows, tr.CHANGES)
        assert rollup.apply(f"b{number}", changes)
        assert totals(rollup) == plain(state)
        assert not rollup.apply(f"b{number}", changes) and not rollup.apply("b0", changes)
        assert totals(rollup) == plain(state)


def test_half_written_batches_do_not_count(spark, rollup):
    one = spark.createDataFrame([(1, "x", "en", "a", 5, "insert", 0)], tr.CHANGES)
    rollup.apply("b0", one)
    two = spark.createDataFrame([(2, "x", "en", "a", 7, "insert", 0), (1, None, None, "a", 6, "revise", 0)], tr.CHANGES)
    # what a job leaves that died before its marker
    spark.createDataFrame([(9, "a", "x", "en", 100, 1)], tr.LEDGER).write.parquet(f"{rollup.folder}/ledger/b1")
    assert totals(rollup) == {("x", "en", "a"): (1, 5)}
    assert rollup.apply("b1", two) and totals(rollup) == {("x", "en", "a"): (2, 13)}


@pytest.mark.parametrize("row", [(1, "x", "en", "a", None, "insert", 0), (1, "x", "en", None, 1, "insert", 0), (1, "x", "en", "a", 1, "merge", 0), (1, "x", "en", "a", 1, None, 0)])
def test_wrong_changes_are_refused(spark, rollup, row):
    with pytest.raises(ValueError):
        rollup.apply("b0", spark.createDataFrame([row], tr.CHANGES))
    assert rollup.committed() == [] and totals(rollup) == {}


def test_empty_batch_and_deleted_groups(spark, rollup):
    empty = spark.createDataFrame([], tr.CHANGES)
    assert rollup.apply("b0", empty) and totals(rollup) == {}
    rollup.apply("b1", spark.createDataFrame([(1, "x", "en", "a", 5, "insert", 0)], tr.CHANGES))
    rollup.apply("b2", spark.createDataFrame([(1, None, None, "a", None, "delete", 0), (8, None, None, "a", None, "delete", 0)], tr.CHANGES))
    assert totals(rollup) == {}


def test_counts_of_texts(odd, odd_rows):
    from gradeloom.llm.tokens import encoder

    rows = tr.bpe_counts(odd.select("doc_id", "text", "size"), "text").collect()
    want = sorted(len(encoder().encode_ordinary(t or "")) for _, t, *_ in odd_rows)
    assert sorted(r.n_tokens for r in rows) == want and {r["size"] for r in rows} == {7}


def test_compaction_changes_no_total_and_later_batches_find_their_documents(spark, rollup):
    def change(doc, n, op="revise", tokenizer="a", source="x"):
        return (doc, source, "en", tokenizer, n, op, 0)

    assert not rollup.compact()
    rollup.apply("b0", spark.createDataFrame([change(i if i else None, i, "insert") for i in range(50)], tr.CHANGES))
    rollup.apply("b1", spark.createDataFrame([change(i, 100 + i) for i in range(10, 20)] + [change(7, None, "delete")], tr.CHANGES))
    before = totals(rollup)
    assert rollup.compact() and not rollup.compact() and totals(rollup) == before
    rollup.apply("b2", spark.createDataFrame([change(None, 5), change(11, None, "delete"), change(8, 9, source="y")], tr.CHANGES))
    state = {(i or None, "a"): ("x", "en", 100 + i if 10 <= i < 20 else i) for i in range(50) if i not in (7, 11)}
    state[None, "a"], state[8, "a"] = ("x", "en", 5), ("y", "en", 9)
    assert totals(rollup) == plain(state)
    # a base that died before it said what it covers
    spark.createDataFrame([(9, "a", "x", "en", 100, 1, 3)], tr.LEDGER + ", bucket int").write.partitionBy("bucket").parquet(f"{rollup.folder}/bases/0/ledger")
    assert rollup.compact() and totals(rollup) == plain(state) and rollup.committed() == ["b0", "b1", "b2"]
    assert not rollup.apply("b1", spark.createDataFrame([change(1, 1)], tr.CHANGES))
    assert rollup._read("ledger", tr.LEDGER).count() == len(state)


def test_a_batch_reads_its_own_buckets(spark, rollup, monkeypatch):
    rollup.apply("b0", spark.createDataFrame([(i, "x", "en", "a", i, "insert", 0) for i in range(200)], tr.CHANGES))
    read, seen = rollup._read, []
    monkeypatch.setattr(rollup, "_read", lambda *args: seen.append(read(*args)) or seen[-1])
    rollup.apply("b1", spark.createDataFrame([(5, "x", "en", "a", 1, "revise", 0)], tr.CHANGES))
    plan = seen[0].filter("bucket IN (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_one_of_two_writers_of_a_batch_counts(spark, rollup):
    rows = spark.createDataFrame([(1, "x", "en", "a", 5, "insert", 0)], tr.CHANGES)
    other = tr.TokenRollup(spark, rollup.folder)
    # both have seen that the batch is not committed
    other.committed = lambda: []
    assert rollup.apply("b/0", rows)
    other.apply("b/0", rows)
    assert totals(rollup) == {("x", "en", "a"): (1, 5)} and rollup.committed() == ["b/0"] and len(rollup._names("commits")) == 2
