"""Targets against plain water-filling, the mix against a plain simulation of its rules."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gradeloom.llm import source_mix


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not full:
            return got | {s: rate * weight[s] for s in open_}
        for s in full:
            got[s] = most * sizes[s]
            left -= got[s]
        open_ -= full
    return got


def test_targets(spark):
    rnd = random.Random(3)
    for _ in range(4):
        sizes = {name: rnd.choice([0, 1, 10, 100, 1000, 5000]) for name in ["a", "B", "é", "", None, *(f"s{i}" for i in range(rnd.randint(0, 9)))]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_mix.source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_taken_meets_targets(odd, odd_rows):
    rows = source_mix.schedule(odd).withColumn("taken", source_mix.taken_words(F.col("turns"))).collect()
    assert len(rows) == len(odd_rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        n = len((r.doc.text or "").split())
        assert r["size"] == n and 0 <= r.taken <= 2 * n
        size[r.doc.source] += n
        taken[r.doc.source] += r.taken
        target[r.doc.source] = r.target
    want = targets(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert taken[s] == int(target[s])


def test_mix_holds_what_was_taken(odd):
    plan = source_mix.schedule(odd).select("doc.source", source_mix.taken_words(F.col("turns")).alias("taken"))
    want = {r.source: r.n for r in plan.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mixed = source_mix.mix(odd)
    assert mixed.columns == odd.columns and mixed.schema["bucket"].dataType == odd.schema["bucket"].dataType
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.bucket == "clash"
    assert dict(got) == {s: n for s, n in want.items() if n}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, source_mix.mix(odd.repartition(2)).collect()))


def test_cut_keeps_white_space(spark):
    df = spark.range(1).select(source_mix.first_words(F.lit(" a\n\n b  c d"), F.lit(3)).alias("t"))
    assert df.first().t == " a\n\n b  c"


def test_empty_table(nothing):
    assert source_mix.schedule(nothing).count() == 0 and source_mix.mix(nothing).count() == 0


def test_truncation_of_the_global_order(spark, odd):
    """The budget cuts the order of finish times where each source has had its target, and positions are gapless."""
    rnd = random.Random(6)
    rows = [(i if i % 9 else None, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["a", "b", "c", None])) for i in range(300)]
    for docs in (odd, spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string").repartition(3)):
        plan = source_mix.schedule(docs)
        want = {r.row: r.taken for r in plan.select("row", source_mix.taken_words(F.col("turns")).alias("taken")).collect()}
        got = {r.row: r for r in source_mix.truncated(plan).collect()}
        assert {k: r.taken for k, r in got.items()} == want and len(got) == docs.count()
        used = sorted(r.position for r in got.values() if r.taken)
        assert used[0] == 0 and len(set(used)) == len(used) and all((r.position is None) == (r.taken == 0) for r in got.values())
        assert max(used) < sum(r.taken for r in got.values())


