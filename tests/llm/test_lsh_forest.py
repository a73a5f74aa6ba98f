"""Near-duplicates against brute force over full shingle sets, with groups that crowd an order."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from gradeloom.llm import lsh_forest as lf

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, threshold):
    """Smallest reachable id of every row; None ids count as largest."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)) and 100 * len(x & y) >= threshold * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        known = least.get(find(a))
        least[find(a)] = i if known is None else known if i is None else min(known, i)
    return [(len(sets[a]), least[find(a)]) for a in range(len(rows))]


def compare(spark, rows, threshold):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in lf.near_duplicates(df, threshold=threshold).collect()), key=key)
    assert got == sorted(((i, n, c) for (i, _), (n, c) in zip(rows, brute(rows, threshold))), key=key)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def test_shingle_sets_are_exact():
    s = lf.Shingler()
    rnd = random.Random(1)
    texts = ["", "  ", "a", "A b C d", "É é Ä", "x" * 100_000, "a\x0bb\x0cc\td\r\ne f a b c d e"]
    texts += ["".join(rnd.choice("aAbé \n\t") for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    names = {}
    for t in texts:
        got, want = s.shingles(t), shingles(t)
        assert len(got) == len(want)
        assert names.setdefault(want, got.tobytes()) == got.tobytes()
    assert len(set(names.values())) == len(names)


def test_estimates_are_near_the_truth():
    s = lf.Shingler()
    a, b = np.arange(1000, dtype=np.uint64), np.arange(150, 1150, dtype=np.uint64)
    mixed = [lf._mix(np, x * np.uint64(0x9E3779B97F4A7C15)) for x in (a, b)]
    low = [(s.signature(x) & 15).astype(np.uint8) for x in mixed]
    sketch = [(x[::2] | (x[1::2] << 4))[None, :] for x in low]
    assert abs(lf._agreement(np, *sketch)[0] - 850 / 1150) < 0.15


@pytest.mark.parametrize("threshold", [80, 85])
def test_groups_pairs_and_strangers(spark, threshold):
    rnd = random.Random(threshold)
    rows = []
    for _ in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 5, 6, 30, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 6)):
            rows.append(edited(rnd, base, rnd.choice([0, 0, 1, 2, 4])))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [common + " " + edited(rnd, [f"q{j}" for j in range(20)], 20) for _ in range(40)]
    rnd.shuffle(rows)
    compare(spark, list(enumerate(rows)), threshold)


@pytest.mark.parametrize("near", [1, 6])
def test_crowded_region(spark, monkeypatch, near):
    """A star: copies with two edits are linked with the original alone."""
    monkeypatch.setattr(lf, "NEAR", near)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [edited(rnd, base, rnd.choice([1, 2, 2, 2, 3, 4])) for _ in range(300)] + [" ".join(base)]
    rnd.shuffle(rows)
    compare(spark, list(enumerate(rows)), 85)


def unlinked_crowd(seed, singles, pairs):
    """Texts alike at 0.74 by a common part, and among them pairs alike at 0.82."""
    rnd = random.Random(seed)
    core = [f"c{i}" for i in range(600)]
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    rows = [" ".join(core + own(100)) for _ in range(singles)]
    for _ in range(pairs):
        shared = own(30)
        rows += [" ".join(core + shared + own(70)) for _ in range(2)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("near", [1, 6])
def test_pairs_in_a_crowd_without_links(spark, monkeypatch, near):
    monkeypatch.setattr(lf, "NEAR", near)
    compare(spark, unlinked_crowd(12, 300, 60), 80)


def test_chain_of_small_steps(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(30)]
    compare(spark, rows, 80)


def test_odd_rows(spark, odd, odd_rows, nothing):
    compare(spark, [(i, t) for i, t, *_ in odd_rows], 80)
    whole = lf.near_duplicates(odd)
    rows = whole.collect()
    assert len(rows) == len(odd_rows)
    assert all(r.kept for r in rows if r.n_shingles == 0)
    kept = lf.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = sorted((r.text or "", r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert len(texts) == len(set(texts))
    assert {shingles(t) for t, *_ in texts} == {shingles(t) for _, t, *_ in odd_rows}
    only_null = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (None, "")], "doc_id long, text string")
    assert lf.deduplicated(only_null).count() == 2
    assert lf.near_duplicates(nothing).count() == 0 and lf.deduplicated(nothing).count() == 0


def test_texts_are_not_shuffled_for_the_exact_counts(spark):
    """Sets of wanted classes come from a scan with a filter that stops nothing wanted; copies, null ids and texts that only pass are left out."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(400)] + [(None, "a b c d e f g"), (7, None), (500, "w3x0 w3x1"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = lf.signatures(docs, "doc_id", "text", 5)
    wanted = known.filter("node IS NOT NULL AND (id IS NULL OR id % 3 = 0)").select("node", "id", "mark").localCheckpoint()
    table = lf._filter_bits(wanted)
    hashes = np.array([r[0] for r in wanted.selectExpr("xxhash64(id, mark)").collect()], np.int64)
    assert lf._may_be_wanted(np, table, hashes).all()
    others = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 20_000)
    assert lf._may_be_wanted(np, table, others).mean() < 0.02
    table = lf._filter_bits(wanted.limit(0))
    assert not lf._may_be_wanted(np, table, hashes).any()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many wanted texts
    try:
        sets = lf._fetch_sets(docs, wanted, "doc_id", "text", 5)
        got = {bytes(r["node"]): bytes(r["hashes"]) for r in sets.collect()}
        plan = sets._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    s = lf.Shingler()
    expected = [s.shingles(t) for i, t in rows if t and (i is None or i % 3 == 0)]
    assert got == {lf._node(x): x.tobytes() for x in expected}
    above = plan[: plan.index("MapInArrow")]
    assert "Join" in above and "Join" not in plan[plan.index("MapInArrow") :].split("Relation")[0].split("LogicalRDD")[0]


def test_only_sets_of_pairs_are_shuffled(spark, tmp_path):
    """Counting few pairs shuffles their sets and hardly any other, also where the pairs are too many for a broadcast; the counts are exact."""
    rows = [(i, " ".join(f"w{i // 2}x{k + i % 2}" for k in range(40))) for i in range(800)] + [(None, "a b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = lf.Shingler()
    hashes = {lf._node(h): h for h in (s.shingles(t) for _, t in rows if t)}
    sets = spark.createDataFrame([(bytearray(k), bytearray(h.tobytes())) for k, h in hashes.items()], "node binary, hashes binary").repartition(3)
    sets.write.parquet(f"{tmp_path}/sets")
    nodes = [lf._node(s.shingles(t)) for _, t in rows[:12]]
    named = sorted(tuple(sorted(x)) for x in [*zip(nodes[::2], nodes[1::2]), (nodes[0], nodes[5]), (nodes[0], nodes[7])])
    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in named], "a binary, b binary")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = lf._count(pairs, spark.read.parquet(f"{tmp_path}/sets"))
        got = sorted((bytes(r["a"]), bytes(r["b"]), r["both"], r["either"]) for r in counted.collect())
        plan = spark._jvm.PythonSQLUtils.explainString(counted._jdf.queryExecution(), "formatted")
        shuffled = [float(x) for x in re.findall(r"ShuffleQueryStage[^\n]*rowCount=([\d.E+]+)", plan)]
        none = lf._count(pairs.limit(0), spark.read.parquet(f"{tmp_path}/sets")).collect()
        classes = lf.signatures(docs, "doc_id", "text", 5).filter("node IS NOT NULL").localCheckpoint()
        few = lf._passing(classes.select("node", "sig"), pairs.selectExpr("a AS node")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    expected = [(a, b, len(np.intersect1d(hashes[a], hashes[b])), len(np.union1d(hashes[a], hashes[b]))) for a, b in named]
    assert got == expected and none == []
    assert shuffled and max(shuffled) < 40 and "ReusedExchange" in plan
    assert {a for a, _ in named} <= {bytes(r["node"]) for r in few} and len(few) < 40
