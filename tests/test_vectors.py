"""Vector operators against NumPy by brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import vectors
from gradeloom.operators.profile import histogram
from gradeloom.operators.split import with_fold
from gradeloom.plans.checks.vectors import close_pairs


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6))
    x[:60] = x[0]  # a quarter of the rows are copies of one vector
    x[60:120] = x[60] + rng.normal(scale=0.05, size=(60, 6))  # and a quarter lies close together
    label = rng.integers(0, 7, 240)
    label[-1] = 99  # a cluster of one
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(240)]
    return x, label, spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").repartition(5).cache()


def cosine(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("numbers", [4_000_000, 12])
def test_silhouettes(points, numbers):
    x, label, df = points
    distance = 1 - cosine(x)
    got = {r["vec_id"]: r["silhouette"] for r in vectors.silhouettes(df, "label", numbers_per_block=numbers).collect()}
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        if not same.any():
            assert got[i] == 0.0
            continue
        a = distance[i, same].mean()
        b = min(distance[i, label == c].mean() for c in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


@pytest.mark.parametrize("block,pivots", [(2000, None), (7, 5), (13, 40)])
@pytest.mark.parametrize("least", [0.5, 0.95])
def test_close_pairs(points, block, pivots, least):
    x, label, df = points
    found = vectors.close_pairs(df, "vec_id", "embedding", "label", least, 2, pivots, block).collect()
    groups = {}
    for i, v in enumerate(map(tuple, x)):
        groups.setdefault(v, []).append(i)
    groups = sorted(groups.values())
    c, want = cosine(x), {}
    for g in groups:
        for h in groups:
            gap = max(abs(int(label[i]) - int(label[j])) for i in g for j in h)
            if g[0] < h[0] and c[g[0], h[0]] >= least and gap >= 2:
                want[(g[0], h[0])] = gap
            if g is h and gap >= 2:
                want[(g[0], g[0])] = gap
    assert {(r["a"], r["b"]): r["gap"] for r in found} == want
    assert len(found) == len(want)


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(1300)))), (2, ""), (3, "a b"), (4, " ".join("x" * 510))], "id INT, text STRING")
    rows = {(r["id"], r["chunk"]): r["tokens"] for r in vectors.token_windows(df).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0), (4, 0)]
    assert rows[(1, 1)] == [str(i) for i in range(382, 892)] and rows[(1, 3)][-1] == "1299"
    assert rows[(2, 0)] == [] and len(rows[(4, 0)]) == 510


def test_windows_tokenize_once(tables):
    plan = vectors.token_windows(tables.documents.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_mean_pool(points):
    x, label, df = points
    got = {r["label"]: r["embedding"] for r in vectors.mean_pool(df, "label").collect()}
    for c in set(label):
        assert got[int(c)] == pytest.approx(x[label == c].mean(0))


def test_folds_do_not_depend_on_partitions(tables):
    def fold(df):
        return {(r["o_orderkey"], r["fold"]) for r in with_fold(df, "o_orderkey", 5, 1).select("o_orderkey", "fold").collect()}

    assert fold(tables.orders) == fold(tables.orders.repartition(7))


def test_histogram_of_one_value(spark):
    df = spark.range(10).select(F.lit(3.0).alias("x"))
    rows = histogram(df, "x", 4).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["bin"])] == [0, 0, 10, 0]


@pytest.mark.parametrize("cosine_", [0.6, 0.9])
def test_similar_pairs_reach_their_recall(spark, cosine_):
    """Planted pairs at just the cosine, among strangers; what strangers meet does not grow with the table."""
    rng = np.random.default_rng(8)
    met = {}
    for n in (600, 2400):
        x = rng.normal(size=(n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(n, 48))
        y -= (y * x).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = (cosine_ + 0.001) * x + np.sqrt(1 - (cosine_ + 0.001) ** 2) * y
        rows = [(i, [float(v) for v in r], float(i >= n)) for i, r in enumerate(np.concatenate([x, near]))]
        df = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE").repartition(4)
        found = {(r["a"], r["b"]): r for r in vectors.similar_pairs(df, "id", "v", "s", cosine_, 1, recall=0.95).collect()}
        assert np.mean([(i, i + n) in found for i in range(n)]) >= 0.94  # 0.95 of them, give or take two standard deviations
        u = np.concatenate([x, near])
        assert all(abs(r["cosine"] - u[a] @ u[b]) < 1e-9 and r["cosine"] >= cosine_ and r["gap"] >= 1 for (a, b), r in found.items())
        groups = vectors.unit_vectors(vectors.vector_groups(df, "id", "v", "s"), "v")
        every, _ = vectors.candidate_pairs(groups, cosine_, 1, 0.95)
        met[n] = every.count() / (2 * n) / vectors.bands_for(2 * n, cosine_, 0.95)[1]
    assert met[2400] < 1.5 * met[600]


def test_bands_follow_the_table_and_the_recall():
    assert vectors.bands_for(1000, 1.0, 0.99)[1] == 1
    for n in (10, 1000, 10**6, 10**9):
        bits, bands = vectors.bands_for(n, 0.8, 0.97)
        share = (1 - np.arccos(0.8) / np.pi) ** bits
        assert n / 2**bits <= vectors.BUCKET_ROWS and 1 - (1 - share) ** bands >= 0.97


def test_pairs_of_tiny_tables(spark):
    schema = "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE"
    for find in (vectors.close_pairs, vectors.similar_pairs):
        assert find(spark.createDataFrame([], schema), "id", "v", "s", 0.5, 1).count() == 0
        one = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 0.0], 3.0)], schema)
        assert [tuple(r) for r in find(one, "id", "v", "s", 0.5, 1).collect()] == [(1, 1, 1.0, 3.0)]
        three = spark.createDataFrame([(1, [1.0, 0.1], 0.0), (2, [1.0, 0.0], 3.0), (3, [0.0, 0.0], 9.0)], schema)
        assert [(r["a"], r["b"], r["gap"]) for r in find(three, "id", "v", "s", 0.5, 1).collect()] == [(1, 2, 3.0)]


def test_cells_that_cannot_reach_are_not_compared(spark):
    """Clusters along the leading components: only cells of one cluster meet at a high cosine."""
    rng = np.random.default_rng(9)
    x = np.eye(8)[rng.integers(0, 4, 400)] + rng.normal(scale=0.02, size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], 0.0) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE")
    groups = vectors.unit_vectors(vectors.vector_groups(df, "id", "v", "s"), "v").select("id", "_unit")
    placed = vectors._with_cell(vectors._rotated(groups, 8), 5)
    cells = placed.select("cell").distinct().count()
    assert vectors._reachable_cells(placed, 5, 8, 0.9).count() < 0.5 * cells * (cells + 1) / 2


@pytest.mark.parametrize("most", [30, 32768])
def test_vectors_travel_once_to_a_block(spark, monkeypatch, most):
    """However many cells can reach each other, a vector is sent to blocks of them, and the pairs are right."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(256, 10))
    df = spark.createDataFrame([(i, [float(v) for v in r], float(i % 5)) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE").repartition(4)
    staged, write = {}, vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda table, name="stage": staged.setdefault(name, write(table, name)) if name == "block-pairs" else write(table, name))
    found = vectors.close_pairs(df, "id", "v", "s", 0.2, 1, cells=64, block_rows=4, most_rows=most).collect()
    c = cosine(x)
    assert {(r["a"], r["b"]) for r in found} == {(i, j) for i in range(256) for j in range(i + 1, 256) if c[i, j] >= 0.2 and i % 5 != j % 5}
    assert len(found) == len({(r["a"], r["b"]) for r in found}) and all(abs(c[r["a"], r["b"]] - r["cosine"]) < 1e-12 for r in found)
    blocks = staged["block-pairs"]
    assert blocks.select("a").distinct().count() > 40 and blocks.select("block_a").distinct().count() <= vectors.BLOCKS


def test_neighbours_and_their_layout(spark):
    """Rings: neighbours along a ring stay neighbours, and the graph has nearly all of the true ones."""
    rng = np.random.default_rng(6)
    angle = rng.uniform(0, 2 * np.pi, 500)
    lift = rng.normal(size=(4, 24))
    x = np.stack([np.cos(angle), np.sin(angle), 0.5 * np.cos(2 * angle), 0.5 * np.sin(2 * angle)], 1) @ lift
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>").repartition(4)
    graph = vectors.neighbour_graph(df, "id", "v", 8).cache()
    c = cosine(x)
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i, r in enumerate(np.argsort(-c, 1)[:, :8]) for j in r}
    found = {(r["a"], r["b"]): r["cosine"] for r in graph.collect()}
    assert len(found) == 4000 and len(true & set(found)) >= 0.98 * 4000
    assert all(abs(c[e] - v) < 1e-9 for e, v in found.items())
    layout = vectors.project_neighbours(df, "id", "v", graph=graph, steps=120)
    kept = vectors.kept_neighbours(layout, "id", graph, 8).first()["kept"]
    assert kept > 0.5 and layout.count() == 500


def test_rows_around_a_hub_are_bounded(spark, monkeypatch):
    """A vector that is a neighbour of all others has no more rows around it than any other, and the graph is right."""
    n, k = 160, 3
    x = 0.6 * np.eye(n + 1)
    x[:, 0] = 1.0
    x[0] = np.eye(n + 1)[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>").repartition(4)
    around, write = [], vectors.stage

    def noted(table, name="stage"):
        kept = write(table, name)
        if name == "near":
            around.append(kept.groupBy("a").count().agg(F.max("count")).first()[0])
        return kept

    monkeypatch.setattr(vectors, "stage", noted)
    graph = vectors.neighbour_graph(df, "id", "v", k, descents=4).collect()
    assert max(around) <= k + vectors.REVERSE * k
    assert len(graph) == (n + 1) * k and {r["a"] for r in graph if r["b"] == 0} >= set(range(1, n // 2))
    c = cosine(x)
    assert all(abs(c[r["a"], r["b"]] - r["cosine"]) < 1e-12 for r in graph)


def test_pairs_at_hubs_are_those_that_can_enter_the_graph():
    """Against brute force: hubs of many sizes, cut anywhere into batches."""
    rng = np.random.default_rng(3)
    k, rows, want = 4, [], set()
    x, floor = rng.normal(size=(60, 5)), rng.uniform(-1, 0.5, 60)
    c = cosine(x)
    for hub in range(40):
        members = sorted(rng.choice(60, rng.integers(1, 13), replace=False).tolist())
        new = {m: bool(rng.random() < 0.4) for m in members}
        rows += [(hub, m, new[m], floor[m], x[m].tolist()) for m in members]
        for a in members:
            met = sorted((b for b in members if b != a and (new[a] or new[b])), key=lambda b: -c[a, b])
            want |= {(a, b) for b in met[:k] if c[a, b] >= floor[a]}
    table = pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(("a", "b", "new", "floor", "place"))})
    for size in (1, 7, 1000):
        got = [(a, b) for batch in vectors._pairs_at_hubs(k)(table.to_batches(size)) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        assert set(got) == want


def test_layout_of_tiny_tables(spark):
    schema = "id BIGINT, v ARRAY<DOUBLE>"
    assert vectors.project_neighbours(spark.createDataFrame([], schema), "id", "v").count() == 0
    one = vectors.project_neighbours(spark.createDataFrame([(4, [1.0, 2.0])], schema), "id", "v").collect()
    assert [tuple(r) for r in one] == [(4, 0.0, 0.0)]
    three = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], schema)
    assert vectors.project_neighbours(three, "id", "v", steps=4).count() == 3


def brute_pairs(rows, least, gap):
    """Every two rows (id, vector, score) in plain Python; nulls are in no pair."""
    rows = [r for r in rows if None not in r]
    c = cosine(np.array([r[1] for r in rows]))
    return sorted(
        (i, j, round(float(c[x, y]), 5), abs(s - t))
        for x, (i, _, s) in enumerate(rows)
        for y, (j, _, t) in enumerate(rows)
        if i < j and c[x, y] >= least and abs(s - t) >= gap
    )


@pytest.mark.parametrize("most_copies,most_rows,cells", [(256, 32768, None), (3, 7, 8)])
def test_every_copy_of_a_vector_is_in_its_pairs(points, spark, monkeypatch, most_copies, most_rows, cells):
    """Copies are pairs among each other and with all that is near them; keys may repeat, nulls are in no pair."""
    monkeypatch.setattr(vectors, "MOST_COPIES", most_copies)
    monkeypatch.setattr(vectors, "MOST_PAIRS", 100)
    x, label, _ = points
    rows = [(i, [float(v) for v in x[i]], float(label[i])) for i in range(len(x))]
    rows += [(7, [float(v) for v in x[9]], 3.0), rows[65], (None, rows[0][1], 9.0), (500, None, 1.0), (501, rows[0][1], None), (502, [2 * v for v in rows[0][1]], 0.0)]
    df = spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE").repartition(4)
    found = vectors.close_pairs(df, "id", "v", "s", 0.95, 2, cells, 40, most_rows, every_copy=True)
    assert sorted((r["a"], r["b"], round(r["cosine"], 5), r["gap"]) for r in found.collect()) == brute_pairs(rows, 0.95, 2)


def test_every_copy_in_tables_of_one_vector(spark):
    schema = "id BIGINT, v ARRAY<DOUBLE>, s DOUBLE"
    find = lambda rows, least=0.5: sorted(map(tuple, vectors.close_pairs(spark.createDataFrame(rows, schema), "id", "v", "s", least, 1, every_copy=True).collect()))
    assert find([]) == [] and find([(1, [1.0, 0.1], 0.0)]) == []
    same = [(i, [0.3, 0.1], float(i % 2)) for i in range(700)]  # several rows of copies
    for n in (5, 700):
        assert find(same[:n], 1.0) == [(i, j, 1.0, 1.0) for i in range(n) for j in range(i + 1, n) if (i + j) % 2]
    assert find([(i, [0.0, 0.0], float(i)) for i in range(3)]) == []  # nothing has a length of zero for its direction


def test_query_of_close_pairs_has_all_pairs_of_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8))
    rows = [(i, [float(v) for v in x[i % 30]], i % 4) for i in range(90)]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = close_pairs(spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"], r["cosine"], r["gap"]) for r in found) == brute_pairs(rows, 0.35, 1)
