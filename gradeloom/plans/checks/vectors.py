"""Windows, pooling, clustering and similar vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradeloom.operators import vectors
from gradeloom.plans.checks.tables import documents, table

VOWELS = "aeiou"


def windows(spark, folder):
    return vectors.token_windows(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "chunk", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("md5")
    )


def mean_pool(spark, folder):
    pooled = vectors.mean_pool(table(spark, folder, "embeddings").withColumn("label", F.col("label").cast("bigint")), "label")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "value")).select("label", "pos", F.round("value", 6).alias("value"))


def make_vowel_encoder():
    """An encoder for the check: the share of each vowel in a text."""

    def encode(texts):
        return np.array([[t.count(v) / max(len(t), 1) for v in VOWELS] for t in texts], dtype=float)

    return encode


def encoded(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = vectors.embed_texts(docs, "doc_id", make_vowel_encoder)
    return found.select("doc_id", *[F.round(F.col("embedding")[i], 9).alias(v) for i, v in enumerate(VOWELS)])


def assembled(spark, folder):
    """Embedding first, then the features; checked through the first and last places."""
    rows = table(spark, folder, "embeddings").withColumns({"a": F.col("vec_id") * 2.0, "b": F.col("label") + 0.5})
    v = vector_to_array("features")
    return vectors.assemble(rows, ["a", "b"], "embedding").select("vec_id", *[
        F.round(x, 6).alias(n) for n, x in (("first", v[0]), ("a", F.element_at(v, -2)), ("b", F.element_at(v, -1)))
    ], F.size(v).cast("bigint").alias("size"))


def silhouettes(spark, folder):
    return vectors.silhouettes(table(spark, folder, "embeddings"), "label").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


def silhouette_profile(spark, folder):
    scored = vectors.silhouettes(table(spark, folder, "embeddings"), "label").withColumn("silhouette", F.round("silhouette", 6))
    return vectors.silhouette_profile(scored, "label", "vec_id").select("vec_id", "label", "silhouette", "position", "cluster_size")


def kmeans_sweep(spark, folder):
    return vectors.kmeans_sweep(table(spark, folder, "embeddings"), 4)


def projection(spark, folder):
    return vectors.project_2d(table(spark, folder, "embeddings")).select("vec_id", "x", "y")


def close_pairs(spark, folder):
    pairs = vectors.close_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.35, 1, every_copy=True)
    return pairs.withColumns({"cosine": F.round("cosine", 5), "gap": F.round("gap", 6)})


def similar_pairs(spark, folder):
    """Every vector and its coarse copy (whole eighths, labels one up), joined by random projections."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("double").alias("label"))
    coarse = rows.select((-1 - F.col("vec_id")).alias("vec_id"), F.transform("embedding", lambda x: F.floor(x * 8 + 0.5).cast("double")).alias("embedding"), (F.col("label") + 1).alias("label"))
    pairs = vectors.similar_pairs(rows.unionByName(coarse), "vec_id", "embedding", "label", 0.9, 1, recall=0.99999)
    return pairs.withColumns({"cosine": F.round("cosine", 5), "gap": F.round("gap", 6)})


QUERIES = {
    "g12_token_windows": windows,
    "g13_mean_pool": mean_pool,
    "g14_encoder": encoded,
    "g5_assembled_vectors": assembled,
    "g15_kmeans_sweep": kmeans_sweep,
    "g16_silhouettes": silhouettes,
    "g17_silhouette_profile": silhouette_profile,
    "g18_projection": projection,
    "e9_close_pairs": close_pairs,
    "e9_similar_pairs": similar_pairs,
}

_WINDOWS = """
  (SELECT doc_id, c AS chunk, toks[CAST(c AS BIGINT) * 382 + 1 : CAST(c AS BIGINT) * 382 + 510] AS t
   FROM (SELECT doc_id, toks, unnest(range(greatest(CAST(ceil((len(toks) - 510) / 382) AS BIGINT) + 1, 1))) AS c
         FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS toks FROM documents)))"""

_UNIT = "(SELECT vec_id, label, [x / n FOR x IN e] AS u FROM (SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)))"

_SILHOUETTE = f"""
  (WITH d AS (
     SELECT a.vec_id, a.label AS own, b.label AS other, count(*) AS n, sum(1 - list_dot_product(a.u, b.u)) AS total
     FROM {_UNIT} a, {_UNIT} b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
   m AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL)
   SELECT vec_id, own AS label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM m)"""

ORACLES = {
    "g12_token_windows": f"""
        SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS md5 FROM {_WINDOWS}""",
    "g13_mean_pool": """
        SELECT label, pos, round(avg(value), 6) AS value FROM (
          SELECT CAST(label AS BIGINT) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
        GROUP BY label, pos""",
    "g14_encoder": f"""
        SELECT doc_id, {', '.join(f"round(avg((length(t) - length(replace(t, '{v}', ''))) / greatest(length(t), 1)), 9) AS {v}" for v in VOWELS)}
        FROM (SELECT doc_id, array_to_string(t, ' ') AS t FROM {_WINDOWS}) GROUP BY doc_id""",
    "g5_assembled_vectors": """
        SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS "first", CAST(vec_id * 2 AS DOUBLE) AS a, CAST(label + 0.5 AS DOUBLE) AS b,
               CAST(len(embedding) + 2 AS BIGINT) AS size FROM embeddings""",
    "g16_silhouettes": f"SELECT vec_id, round(s, 6) AS silhouette FROM {_SILHOUETTE}",
    "g17_silhouette_profile": f"""
        SELECT vec_id, label, silhouette, row_number() OVER (PARTITION BY label ORDER BY silhouette, vec_id) AS position,
               count(*) OVER (PARTITION BY label) AS cluster_size
        FROM (SELECT vec_id, label, round(s, 6) AS silhouette FROM {_SILHOUETTE})""",
    "e9_close_pairs": f"""
        SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 5) AS cosine, round(CAST(abs(a.label - b.label) AS DOUBLE), 6) AS gap
        FROM {_UNIT} a JOIN {_UNIT} b ON a.vec_id < b.vec_id
        WHERE list_dot_product(a.u, b.u) >= 0.35 AND abs(a.label - b.label) >= 1""",
    "e9_similar_pairs": """
        WITH given AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
        every AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, e FROM given UNION ALL SELECT -1 - vec_id, label + 1, [floor(x * 8 + 0.5) FOR x IN e] FROM given),
        unit AS (SELECT vec_id, label, [x / n FOR x IN e] AS u FROM (SELECT *, sqrt(list_sum([x * x FOR x IN e])) AS n FROM every))
        SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 5) AS cosine, round(abs(a.label - b.label), 6) AS gap
        FROM unit a JOIN unit b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.9 AND abs(a.label - b.label) >= 1""",
}
