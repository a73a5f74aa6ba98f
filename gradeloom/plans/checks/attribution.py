"""Shapley values, mined ranges, recommendations and their messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import attribution as at
from gradeloom.operators import recommend as rec
from gradeloom.operators.forest import fit_forest, predict
from gradeloom.plans.checks.tables import EVENTS, events
from gradeloom.schemas import LEAVES
from gradeloom.session import spread, stage

COLUMNS = ["value", "user_id", "k"]
INF = float("inf")

# two small trees: (tree, leaf, value, feature, lo, hi)
FIXED_LEAVES = [
    (0, 0, 1.0, 0, -INF, 30.0),
    (0, 1, 4.0, 0, 30.0, INF),
    (0, 1, 4.0, 1, -INF, 60.0),
    (0, 2, 9.0, 0, 30.0, INF),
    (0, 2, 9.0, 1, 60.0, INF),
    (1, 0, -2.0, 2, -INF, 40.0),
    (1, 0, -2.0, 0, -INF, 70.0),
    (1, 1, 6.0, 2, -INF, 40.0),
    (1, 1, 6.0, 0, 70.0, INF),
    (1, 1, 6.0, 1, -INF, 90.0),
    (1, 2, 0.5, 2, -INF, 40.0),
    (1, 2, 0.5, 0, 70.0, INF),
    (1, 2, 0.5, 1, 90.0, INF),
    (1, 3, 3.0, 2, 40.0, INF),
]


def _rows(spark, folder):
    return spread(events(spark, folder), "event_id").select("event_id", *[F.col(c).cast("double").alias(c) for c in COLUMNS], "ts")


def fixed_leaves(spark, folder):
    """Every event explained against all events."""
    rows = _rows(spark, folder)
    phi = at.attribute(rows, rows, spark.createDataFrame(FIXED_LEAVES, LEAVES), COLUMNS, "event_id")
    # nine digits: effects are sums of short decimals, which would meet exact halves at six
    return phi.select("row_id", "feature", F.round("phi", 9).alias("phi"))


def _fitted(spark, folder):
    rows = stage(_rows(spark, folder).withColumn("label", F.col("value") + F.when(F.col("k") > 50, F.col("user_id")).otherwise(0)), "rows")
    return rows, fit_forest(rows, COLUMNS, "label", trees=3, max_depth=5)


def _adds_up(rows, model, columns):
    """Whether an event's effects against all events add up to its prediction less the mean prediction."""
    phi = at.attribute_forest(rows, rows, model, columns, "event_id", background_rows=None)
    predicted = stage(predict(rows, model, columns).select(F.col("event_id").alias("row_id"), "prediction"), "predicted")
    mean = predicted.agg(F.avg("prediction")).scalar()
    gap = F.abs(F.sum("phi") + mean - F.first("prediction"))
    return phi.join(predicted, "row_id").groupBy("row_id").agg((gap < 1e-6).alias("adds_up"))


def forest_attribution(spark, folder):
    """Effects of a fitted forest add up to its prediction: the gap is 0 for every row."""
    rows, model = _fitted(spark, folder)
    return _adds_up(rows, model, COLUMNS)


def deep_forest_attribution(spark, folder):
    """The same for trees of depth 12 over eight features, whose paths have up to eight of them."""
    rows = _rows(spark, folder)
    more = {f"d{i}": F.pmod(F.col("event_id") * (2 * i + 7) + F.col("k") * i, F.lit(19 + 6 * i)).cast("double") for i in range(5)}
    label = F.col("value") + F.col("user_id") * F.col("d0") / 9 + F.abs(F.col("d1") - F.col("k")) - F.col("d2") * F.col("d3") / 5 + F.col("d4")
    rows = stage(rows.withColumns(more).withColumn("label", label), "rows")
    columns = [*COLUMNS, *more]
    return _adds_up(rows, fit_forest(rows, columns, "label", trees=3, max_depth=12, min_leaf=3), columns)


def forest_leaves(spark, folder):
    """The boxes of a fitted forest hold every row exactly once per tree."""
    rows, model = _fitted(spark, folder)
    leaves = at.leaf_boxes(at.forest_nodes(spark, model))
    path = F.sort_array(F.collect_list(F.struct("feature", "lo", "hi")))
    return leaves.groupBy("tree", "leaf").agg(F.first("value").alias("value"), F.to_json(path).alias("box"))


def _as_attribution(spark, folder):
    """Events read as attributions: the type is the feature, k - 50 the effect."""
    return events(spark, folder).select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("feature"), F.lit(0).alias("pos"), "value", (F.col("k") - 50).alias("phi")
    )


def mined_from_events(spark, folder):
    return rec.mine_ranges(_as_attribution(spark, folder))


def merged_effects(spark, folder):
    fixed = rec.fixed_effects(spark, {"click": "never", "share": "always"})
    return rec.override_effects(mined_from_events(spark, folder), fixed).select("feature", "kind", "lo", "hi")


EFFECTS = [("value", "range", 10.0, 60.0), ("user_id", "never", None, None), ("k", "range", 20.0, 70.0)]
MESSAGES = [(f, d, f"{d} {f}") for f in COLUMNS for d in ("increase", "decrease")]


def _advised(spark, folder):
    """Advice for events whose effects are simple functions of their columns; every tenth score is an end of the scale."""
    rows = spread(events(spark, folder), "event_id")
    score = F.when(F.col("k") < 5, F.lit(-1.0)).when(F.col("k") < 10, F.lit(10.0)).otherwise(F.col("k") / 16)
    number = {c: F.col(c).cast("double") for c in COLUMNS}
    effects = {"value": F.col("value") - 30, "user_id": F.col("k") - F.col("user_id"), "k": F.col("user_id") - 75}
    scored = rows.select(
        F.col("event_id").alias("row_id"),
        score.alias("score"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in COLUMNS]), F.array(*number.values())).alias("extracted_features"),
        F.lit(20).alias("effective_lines"),
        F.array(*[effects[c].cast("double") for c in COLUMNS]).alias("phi"),
    )
    return rec.recommend_rows(
        scored, spark.createDataFrame(EFFECTS, "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE"),
        rec.dependencies_table(spark, 1, {}), COLUMNS, log_features=[],
    )


def _advised_from_long(spark, folder):
    """The same through the long attribution table."""
    wide = _advised(spark, folder).drop("recommendations")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), F.col("extracted_features")[c].alias("value"), F.col("phi")[i].alias("phi"))
        for i, c in enumerate(COLUMNS)
    ])
    long = wide.select("row_id", F.inline(pairs))
    return rec.recommend(
        wide, long, spark.createDataFrame(EFFECTS, "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE"),
        rec.dependencies_table(spark, 1, {}), log_features=[],
    )


def _advice_text(df):
    parts = F.transform("recommendations", lambda r: F.concat_ws(":", r["feature"], r["direction"]))
    return df.select("row_id", F.array_join(parts, ",").alias("advice"))


def recommendations(spark, folder):
    return _advice_text(_advised(spark, folder))


def recommendations_from_long(spark, folder):
    return _advice_text(_advised_from_long(spark, folder))


#: Rules with everything in them: needs that are met or not, a lasting conflict of two features, and more faults than are reported.
RULED = ["characters", "line_length_std", "func_density", "long_line", "code_compactness", "has_docstring"]
RULED_EFFECTS = [
    ("characters", "range", 20.0, 60.0), ("line_length_std", "range", 20.0, 70.0), ("func_density", "never", None, None),
    ("long_line", "never", None, None), ("code_compactness", "range", 1.0, 1.0), ("has_docstring", "always", None, None),
]
RULED_NEEDS = {"line_length_std": {"effective_lines": 10}, "code_compactness": {"func_density": 0, "effective_lines": 15}}


def rules_with_needs(spark, folder):
    """Advice by all rules: each event is a file whose measures are small functions of its columns."""
    rows = spread(events(spark, folder), "event_id")
    k, user = F.col("k").cast("double"), F.col("user_id").cast("double")
    number = {
        "characters": F.col("value"), "line_length_std": k, "func_density": user % 3, "long_line": k % 2, "code_compactness": user % 4, "has_docstring": (user + k) % 2,
    }
    scored = rows.select(
        F.col("event_id").alias("row_id"),
        F.lit(5.0).alias("score"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in RULED]), F.array(*[number[c].cast("double") for c in RULED])).alias("extracted_features"),
        (F.col("k") % 23).cast("int").alias("effective_lines"),
        # an order of the features that differs from event to event
        F.array(*[((F.col("event_id") * (2 * i + 3) + 5 * i) % 17).cast("double") for i in range(len(RULED))]).alias("phi"),
    )
    effects = spark.createDataFrame(RULED_EFFECTS, "feature STRING, kind STRING, lo DOUBLE, hi DOUBLE")
    return _advice_text(rec.recommend_rows(scored, effects, rec.dependencies_table(spark, 1, RULED_NEEDS), RULED, log_features=[]))


def messages(spark, folder):
    texts = rec.messages_table(spark, 1, MESSAGES)
    shown = rec.with_message(_advised(spark, folder), texts)
    # the score's own digits are left to the unit tests: the engines round halves differently
    return shown.select("row_id", F.regexp_replace("message", r"score: [-0-9.]+", "score:").alias("message"))


def effect_lookup(spark, folder):
    """Events with the effect mined for their type."""
    effects = stage(mined_from_events(spark, folder), "effects")  # its real size makes the join a broadcast
    return _as_attribution(spark, folder).join(effects, "feature").select(
        "row_id", "feature", "kind", F.col("value").between(F.col("lo"), F.col("hi")).alias("inside")
    )


def ranked_features(spark, folder):
    """Features of an event by rising effect."""
    from pyspark.sql import Window as W

    rows = events(spark, folder)
    long = rows.select(
        F.col("event_id").alias("row_id"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), (F.col(c) - 50).cast("double").alias("phi")) for i, c in enumerate(COLUMNS)])),
    )
    return long.withColumn("place", F.row_number().over(W.partitionBy("row_id").orderBy("phi", "pos")))


QUERIES = {
    "h1_fixed_leaves": fixed_leaves,
    "h1_forest_adds_up": forest_attribution,
    "h1_deep_forest_adds_up": deep_forest_attribution,
    "h2_forest_leaves": forest_leaves,
    "h3_mined_ranges": mined_from_events,
    "h4_merged_effects": merged_effects,
    "h5_recommendations": recommendations,
    "h5_recommendations_from_long": recommendations_from_long,
    "h5_rules_with_needs": rules_with_needs,
    "h6_messages": messages,
    "e4_effect_lookup": effect_lookup,
    "f16_ranked_features": ranked_features,
}

_LEAF_ROWS = ", ".join(
    f"({tree}, {leaf}, CAST({value} AS DOUBLE), {feature}, CAST('{lo}' AS DOUBLE), CAST('{hi}' AS DOUBLE))"
    for tree, leaf, value, feature, lo, hi in FIXED_LEAVES
)
_FIXED_SQL = f"""
  WITH leaves AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf ORDER BY f) - 1 AS bit
                  FROM (VALUES {_LEAF_ROWS}) AS t(tree, leaf, v, f, lo, hi)),
  size AS (SELECT tree, leaf, count(*) AS n FROM leaves GROUP BY ALL),
  x AS (SELECT event_id, 0 AS f, value AS x FROM {EVENTS} UNION ALL SELECT event_id, 1, user_id FROM {EVENTS} UNION ALL SELECT event_id, 2, k FROM {EVENTS}),
  masks AS (SELECT event_id, tree, leaf, CAST(sum(CASE WHEN x > lo AND x <= hi THEN 1 << bit ELSE 0 END) AS BIGINT) AS m
            FROM x JOIN leaves USING (f) GROUP BY ALL),
  back AS (SELECT tree, leaf, m AS z, count(*) / (SELECT count(*) FROM events) AS share FROM masks GROUP BY ALL),
  pairs AS (SELECT event_id, tree, leaf, share, m & ~z AS a, z & ~m AS b, bit_count(m & ~z) AS na, bit_count(z & ~m) AS nb
            FROM masks JOIN back USING (tree, leaf) JOIN size USING (tree, leaf) WHERE (m | z) = (1 << n) - 1),
  parts AS (SELECT event_id, f, v * share * CASE
              WHEN (a >> bit) & 1 = 1 THEN factorial(CAST(na - 1 AS INTEGER)) * factorial(CAST(nb AS INTEGER)) / factorial(CAST(na + nb AS INTEGER))
              WHEN (b >> bit) & 1 = 1 THEN -1 * factorial(CAST(na AS INTEGER)) * factorial(CAST(nb - 1 AS INTEGER)) / factorial(CAST(na + nb AS INTEGER))
              ELSE 0 END AS phi
            FROM pairs JOIN leaves USING (tree, leaf) WHERE na + nb > 0)
  SELECT x.event_id AS row_id, ['value', 'user_id', 'k'][x.f + 1] AS feature, round(coalesce(sum(phi), 0) / 2, 9) AS phi
  FROM x LEFT JOIN parts ON parts.event_id = x.event_id AND parts.f = x.f GROUP BY x.event_id, x.f"""

MINED_SQL = f"""
  WITH s AS (SELECT event_type AS feature, value AS x, event_id,
                    row_number() OVER w AS r, sum(k - 50) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth
             FROM {EVENTS} WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)),
  i AS (SELECT *, r - row_number() OVER (PARTITION BY feature ORDER BY r) AS island FROM s WHERE smooth >= 0),
  runs AS (SELECT feature, island, min(r) AS first, min(x) AS lo, max(x) AS hi FROM i GROUP BY ALL),
  best AS (SELECT feature, lo, hi FROM runs QUALIFY row_number() OVER (PARTITION BY feature ORDER BY hi - lo DESC, first) = 1)
  SELECT f.feature, CASE WHEN lo IS NULL THEN 'never' ELSE 'range' END AS kind, lo, hi
  FROM (SELECT DISTINCT event_type AS feature FROM events) f LEFT JOIN best USING (feature)"""

_WANTED = f"""
  (SELECT event_id AS row_id, k,
     list_sort([
       x FOR x IN [
         {{'phi': value - 30, 'pos': 0, 'text': CASE WHEN value < 10 THEN 'value:increase' WHEN value > 60 THEN 'value:decrease' END}},
         {{'phi': k - user_id, 'pos': 1, 'text': CASE WHEN user_id > 0 THEN 'user_id:decrease' END}},
         {{'phi': user_id - 75.0, 'pos': 2, 'text': CASE WHEN k < 20 THEN 'k:increase' WHEN k > 70 THEN 'k:decrease' END}}
       ] IF x.text IS NOT NULL AND k >= 10]) AS items
   FROM {EVENTS})"""



def _rules_sql() -> str:
    """The rules step by step: one layer for every feature in its turn, each of at most two changes, and the conflict of two features."""
    has = lambda at, f: f"len(list_filter({at}, lambda x: split_part(x, ':', 1) = {f})) > 0"
    parts = [f"""
      m AS (SELECT event_id AS row_id, value, CAST(k AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS u, CAST(k AS INTEGER) % 23 AS lines FROM {EVENTS}),
      asked AS (SELECT row_id, lines, u % 3 AS density, list_sort([
          {{'phi': (row_id * 3) % 17, 'pos': 0, 'f': 'characters', 'd': CASE WHEN value < 20 THEN 'increase' WHEN value > 60 THEN 'decrease' END}},
          {{'phi': (row_id * 5 + 5) % 17, 'pos': 1, 'f': 'line_length_std', 'd': CASE WHEN k < 20 THEN 'increase' WHEN k > 70 THEN 'decrease' END}},
          {{'phi': (row_id * 7 + 10) % 17, 'pos': 2, 'f': 'func_density', 'd': CASE WHEN u % 3 > 0 THEN 'decrease' END}},
          {{'phi': (row_id * 9 + 15) % 17, 'pos': 3, 'f': 'long_line', 'd': CASE WHEN k % 2 > 0 THEN 'decrease' END}},
          {{'phi': (row_id * 11 + 20) % 17, 'pos': 4, 'f': 'code_compactness', 'd': CASE WHEN u % 4 < 1 THEN 'increase' WHEN u % 4 > 1 THEN 'decrease' END}},
          {{'phi': (row_id * 13 + 25) % 17, 'pos': 5, 'f': 'has_docstring', 'd': CASE WHEN (u + k) % 2 = 0 THEN 'increase' END}}]) AS items FROM m),
      a0 AS (SELECT *, CAST([] AS VARCHAR[]) AS advice FROM asked)"""]
    for i in range(1, len(RULED) + 1):
        item = f"items[{i}]"
        parts += [
            f"""c{i} AS (SELECT *, CASE
                WHEN {item}.d IS NULL OR len(advice) >= 3 OR {has('advice', item + '.f')} THEN CAST([] AS VARCHAR[])
                WHEN {item}.f = 'line_length_std' THEN [CASE WHEN lines > 10 THEN {item}.f || ':' || {item}.d ELSE 'effective_lines:increase' END]
                WHEN {item}.f = 'code_compactness' THEN [CASE WHEN density > 0 THEN {item}.f || ':' || {item}.d ELSE 'func_density:increase' END,
                                                      CASE WHEN lines > 15 THEN {item}.f || ':' || {item}.d ELSE 'effective_lines:increase' END]
                ELSE [{item}.f || ':' || {item}.d] END AS changes FROM a{i - 1})""",
            *[
                f"""{name} AS (SELECT * REPLACE (CASE WHEN len(changes) < {n} THEN advice
                    WHEN {has('advice', f"split_part(changes[{n}], ':', 1)")} THEN [CASE WHEN split_part(x, ':', 1) = split_part(changes[{n}], ':', 1) THEN changes[{n}] ELSE x END FOR x IN advice]
                    ELSE list_append(advice, changes[{n}]) END AS advice) FROM {before})"""
                for n, name, before in ((1, f"p{i}", f"c{i}"), (2, f"q{i}", f"p{i}"))
            ],
            f"""a{i} AS (SELECT * EXCLUDE (changes) REPLACE (CASE WHEN len(changes) > 0 AND {has('advice', "'characters'")} AND {has('advice', "'effective_lines'")}
                THEN [x FOR x IN advice IF split_part(x, ':', 1) <> 'characters'] ELSE advice END AS advice) FROM q{i})""",
        ]
    return f"WITH {', '.join(parts)} SELECT row_id, coalesce(array_to_string(advice, ','), '') AS advice FROM a{len(RULED)}"


ORACLES = {
    "h5_rules_with_needs": _rules_sql(),
    "h1_fixed_leaves": _FIXED_SQL,
    "h1_forest_adds_up": "SELECT event_id AS row_id, true AS adds_up FROM events",
    "h1_deep_forest_adds_up": "SELECT event_id AS row_id, true AS adds_up FROM events",
    "h3_mined_ranges": MINED_SQL,
    "h4_merged_effects": f"""
        SELECT feature, CASE WHEN feature = 'click' THEN 'never' ELSE kind END AS kind,
               CASE WHEN feature = 'click' THEN NULL ELSE lo END AS lo, CASE WHEN feature = 'click' THEN NULL ELSE hi END AS hi
        FROM ({MINED_SQL}) UNION ALL SELECT 'share', 'always', NULL, NULL""",
    "h5_recommendations": f"SELECT row_id, coalesce(array_to_string([x.text FOR x IN items], ','), '') AS advice FROM {_WANTED}",
    "h5_recommendations_from_long": f"SELECT row_id, coalesce(array_to_string([x.text FOR x IN items], ','), '') AS advice FROM {_WANTED}",
    "h6_messages": f"""
        SELECT row_id, CASE
            WHEN k < 5 THEN 'Not a valid python code or code contains no logic' || chr(10) || chr(10)
            WHEN k < 10 THEN 'Estimated score:' || chr(10) || chr(10) || 'Code is perfect! No suggestions' || chr(10) || chr(10)
            ELSE 'Estimated score:' || chr(10) || chr(10) || 'Suggested improvements:' || chr(10) || chr(10)
                 || coalesce(array_to_string([split_part(x.text, ':', 2) || ' ' || split_part(x.text, ':', 1) || chr(10) || chr(10) FOR x IN items], ''), '')
          END AS message FROM {_WANTED}""",
    "e4_effect_lookup": f"""
        SELECT e.event_id AS row_id, m.feature, m.kind, e.value BETWEEN m.lo AND m.hi AS inside
        FROM events e JOIN ({MINED_SQL}) m ON e.event_type = m.feature""",
    "f16_ranked_features": f"""
        SELECT event_id AS row_id, pos, phi, CAST(row_number() OVER (PARTITION BY event_id ORDER BY phi, pos) AS INTEGER) AS place FROM (
          SELECT event_id, 0 AS pos, value - 50 AS phi FROM {EVENTS} UNION ALL SELECT event_id, 1, CAST(user_id - 50 AS DOUBLE) FROM {EVENTS}
          UNION ALL SELECT event_id, 2, k - 50 FROM {EVENTS})""",
}
