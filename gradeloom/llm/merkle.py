"""Merkle manifest of a dataset: a root over all documents, and a proof for each of them.

Every document is a leaf, a hash over its fields. Leaves are ordered by id within their
language; two neighbours at a time are hashed into the level above until one is left, the
language's subroot; subroots are combined alike into the root.

Built levels are stored as node rows that are linked to a parent. A link spans ``LEVELS``
levels: a row has the siblings on the way and which side they stand on, so that a tree over
10^10 leaves is climbed in five steps and not in 36. A recursive query starts at each leaf,
appends the siblings of its link to the proof, folds the (possibly tampered) hash with them,
and goes on at the parent until there is none.

A block of 2 ** ``LEVELS`` neighbours is the largest group that one task sees, whatever the
size of a language: positions come from ranges, not from one window over the language.
"""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.llm.common import ensure_shared, stage
from gradeloom.operators.ordered import null_safe, with_rank

#: Levels that a link spans; a block has two to this power.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NONE, LEFT, RIGHT = 0, 1, 2


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hex(raw: str) -> str:
    return f"lower(hex({raw}))"


def _fold(hash_: str, sides: str, siblings: str) -> str:
    """SQL: a hash (hex) carried up along a link, whose siblings (32 bytes each) stand on ``sides``."""
    sibling = _hex(f"substring({siblings}, s.at, 32)")
    return (
        f"aggregate({sides}, named_struct('h', {hash_}, 'at', 1), (s, side) -> named_struct("
        f"'h', CASE side WHEN {NONE} THEN sha2(s.h, 256) WHEN {LEFT} THEN sha2(concat({sibling}, s.h), 256) ELSE sha2(concat(s.h, {sibling}), 256) END, "
        f"'at', s.at + IF(side = {NONE}, 0, 32)), s -> s.h)"
    )


def _above(level: Column) -> Column:
    """The level above: hashes of every two neighbours, the last one alone if they are odd."""
    pairs = F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))), 256))


def _ascend(nodes: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Link the nodes of each group (columns group, pos, hash) to the top of their block of neighbours.

    The first table has group, pos, hash, the columns ``kept``, ``sides``, ``siblings`` and ``up``
    (position of the top among the tops of the group), the second the tops (group, pos, hash).
    A group of one block ascends to its single top, others by ``LEVELS`` levels.
    """
    size = 1 << LEVELS
    block = F.shiftright("pos", LEVELS)
    sizes = nodes.groupBy("group").agg(F.count("*").alias("n"))
    row = F.struct("pos", "hash", *kept)
    blocks = null_safe(nodes.groupBy("group", block.alias("up")).agg(F.array_sort(F.collect_list(row)).alias("rows")), sizes, ["group"])
    # a block of a larger group is carried up through all levels, also where it is the last and short
    few = F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    depth = F.when(F.col("n") > size, LEVELS).otherwise(few).cast("int")
    heights = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(
        heights,
        F.array(F.transform("rows", lambda r: F.lower(F.hex(r["hash"])))),
        lambda built, _: F.concat(built, F.array(_above(F.element_at(built, -1)))),
    )
    built = blocks.select("group", "up", "rows", heights.alias("heights"), levels.alias("levels"))

    def link(r, i):
        def step(height):
            at = F.call_function("shiftright", i, height - 1)
            sibling = F.get(F.get("levels", height - 1), at.bitwiseXOR(F.lit(1)))
            side = F.when(sibling.isNull(), NONE).when(at.bitwiseAND(F.lit(1)) == 1, LEFT).otherwise(RIGHT)
            return F.struct(side.cast("byte").alias("side"), F.coalesce(sibling, F.lit("")).alias("sibling"))

        return F.struct(r["pos"].alias("pos"), r["hash"].alias("hash"), *[r[c].alias(c) for c in kept], F.transform("heights", step).alias("way"))

    linked = built.select("group", "up", F.explode(F.transform("rows", link)).alias("row")).select("group", "up", "row.*")
    sides, siblings = F.transform("way", lambda w: w["side"]), F.unhex(F.array_join(F.transform("way", lambda w: w["sibling"]), ""))
    tops = built.select("group", F.col("up").alias("pos"), F.unhex(F.get(F.element_at("levels", -1), F.lit(0))).alias("hash"))
    return linked.select("group", "pos", "hash", *kept, sides.alias("sides"), siblings.alias("siblings"), "up"), tops


def _node(tree: str, height: int, pos: str, group: str) -> Column:
    """The name of a node; null groups are told from empty ones."""
    return F.concat(F.lit(f"{tree}{height}:"), F.col(pos).cast("string"), F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")))


def _climb_groups(tops: DataFrame, tree: str, nodes: list[DataFrame]) -> tuple[DataFrame, int]:
    """Build the levels above ``tops`` until each group has one node; node rows go to ``nodes``.

    Gives the last node of every group (group, hash, node) and how many links it took.
    """
    height, done = 1, []
    while True:
        sizes = tops.groupBy("group").agg(F.count("*").alias("n"))
        counted = null_safe(tops, sizes, ["group"])
        done.append(counted.filter("n = 1").select("group", "hash", _node(tree, height, "pos", "group").alias("node")))
        several = counted.filter("n > 1").select("group", "pos", "hash")
        if several.limit(1).count() == 0:
            last = done[0]
            for more in done[1:]:
                last = last.unionByName(more)
            return last, height
        linked, above = _ascend(several, [])
        linked = stage(linked, "merkle-links")
        nodes.append(linked.select(_node(tree, height, "pos", "group").alias("node"), "hash", "sides", "siblings", _node(tree, height + 1, "up", "group").alias("parent"), F.lit(False).alias("is_subroot")))
        tops = stage(above, "merkle-tops")
        height += 1


@contextmanager
def _unlimited(spark: SparkSession):
    """A recursive query may return as many rows as it has; it ends by itself at the root."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Links of all leaves, the node rows above them, and the root (None without leaves).

    ``leaves`` has group, id, leaf and tampered (32 bytes each, the latter null where nothing changed).
    """
    spark = leaves.sparkSession
    ranked = with_rank(leaves, ["group"], ["id", "leaf", "tampered"], "rank")
    placed = ranked.select("group", (F.col("rank") - 1).alias("pos"), F.col("leaf").alias("hash"), "id", "tampered")
    linked, tops = _ascend(stage(placed, "merkle-leaves"), ["id", "tampered"])
    linked = stage(linked, "merkle-links")
    nodes: list[DataFrame] = []
    subroots, _ = _climb_groups(stage(tops, "merkle-tops"), "n", nodes)
    # subroots are the leaves of one more tree, whose group is all of them
    ordered = with_rank(stage(subroots, "merkle-subroots"), [], ["group"], "rank")
    upper = ordered.select(F.lit("").alias("group"), (F.col("rank") - 1).alias("pos"), "hash", "node")
    joints, tops = _ascend(stage(upper, "merkle-upper"), ["node"])
    joints = stage(joints, "merkle-links")
    top, _ = _climb_groups(stage(tops, "merkle-tops"), "t", nodes)
    root = top.first()
    nodes.append(joints.select("node", "hash", "sides", "siblings", _node("t", 1, "up", "group").alias("parent"), F.lit(True).alias("is_subroot")))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    # nothing is above the root, so links to it end the climb
    end = F.lit(root["node"] if root else None)
    every = every.withColumn("parent", F.when(F.col("parent") != end, F.col("parent")))
    starts = linked.select("id", "hash", "tampered", "sides", "siblings", _node("n", 1, "up", "group").alias("node"))
    return starts, stage(every, "merkle-nodes"), root["hash"] if root else None


def climb(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ascend from each leaf: id, leaf, subroot, proof (siblings, 32 bytes each) and folded (hex).

    The rows of a recursive query come from all of its steps; the ones at the root have no node left.
    """
    spark = starts.sparkSession
    names = [f"merkle_{part}_{uuid4().hex}" for part in ("starts", "nodes")]
    starts.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    query = f"""
        WITH RECURSIVE climb(id, leaf, node, subroot, proof, folded) AS (
          SELECT id, hash, node, CAST(NULL AS BINARY), siblings, {_fold(_hex("coalesce(tampered, hash)"), "sides", "siblings")} FROM {names[0]}
          UNION ALL
          SELECT c.id, c.leaf, n.parent, coalesce(c.subroot, IF(n.is_subroot, n.hash, NULL)), concat(c.proof, n.siblings), {_fold("c.folded", "n.sides", "n.siblings")}
          FROM climb c JOIN {names[1]} n ON c.node = n.node)
        SELECT id, leaf, subroot, proof, folded FROM climb WHERE node IS NULL"""
    try:
        with _unlimited(spark):
            return stage(spark.sql(query), "merkle-climb")
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def manifest(docs: DataFrame, tampers: Column | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    ``tampers`` says of which rows the copy under test has one more in ``n_chars`` than the
    manifest; without it nothing is tampered with. A null ``n_chars`` stays, and a null answer
    is no. Null fields are hashed as ``-``; documents without a language have a subroot of
    their own, before all others. Rows under one id go by their leaf, null ids come first;
    repeated rows are a leaf each, with the same fields but proofs of their own place. A
    single document is its own subroot and root, with an empty proof. An empty table gives no
    rows. Other columns are not read.
    """
    ensure_shared(docs.sparkSession)
    value = {f: F.col(f"`{f}`") for f in FIELDS}
    changed = value | {"n_chars": value["n_chars"] + 1}
    hit = F.coalesce(tampers, F.lit(False)) if tampers is not None else F.lit(False)
    leaves = docs.select(
        value["lang"].alias("group"),
        value["doc_id"].alias("id"),
        F.unhex(leaf_hash(*value.values())).alias("leaf"),
        F.when(hit & value["n_chars"].isNotNull(), F.unhex(leaf_hash(*changed.values()))).alias("tampered"),
    )
    starts, nodes, root = build(leaves)
    text = lambda c: F.lower(F.hex(c))
    found = climb(starts, nodes).withColumn("root", F.lit(bytes(root).hex() if root else None).cast("string"))
    return found.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        "root",
        F.sha2(text("proof"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def tampered_sample(id_column: str = "doc_id") -> Column:
    """Ids whose decimal digits have a CRC that 7 divides."""
    return F.crc32(F.col(id_column).cast("string")) % 7 == 0
