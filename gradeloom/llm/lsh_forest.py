"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Texts with one shingle set are one class. Every class has a signature of ``VALUES`` minima
and stands in ``TREES`` sorted orders, each over another permutation of the signature. Its
candidates are the neighbours in those orders that share a prefix of ``LEAST`` values with
it. The depth adapts to the region by itself: where few classes share a short prefix, they
are each other's neighbours; where thousands do, the order goes on by deeper values, and
the neighbours are those with the longest common prefix.

A crowded region holds more classes than a window shows. There the rest is found by
walking: a class's near neighbours name the best linked class among their own partners, the
hub of the region, and the class is checked against it, until the walk meets no new pair.
Where classes resemble each other without links there is no hub; so crowded regions with
several components go through further orders, which run deeper and are over longer
signatures, ``ORDERS`` of them at a time. How deep a region is crowded is measured in each
order, and a class leaves when the orders it has been in would have shown a partner at the
threshold but for one case in 1 / ``MISS``, were what it shares with the partner like what it
shares with the region. As it need not be, the links of a round also say how many there are
that no order has shown (from those seen once and twice), and the whole region goes on until
that is next to none. Neither candidates nor partners are capped.
Every candidate is first estimated by its sketch and then, if it can be a link at all,
counted exactly on the full sets. Links are compared as whole numbers.

Documents stay where they are: only signatures and ids are sorted and joined, and the texts
of classes with candidates are fetched once for the exact counts. Orders are cut into
ranges, not into groups, so a region with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import forget, recorded, stage, text_or_empty, whole_row

SHINGLE = 5
VALUES, TREES, DEPTH, LEAST = 192, 24, 20, 4
#: Neighbours on each side in each order.
NEAR = 6
#: Standard deviations of the estimate below the threshold at which a pair is given up.
SIGMAS = 4.5
#: Minima and depth of the further orders in crowded regions, rows seen on each side, and values that a pair has to share.
LONG, DEEP, WIDE, SHARED, HEAD = 3072, 40, 32, 2, 3
#: How probably a class of a crowded region may miss a partner at the threshold, and standard deviations of the long estimate.
MISS, LONG_SIGMAS = 1e-4, 3.5
#: Further orders in a round, the estimate of links unseen at which a region is finished, and orders after which that alone decides.
ORDERS, UNSEEN, MOST_ORDERS = 64, 0.1, 512
#: Bits a wanted text or class has in a filter, how many of them it sets, and the most bits in all (more rows then pass).
SPARE, SET_BITS, MOST_BITS = 16, 3, 1 << 27
SEED = 20


def _constants(np):
    draw = np.random.default_rng(SEED)
    odd = lambda n, bits: draw.integers(0, 1 << bits, n, dtype=np.uint64) | np.uint64(1)
    return {
        "bytes": odd(256, 63),
        "base": np.uint64(0x9E3779B97F4A7C15),
        "words": odd(SHINGLE, 63),
        "scale": odd(VALUES, 32).astype(np.uint32),
        "shift": odd(VALUES, 32).astype(np.uint32),
        "orders": np.stack([draw.permutation(VALUES)[:DEPTH] for _ in range(TREES)]),
    }


def _mix(np, h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, shingle: int = SHINGLE):
        import numpy as np

        self.np, self.shingle = np, shingle
        self.c = _constants(np)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(self.c["base"]), -1, 1 << 64))
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        np = self.np
        size = max(n, 2 * len(self.powers), 1 << 15)
        for name, base in (("powers", self.c["base"]), ("inverses", self.inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, text: str):
        """A hash for every word, A to Z lowered, by sums over powers of a base."""
        np = self.np
        data = np.frombuffer(text.encode().lower(), np.uint8)
        if len(data) + 1 > len(self.powers):
            self._grow(len(data) + 1)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.space[data]
        edge = np.diff(inside)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.c["bytes"][data] * self.powers[: len(data)], out=sums[1:])
        return _mix(np, (sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64))

    def shingles(self, text: str):
        np = self.np
        words = self.words(text)
        if not len(words):
            return np.empty(0, np.uint64)
        size = min(self.shingle, len(words))
        total = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            total += words[k : k + len(total)] * self.c["words"][k % SHINGLE] * np.uint64(2 * (k // SHINGLE) + 1)
        return np.unique(_mix(np, total))

    def signature(self, hashes):
        """Minima of ``VALUES`` linear maps of the hashes, folded to 16 bits."""
        np = self.np
        low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 256):
            part = x[at : at + 256, None] * self.c["scale"] + self.c["shift"]
            np.minimum(low, part.min(axis=0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def _node(hashes) -> bytes | None:
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signatures(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """Id, ``mark`` (hash of the text), ``n_shingles``, ``node`` (name of the shingle set) and ``sig`` of every row."""

    def run(batches):
        import pyarrow as pa

        s = Shingler(shingle)
        for batch in batches:
            sets = [s.shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_node(x) for x in sets], pa.binary()),
                    pa.array([s.signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                ],
                names=["id", "mark", "n_shingles", "node", "sig"],
            )

    text = text_or_empty(text_column)
    kind = dict(docs.dtypes)[id_column]
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), text.alias("t")).mapInArrow(
        run, f"id {kind}, mark long, n_shingles long, node binary, sig binary"
    )


def _prefixes(classes: DataFrame) -> DataFrame:
    """``node`` and the hashed shortest prefix of each of its orders."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        orders = _constants(np)["orders"]
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES)
            # four 16-bit values fill 64 bits; the order's number is mixed in
            keys = np.zeros((len(sig), TREES), np.uint64)
            for k in range(LEAST):
                keys = (keys << np.uint64(16)) | sig[:, orders[:, k]].astype(np.uint64)
            keys = _mix(np, keys ^ (np.arange(TREES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            flat = pa.array(keys.view(np.int64).ravel())
            offsets = pa.array(np.arange(0, flat.__len__() + 1, TREES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["node", "keys"])

    return classes.select("node", "sig").mapInArrow(run, "node binary, keys array<long>").select("node", F.explode("keys").alias("key"))


def _orders(classes: DataFrame) -> DataFrame:
    """A row for each class and order: ``place`` (order, then values) and a 4-bit sketch of the signature."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        orders = _constants(np)["orders"]
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES)
            nodes = batch.column(0).to_pylist()
            low = (sig & 15).astype(np.uint8)
            sketches = [r.tobytes() for r in low[:, ::2] | (low[:, 1::2] << 4)]
            for tree, order in enumerate(orders):
                places = [bytes([tree]) + r.tobytes() for r in np.ascontiguousarray(sig[:, order])]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())], names=["place", "node", "sketch"])

    return classes.select("node", "sig").mapInArrow(run, "place binary, node binary, sketch binary")


def _agreement(np, a, b):
    """Estimated similarity from 4-bit sketches, freed from what agrees by chance."""
    x = a ^ b
    same = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
    return (same / VALUES - 1 / 16) / (15 / 16)


def _least_estimate(threshold: float) -> float:
    p = 1 / 16 + 15 / 16 * threshold
    return threshold - SIGMAS * math.sqrt(p * (1 - p) / VALUES) * 16 / 15


def _neighbour_pairs(ordered: DataFrame, threshold: float) -> DataFrame:
    """Pairs of neighbours in sorted partitions (kind next to each other, or pair), and the rows at both ends of each partition (edge)."""
    least = _least_estimate(threshold)
    head = 1 + 2 * LEAST

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(kind, a, b, place=None, sketch=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(place or [None] * n, pa.binary()), pa.array(sketch or [None] * n, pa.binary())],
                names=["kind", "a", "b", "place", "sketch"],
            )

        held = ([], [], [])
        started = False
        for batch in batches:
            rows = tuple(batch.column(i).to_pylist() for i in range(3))
            if not started:
                yield out("edge", rows[1][:NEAR], [None] * len(rows[1][:NEAR]), rows[0][:NEAR], rows[2][:NEAR])
                started = True
            old = len(held[0])
            place, node, sketch = (h + r for h, r in zip(held, rows))
            places = np.frombuffer(b"".join(p[:head] for p in place), np.uint8).reshape(-1, head)
            sketches = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), -1)
            for gap in range(1, min(NEAR, len(place) - 1) + 1):
                a, b = [], []
                first = np.arange(max(0, old - gap), len(place) - gap)
                first = first[(places[first] == places[first + gap]).all(1)]
                first = first[_agreement(np, sketches[first], sketches[first + gap]) >= least] if len(first) else first
                for i in first.tolist():
                    one, other = node[i], node[i + gap]
                    a.append(min(one, other))
                    b.append(max(one, other))
                if a:
                    found = list(dict.fromkeys(zip(a, b)))
                    yield out("next" if gap == 1 else "pair", [x for x, _ in found], [y for _, y in found])
            held = tuple(x[-NEAR:] for x in (place, node, sketch))
        if started:
            yield out("edge", held[1], [None] * len(held[1]), held[0], held[2])

    return ordered.mapInArrow(run, "kind string, a binary, b binary, place binary, sketch binary")


def active_classes(classes: DataFrame) -> DataFrame:
    """Classes that share a shortest prefix; ``crowded`` if with more classes than a window is sure to show."""
    keys = _prefixes(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return stage(keys.join(shared, "key").groupBy("node").agg((F.max("n") > NEAR + 1).alias("crowded")), "forest-active")


def candidates(classes: DataFrame, threshold: float, active: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a < b) of classes that are neighbours in some order and can reach the threshold; ``next``: with none between them."""
    spark = classes.sparkSession
    active = active_classes(classes) if active is None else active
    rows = _orders(_passing(classes.select("node", "sig"), active).join(active, "node", "left_semi"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage(_neighbour_pairs(rows.repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node"), threshold), "forest-pairs")
    # neighbours on both sides of a cut between partitions: a few rows for each partition
    edges = found.filter("kind = 'edge'").select("place", F.col("a").alias("node"), "sketch").distinct()
    # a pair stands in one order, so each order's edges are a task of their own
    across = _neighbour_pairs(edges.repartition(TREES, F.substring("place", 1, 1)).sortWithinPartitions("place", "node"), threshold)
    pairs = found.select("kind", "a", "b").union(across.select("kind", "a", "b")).filter("kind <> 'edge' AND a < b")
    return pairs.groupBy("a", "b").agg(F.max(F.col("kind") == "next").alias("next"))


def _filter_bits(wanted: DataFrame, *columns: str):
    """A Bloom filter over columns of ``wanted`` (``id`` and ``mark``), as 64-bit words; its size is bounded, also in what the driver gets."""
    import numpy as np

    size = min(max(wanted.count() * SPARE, 1 << 16), MOST_BITS) // 64 * 64
    h = F.xxhash64(*(columns or ("id", "mark")))
    low, step = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = wanted.select(F.explode(F.array(*[(low + i * step) % size for i in range(SET_BITS)])).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _may_be_wanted(np, table, hashes):
    """Which of some hashes the filter lets pass; none that is wanted is stopped."""
    size = len(table) * 64
    low, step = hashes & 0xFFFFFFFF, ((hashes >> 32) & 0xFFFFFFFF) | 1
    passed = np.ones(len(hashes), bool)
    for i in range(SET_BITS):
        place = (low + i * step) % size
        passed &= (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return passed


def _passing(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``node`` is not in ``nodes`` (staged, no node twice); a join on ``node`` has to follow.

    Signatures and sets are wide, and a join to a list that is too long for a broadcast shuffles
    all of them, however few are in it. Here only what passes a small filter is left to shuffle.
    """
    table = rows.sparkSession.sparkContext.broadcast(_filter_bits(nodes, "node"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            passed = _may_be_wanted(np, table.value, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(passed))

    return rows.select(F.xxhash64("node").alias("h"), *rows.columns).mapInArrow(run, rows.schema)


def _fetch_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """``node`` and ``hashes`` of wanted classes, from one text of each (columns node, id, mark of ``wanted``).

    Texts are not shuffled: each task keeps those whose id and mark pass a small filter, and of
    the sets that these make the join on ``node`` leaves the wanted ones.
    """
    table = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        s = Shingler(shingle)
        for batch in batches:
            passed = _may_be_wanted(np, table.value, batch.column(0).to_numpy())
            sets = [s.shingles(t) for t in batch.column(1).filter(pa.array(passed)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "hashes"])

    text = text_or_empty(text_column)
    rows = docs.select(F.xxhash64(F.col(id_column), F.xxhash64(text)).alias("h"), text.alias("t"))
    sets = rows.mapInArrow(run, "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    return sets.join(wanted.select("node"), "node", "left_semi")


def _count(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of intersection (``both``) and union (``either``) of every pair, on full sets; only sets that a pair names are shuffled."""
    pairs = stage(pairs.select("a", "b"), "to-count")
    sets = _passing(sets, stage(_both_ways(pairs).select(F.col("a").alias("node")).distinct(), "to-count"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("other"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(run, "a binary, b binary, both long, either long")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(up: DataFrame) -> DataFrame:
    """``node`` and ``label``, where each pointer to a label has been followed to its end."""
    while True:
        over = up.select(F.col("node").alias("label"), F.col("label").alias("root"))
        up = stage(up.join(over, "label").select("node", "label", "root"), "labels")
        moved = up.filter("label <> root").limit(1).count()
        up = up.select("node", F.col("root").alias("label"))
        if not moved:
            return up


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (its component's smallest node) of every class that has a link.

    Every node points to its smallest neighbour, pointers are followed to their ends, and what
    links remain between different ends are the links of the next, smaller round.
    """
    edges, labels = stage(links.select("a", "b"), "links"), None
    while True:
        least = _both_ways(edges).groupBy("a").agg(F.min("b").alias("least"))
        up = _roots(stage(least.select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels"))
        if labels is None:
            labels = up
        else:
            further = up.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = stage(labels.join(further, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        own, other = (up.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        ends = edges.join(own, "a").join(other, "b").filter("label_a <> label_b")
        edges = stage(ends.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "links")
        if edges.limit(1).count() == 0:
            return labels


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components, with the labels."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    named = pairs.select("a", "b").join(own, "a", "left").join(other, "b", "left")
    return named.withColumns({"label_a": F.coalesce("label_a", "a"), "label_b": F.coalesce("label_b", "b")}).filter("label_a <> label_b")


def _hubs(links: DataFrame) -> DataFrame:
    """Every linked class (column b) with the one that has most links among itself and its partners."""
    linked = _both_ways(links)
    degree = linked.groupBy("a").agg(F.count("*").alias("degree"))
    partners = linked.join(degree.withColumnRenamed("a", "b"), "b").union(degree.select(F.col("a").alias("b"), "a", "degree"))
    return stage(partners.groupBy("a").agg(F.max(F.struct("degree", "b"))["b"].alias("hub")).withColumnRenamed("a", "b"), "hubs")


def _walk(near: DataFrame, seen: DataFrame, hubs: DataFrame) -> DataFrame:
    """New pairs: a class with the hub of a near neighbour in another component."""
    steps = _both_ways(near).join(hubs, "b").select("a", F.col("hub").alias("b")).filter("a <> b")
    pairs = steps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")


def _joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after new links: what is new links components, so join those, then rename."""
    joined = components(_apart(new, labels).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    names = joined.select(F.col("node").alias("label"), F.col("label").alias("root"))
    ends = _both_ways(new).select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    known = labels.unionByName(ends.join(labels.select("node"), "node", "left_anti"))
    return stage(known.join(names, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _settle(pairs: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Labels of all linked classes, and all pairs counted for them: count the pairs, join components, walk on, until the walk meets no new pair.

    Components only grow, so a pair within one is never looked at again. A pair that was
    counted leads on to the hub of its own other end; older pairs are walked anew only
    where new links have changed a hub.
    """
    linked = F.col("both") * 100 >= F.lit(threshold) * F.col("either")
    # what stands side by side joins most of a region; of the other pairs only those between components are left to count
    counted = [stage(_count(pairs.filter("next").select("a", "b"), sets), "counted")]
    labels = components(counted[0].filter(linked))
    counted.append(stage(_count(_apart(pairs.filter("NOT next"), labels).select("a", "b"), sets), "counted"))
    labels = _joined(labels, counted[1].filter(linked))
    every = reduce(DataFrame.union, counted)
    near = fresh = stage(_apart(every, labels).select("a", "b"), "near")
    hubs = _hubs(every.filter(linked))
    while True:
        more = stage(_count(_walk(fresh, every, hubs), sets), "counted")
        if more.limit(1).count() == 0:
            return labels, every.select("a", "b")
        every = every.union(more)
        new = more.filter(linked)
        if new.limit(1).count() == 0:
            near = near.union(more.select("a", "b"))
            fresh = stage(_apart(more, labels).select("a", "b"), "near")
            continue
        labels = _joined(labels, new)
        old, hubs = hubs.withColumnRenamed("hub", "old"), _hubs(every.filter(linked))
        changed = stage(hubs.join(old, "b", "left").filter(~F.col("hub").eqNullSafe(F.col("old"))).select("b"), "changed-hubs")
        near = stage(_apart(near, labels).select("a", "b"), "near")
        again = near.join(changed, "b", "left_semi").union(near.join(changed.withColumnRenamed("b", "a"), "a", "left_semi").select("a", "b"))
        further = stage(_apart(more, labels).select("a", "b"), "near")
        fresh = stage(further.union(again.select("a", "b")).distinct(), "near")
        near = near.union(further)


def _long_signatures(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sig`` (8 bits of each of ``LONG`` minima) in place of ``hashes``."""
    kept = [c for c in rows.columns if c != "hashes"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        draw = np.random.default_rng(SEED + 1)
        scale, shift = (draw.integers(0, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
        for batch in batches:
            sigs = []
            for x in batch.column(0).to_pylist():
                x = (np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)
                low = np.full(LONG, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 64):
                    np.minimum(low, (x[at : at + 64, None] * scale + shift).min(axis=0), out=low)
                sigs.append(((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sigs, pa.binary())], names=[*kept, "sig"])

    kinds = dict(rows.dtypes)
    return rows.select("hashes", *kept).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sig binary")


def _deep_orders(crowd: DataFrame, first: int, n: int) -> DataFrame:
    """A row for each class and each of ``n`` further orders: ``place`` (order, then values), node, label, live and a 2-bit sketch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        orders = [np.random.default_rng([SEED, k]).permutation(LONG)[:DEEP] for k in range(first, first + n)]
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, LONG)
            low = (sig & 3).reshape(len(sig), -1, 4)
            packed = low[:, :, 0] | (low[:, :, 1] << 2) | (low[:, :, 2] << 4) | (low[:, :, 3] << 6)
            sketches = pa.array([r.tobytes() for r in packed], pa.binary())
            for k, order in enumerate(orders):
                head = (first + k).to_bytes(HEAD, "big")
                places = pa.array([head + r.tobytes() for r in np.ascontiguousarray(sig[:, order])], pa.binary())
                yield pa.RecordBatch.from_arrays([places, *batch.columns[:3], sketches], names=["place", "node", "label", "live", "sketch"])

    return crowd.select("node", "label", "live", "sig").mapInArrow(run, "place binary, node binary, label binary, live boolean, sketch binary")


def _least_long_estimate(threshold: float) -> float:
    p = 1 / 4 + 3 / 4 * threshold
    return threshold - LONG_SIGMAS * math.sqrt(p * (1 - p) / LONG) * 4 / 3


def _deep_pairs(ordered: DataFrame, threshold: float) -> DataFrame:
    """Neighbours in sorted partitions that can be linked (kind pair, once for each ``turn``, an order), and how far each live class has been searched (kind seen).

    A class sees ``WIDE`` rows on each side. With k values in common with the furthest of them,
    every class that shares more than k values stands within. A partner at the threshold t does
    so with a probability of t ** (k + 1); ``miss`` is the logarithm of the other case. A cut
    between partitions ends the view, which counts as any other end does.
    """
    least = _least_long_estimate(threshold)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def common(places, i, j):
            """Values that rows i and j have in common from the start; none in different orders."""
            differ = places[i] != places[j]
            n = np.where(differ.any(1), differ.argmax(1), places.shape[1])
            return np.maximum(n - HEAD, 0)

        def out(kind, a, b, miss, turn):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(miss, pa.float64()), pa.array(turn, pa.int32())],
                names=["kind", "a", "b", "miss", "turn"],
            )

        def seen(rows, places, begin, end, last):
            """The view of rows begin to end (exclusive) in the buffer, whose last row is ``last``."""
            i = np.arange(begin, end)
            i = i[[rows[3][k] for k in i.tolist()]] if len(i) else i
            if len(i):
                depth = np.maximum(common(places, i, np.maximum(i - WIDE, 0)), common(places, i, np.minimum(i + WIDE, last))) + 1
                miss = np.log1p(-np.power(threshold, np.maximum(depth, SHARED)))
                yield out("seen", [rows[1][k] for k in i.tolist()], [None] * len(i), miss, [None] * len(i))

        held: tuple = ([], [], [], [], [])
        reported = 0  # rows of the buffer whose view is known
        for batch in batches:
            rows = tuple(h + c.to_pylist() for h, c in zip(held, batch.columns))
            old, n = len(held[0]), len(rows[0])
            places = np.frombuffer(b"".join(rows[0]), np.uint8).reshape(n, -1)
            sketches = np.frombuffer(b"".join(rows[4]), np.uint64).reshape(n, -1)
            names: dict[bytes, int] = {}
            labels = np.array([names.setdefault(x, len(names)) for x in rows[2]])
            live = np.array(rows[3])
            found = {}
            for gap in range(1, min(WIDE, n - 1) + 1):
                i = np.arange(max(0, old - gap), n - gap)
                i = i[(labels[i] != labels[i + gap]) & (live[i] | live[i + gap])]
                i = i[(places[i, : HEAD + SHARED] == places[i + gap, : HEAD + SHARED]).all(1)]
                for at in range(0, len(i), 1024):
                    j = i[at : at + 1024]
                    x = sketches[j] ^ sketches[j + gap]
                    other = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)
                    estimate = ((1 - other / LONG) - 1 / 4) * 4 / 3
                    for k in j[estimate >= least].tolist():
                        one, two = rows[1][k], rows[1][k + gap]
                        found[min(one, two), max(one, two), int.from_bytes(rows[0][k][:HEAD], "big")] = None
            if found:
                yield out("pair", [a for a, _, _ in found], [b for _, b, _ in found], [None] * len(found), [t for _, _, t in found])
            yield from seen(rows, places, reported, max(reported, n - WIDE), n - 1)
            keep = max(0, n - 2 * WIDE)
            reported = max(reported, n - WIDE) - keep
            held = tuple(x[keep:] for x in rows)
        if held[0]:
            n = len(held[0])
            yield from seen(held, np.frombuffer(b"".join(held[0]), np.uint8).reshape(n, -1), reported, n, n - 1)

    return ordered.mapInArrow(run, "kind string, a binary, b binary, miss double, turn int")


def _crowd(classes: DataFrame, crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes (node, label, live) that share a busy prefix with classes of other components.

    Of two components in a region the smaller one has to find the larger one, so a class is
    not ``live`` where its component is the largest under each of its busy prefixes.
    """
    named = crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    ranked = stage(named.join(sizes, "label", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long"))), "crowd-labels")
    own = _passing(classes.select("node", "sig"), ranked).join(ranked, "node", "left_semi")
    keys = stage(_prefixes(own).join(ranked, "node"), "crowd-keys")
    regions = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.struct("size", "label"))["label"].alias("top"))
    mixed = stage(regions.filter((F.col("n") > NEAR + 1) & (F.col("least") < F.col("most"))).select("key", "top"), "crowd-regions")
    return keys.join(mixed, "key").groupBy("node", "label").agg(F.max(F.col("label") != F.col("top")).alias("live"))


def _finish(labels: DataFrame, classes: DataFrame, crowded: DataFrame, sets: DataFrame, known: DataFrame, threshold: int, keep: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Labels after all links between components of crowded regions: further orders, as deep as each region needs.

    A class takes part until the orders so far would have shown a partner at the threshold
    with a probability of ``1 - MISS``, by the depths that its own region has had in them. A
    pair is found if either of its classes is searched that far, so those that are done leave
    and the rest of the region becomes thinner. Nobody leaves while the round's new links say
    that others are unseen (Chao's estimate from the links that one and that two orders have
    shown). A class whose window is full of its own component in every order is never searched
    that far by depth; after ``MOST_ORDERS`` the estimate alone decides. Staged tables but those of ``keep`` go.
    """
    share = threshold / 100
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowd = stage(_crowd(classes, crowded, labels), "crowd-members")
    crowd = stage(_long_signatures(crowd.join(_passing(sets, crowd), "node")), "crowd")
    done = stage(crowd.select("node", F.lit(0.0).alias("miss")), "crowd-searched")
    first = 0
    while crowd.filter("live").limit(1).count():
        rows = _deep_orders(crowd, first, ORDERS)
        found = stage(_deep_pairs(rows.repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node"), share), "crowd-found")
        shown = found.filter("kind = 'pair'").groupBy("a", "b").agg(F.count_distinct("turn").alias("times"))
        pairs = stage(shown.join(known, ["a", "b"], "left_anti"), "crowd-pairs")
        counted = stage(_count(pairs.select("a", "b"), sets), "counted")
        known = known.union(counted.select("a", "b"))
        new = counted.filter(F.col("both") * 100 >= F.lit(threshold) * F.col("either"))
        times = new.join(pairs, ["a", "b"]).agg(F.count_if(F.col("times") == 1).alias("once"), F.count_if(F.col("times") == 2).alias("twice"), F.count("*").alias("n")).first()
        if times["n"]:
            labels = _joined(labels, new)
        finished = times["once"] ** 2 / (2 * max(times["twice"], 1)) < UNSEEN
        more = found.filter("kind = 'seen'").select(F.col("a").alias("node"), "miss")
        done = stage(done.union(more).groupBy("node").agg(F.sum("miss").alias("miss")), "crowd-searched")
        enough = F.lit(first + ORDERS >= MOST_ORDERS) | (F.col("miss") <= math.log(MISS))
        searched = done.filter(enough & F.lit(finished)).select("node")
        left = crowd.join(searched, "node", "left_anti").drop("label").join(labels, "node", "left")
        crowd = stage(left.select("node", F.coalesce("label", "node").alias("label"), "live", "sig"), "crowd")
        first += ORDERS
        forget(crowd, done, labels, known, sets, *keep)
    return labels


def _judged(docs: DataFrame, id_column: str, text_column: str, threshold: int, shingle: int) -> DataFrame:
    """``id``, ``mark``, ``n_shingles``, ``component_id`` and ``first`` (whether this id and text stand for the component)."""
    with recorded([]):
        return _judged_rows(docs, id_column, text_column, threshold, shingle)


def _judged_rows(docs: DataFrame, id_column: str, text_column: str, threshold: int, shingle: int) -> DataFrame:
    share = threshold / 100
    rows = stage(signatures(docs, id_column, text_column, shingle), "signatures")
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark"))
    whole = rows.filter("node IS NOT NULL")
    classes = stage(whole.groupBy("node").agg(one.alias("one"), F.count("*").alias("n_rows"), F.first("sig").alias("sig")), "classes")
    active = active_classes(classes)
    pairs = stage(candidates(classes, share, active), "candidates")
    forget(rows, classes, active, pairs)
    crowded = active.filter("crowded").select("node")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded).distinct().join(classes.select("node", "one.id", "one.mark"), "node")
    wanted = stage(wanted, "wanted")
    sets = stage(_fetch_sets(docs, wanted, id_column, text_column, shingle), "sets")
    labels, known = _settle(pairs, sets, threshold)
    forget(rows, classes, active, sets, labels, known)
    labels = _finish(labels, classes, crowded, sets, known, threshold, (rows, classes))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("one").alias("one"), F.sum("n_rows").alias("n_rows"))
    # written, so that Spark can split the join for a class with very many rows
    of_node = stage(named.select("node", "label").join(least, "label").select("node", "one", "n_rows"), "class-components")
    joined = rows.select("id", "mark", "n_shingles", "node").join(of_node, "node", "left")
    forget(joined)
    alone = F.col("node").isNull() | (F.col("n_rows") == 1)
    return joined.select(
        "id",
        "mark",
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("one.id")).alias("component_id"),
        (alone | (F.col("id").eqNullSafe(F.col("one.id")) & (F.col("mark") == F.col("one.mark")))).alias("first"),
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where ``100 * intersection >= threshold * union`` of their shingle
    sets. ``component_id`` is the smallest id that links reach; ``kept`` marks the documents
    that have it. A text with fewer words than a shingle is one shingle; null and empty texts
    have none, are linked with nothing and are kept. Rows with null ids take part: null is
    no smallest id unless all of a component are null, and of those the one with the smallest
    hash of its text is kept. Equal rows share component and verdict. An empty table gives
    no rows. Other columns are not read.
    """
    kept = F.col("first") | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return _judged(docs, id_column, text_column, threshold, shingle).select(F.col("id").alias(id_column), "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one document of each component, with their columns.

    Of rows that share id and text one stays. Join and ranking use the same keys, so texts
    are shuffled once.
    """
    first = _judged(docs, id_column, text_column, threshold, shingle).filter("first").select(
        F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0).cast(dict(docs.dtypes)[id_column])).alias("some_id"), "mark"
    ).distinct()
    own_id = F.col(f"`{id_column}`")
    own = docs.select(
        whole_row(docs).alias("doc"),
        own_id.isNull().alias("no_id"),
        F.coalesce(own_id, F.lit(0).cast(dict(docs.dtypes)[id_column])).alias("some_id"),
        F.xxhash64(text_or_empty(text_column)).alias("mark"),
    )
    keys = ["no_id", "some_id", "mark"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc")))
    return own.join(first, keys, "left_semi").withColumn("rank", rank).filter("rank = 1").select("doc.*")
