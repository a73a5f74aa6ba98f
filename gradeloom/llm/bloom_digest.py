"""Similarity digests of improbable features.

Every window of 64 bytes has a Shannon entropy, kept up by what enters and leaves as the
window slides. How rare an entropy is in the whole corpus ranks the window: rare is low. In
each run of 64 windows the leftmost window of lowest rank gets a point, and windows with
enough points are the text's features. Features go into a chain of small Bloom filters, a
new one after every 160, and two digests are compared by the overlap of their filters'
bits, between what chance gives (0) and all bits of the smaller filter (1).

The arithmetic is whole numbers only, and texts are padded apart from each other, so equal
texts have equal fingerprints wherever they stand.
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import text_or_empty

WINDOW, RUN, POINTS = 64, 64, 8
#: Entropies in thousandths of the largest; windows outside of these say nothing.
LEAST, MOST = 100, 990
BITS, ELEMENTS, HASHES = 2048, 160, 5
#: Overlap up to this share of the way from chance to full counts as none.
SLACK = 0.1
#: Bytes of texts that are worked on together.
CHUNK = 1 << 18

_TERM = [0] + [round(c * math.log2(c) * 4096) for c in range(1, WINDOW + 1)]
_FULL = round(WINDOW * math.log2(WINDOW) * 4096)
_NONE = (1 << 62) - 1


def entropies(np, data):
    """Entropy bins (0..1000) of all windows of a byte array that starts with a window of zeros."""
    n = len(data)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    term = np.array(_TERM, np.int64)
    leaves = np.zeros(WINDOW, np.int64)
    leaves[:] = term[:-1] - term[1:]  # count a+1 to a
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _FULL
    step = leaves[after[: n - WINDOW]] - leaves[np.minimum(before[WINDOW:], WINDOW - 1)]
    np.cumsum(step, out=total[1:])
    total[1:] += _FULL
    return (_FULL - total) * 1000 // _FULL


def joined(np, texts: list[bytes]):
    """Texts with zeros in front of, between and behind them, and where each of them starts."""
    pad = bytes(WINDOW)
    starts, at = [], WINDOW
    for t in texts:
        starts.append(at)
        at += len(t) + WINDOW
    return np.frombuffer(pad + b"".join([t + pad for t in texts]), np.uint8), starts


def own_windows(np, size: int, starts: list[int], texts: list[bytes]):
    """Which windows lie within a text."""
    edge = np.zeros(size + 1, np.int8)
    for start, t in zip(starts, texts):
        if len(t) >= WINDOW:
            edge[start] += 1
            edge[start + len(t) - WINDOW + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def histogram(np, texts: list[bytes]):
    total = np.zeros(1001, np.int64)
    for part in chunks(texts):
        data, starts = joined(np, part)
        bins = entropies(np, data)
        total += np.bincount(bins[own_windows(np, len(bins), starts, part)], minlength=1001)
    return total


def chunks(texts: list[bytes]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + WINDOW
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def ranks_of(np, counts):
    """Rank of every entropy bin, the rarest first; -1 for bins that say nothing."""
    order = np.argsort(counts, kind="stable")
    ranks = np.empty(1001, np.int64)
    ranks[order] = np.arange(1001)
    ranks[:LEAST] = -1
    ranks[MOST + 1 :] = -1
    return ranks


def _mix(np, rows):
    """64-bit hashes of windows given as rows of eight words."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(rows.shape[1]):
        h ^= rows[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


def features(np, texts: list[bytes], ranks) -> list:
    """Hashes of the features of each text, in order, without repeats."""
    out = []
    for part in chunks(texts):
        data, starts = joined(np, part)
        bins = entropies(np, data)
        rank = ranks[bins]
        rank[~own_windows(np, len(bins), starts, part)] = -1
        keys = np.where(rank >= 0, (rank << 40) | np.arange(len(rank)), _NONE)
        low, width = keys, 1
        while width < RUN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = low[low != _NONE] & ((1 << 40) - 1)
        places = np.flatnonzero(np.bincount(low, minlength=1) >= POINTS) if len(low) else np.empty(0, np.int64)
        found = _mix(np, np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].copy().view(np.uint64))
        of = np.searchsorted(np.array(starts), places, side="right") - 1
        cut = np.searchsorted(of, np.arange(len(part) + 1))
        for i, t in enumerate(part):
            own = found[cut[i] : cut[i + 1]]
            if len(own) == 0 and t:  # too short or too plain for a window: the whole text is the feature
                size = -(-len(t) // 8) * 8
                own = _mix(np, np.frombuffer(t.ljust(size, b"\0") + len(t).to_bytes(8, "little"), np.uint64).reshape(1, -1))
            if len(own) > 1:
                _, first = np.unique(own, return_index=True)
                own = own[np.sort(first)]
            out.append(own)
    return out


def filters(np, hashes):
    """A chain of Bloom filters (rows of bytes) and the elements in each."""
    n = len(hashes)
    rows = -(-n // ELEMENTS)
    bits = np.zeros((rows, BITS), bool)
    chain = np.arange(n) // ELEMENTS
    for k in range(HASHES):
        bits[chain, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(bits, axis=1), np.bincount(chain, minlength=rows)


def to_string(np, chain, sizes) -> str:
    return f"{','.join(map(str, sizes.tolist()))}:{base64.b64encode(chain.tobytes()).decode()}" if len(sizes) else ""


def from_string(np, text: str):
    if not text:
        return np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64)
    sizes, data = text.split(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, BITS // 8), np.array(sizes.split(","), np.int64)


def likeness(np, one, other) -> float:
    """Overlap of two digests, 0 to 1: every filter of the shorter chain with its best match in the longer, by elements."""
    (a, a_sizes), (b, b_sizes) = sorted((one, other), key=lambda d: (len(d[1]), int(d[1].sum()), d[0].tobytes()))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a):
        return 0.0
    a_bits, b_bits = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row, own, size in zip(a, a_bits, a_sizes):
        both = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        most = np.minimum(own, b_bits)
        least = own * b_bits / BITS
        cut = least + SLACK * (most - least)
        total += size * float(np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1).max())
    return round(total / float(a_sizes.sum()), 9)


def rarity(docs: DataFrame, text_column: str = "text") -> list[int]:
    """Ranks of the 1001 entropy bins, from all windows of all texts."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1001, np.int64)
        for batch in batches:
            total += histogram(np, [t.encode() for t in batch.column(0).to_pylist()])
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(total[kept], pa.int64())], names=["bin", "n"])

    import numpy as np

    counts = np.zeros(1001, np.int64)
    for bin_, n in docs.select(text_or_empty(text_column).alias("t")).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        counts[bin_] = n
    return ranks_of(np, counts).tolist()


def fingerprints(docs: DataFrame, ranks: list[int] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and ``fingerprint`` of every row; null and empty texts have an empty fingerprint. Nothing is shuffled."""
    ranks = rarity(docs, text_column) if ranks is None else ranks

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(ranks)
        for batch in batches:
            found = features(np, [t.encode() for t in batch.column(1).to_pylist()], table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_string(np, *filters(np, h)) for h in found], pa.string())], names=[id_column, "fingerprint"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_or_empty(text_column).alias("t")).mapInArrow(run, f"`{id_column}` {kind}, fingerprint string")


def neighbours(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows in descending order of the id, in buckets of ids, so that a row and its next one share a partition.

    Cuts of the ids come from approximate quantiles. The first row of a bucket is copied to
    the bucket before it (that of the first bucket to the last), marked ``extra``. A null id
    comes after all others, rows with one id follow by their texts. Texts are shuffled once.
    """
    import numpy as np

    spark = docs.sparkSession
    lowest = -(1 << 63)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"), F.coalesce(F.col(id_column), F.lit(lowest)).cast("long").alias("key"))
    found = rows.approxQuantile("key", [i / (4 * parts) for i in range(1, 4 * parts)], 0.25 / (4 * parts))
    cuts = np.unique(np.array(found, np.float64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype(np.float64)).astype(np.int32))

    first = dict(rows.select("key").groupBy(bucket("key").alias("bucket")).agg(F.max("key")).collect())  # a row for each cut
    order = sorted(first)
    goes_to = {first[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def buckets(key: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, key.to_numpy().astype(np.float64)).tolist()
        return pd.Series([[o, goes_to[k]] if k in goes_to else [o] for k, o in zip(key.tolist(), own)])

    dealt = rows.withColumn("buckets", buckets("key")).select("id", "text", "key", F.posexplode("buckets").alias("extra", "bucket"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "text")


def edited_likeness(docs: DataFrame, ranks: list[int] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text ends with the start of the next document's text (descending ids, after
    the last the first) in place of its own second half. A table with a single row has
    itself as the next one; an empty table gives no rows. Other columns are not read.
    """
    ranks = rarity(docs, text_column) if ranks is None else ranks
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table = np.array(ranks)

        def digest(texts):
            return [filters(np, h) for h in features(np, [t.encode() for t in texts], table)]

        def rows(batch):
            return zip(*(batch.column(i).to_pylist() for i in range(4)))  # id, text, extra, bucket

        def solve(held, kind):
            """Rows of ``held`` but the last, each with the one behind it if that is in its bucket."""
            own = [(i, r) for i, r in enumerate(held[:-1]) if r[2] == 0 and held[i + 1][3] == r[3]]
            plain = digest([r[1] for r in held])
            changed = [r[1][: len(r[1]) - len(r[1]) // 2] + held[i + 1][1][: len(r[1]) // 2] for i, r in own]
            edited = digest(changed)
            columns = [
                pa.array([r[0] for _, r in own], kind),
                pa.array([len(r[1]) for _, r in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([to_string(np, *plain[i]) for i, _ in own], pa.string()),
                pa.array([to_string(np, *e) for e in edited], pa.string()),
                pa.array([likeness(np, plain[i], e) for (i, _), e in zip(own, edited)], pa.float64()),
                pa.array([likeness(np, plain[i], plain[i + 1]) for i, _ in own], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: list = []
        for batch in batches:
            held += rows(batch)
            if len(held) > 1:
                yield solve(held, batch.column(0).type)
                held = held[-1:]

    kind = dict(docs.dtypes)[id_column]
    ordered = neighbours(docs, id_column, text_column).select("id", "text", "extra", "bucket")
    return ordered.mapInArrow(run, f"`{id_column}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
