"""Entropies by counting, fingerprints that depend on the text alone, edited texts by slicing."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import bloom_digest as bd


def texts(n=60):
    rnd = random.Random(3)
    for _ in range(n):
        yield " ".join("".join(rnd.choice("abcdefghijklmnopé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.choice([0, 1, 3, 12, 200, 900])))


def test_entropies_are_counted_right():
    given = [t.encode() for t in texts(12)] + [b"", b"a" * 200, bytes(range(256))]
    data, _ = bd.joined(np, given)
    bins = bd.entropies(np, data)
    for i in range(len(bins)):
        counts = Counter(data[i : i + bd.WINDOW].tobytes())
        assert bins[i] == (bd._FULL - sum(bd._TERM[c] for c in counts.values())) * 1000 // bd._FULL


def test_features_depend_on_the_text_alone():
    given = [t.encode() for t in texts()]
    ranks = bd.ranks_of(np, bd.histogram(np, given))
    together = bd.features(np, given, ranks)
    for t, found in zip(given, together):
        assert np.array_equal(bd.features(np, [t], ranks)[0], found)
        assert bool(len(found)) == bool(t)


def test_likeness():
    given = [t.encode() for t in texts() if len(t) > 2000]
    ranks = bd.ranks_of(np, bd.histogram(np, given))
    digest = lambda t: bd.filters(np, bd.features(np, [t], ranks)[0])
    for a, b in zip(given, given[1:]):
        assert bd.likeness(np, digest(a), digest(a)) == 1.0
        half = a[: len(a) // 2] + b[: len(a) // 2]
        assert bd.likeness(np, digest(a), digest(half)) > bd.likeness(np, digest(a), digest(b)) + 0.1
        assert bd.likeness(np, digest(a), digest(b)) == bd.likeness(np, digest(b), digest(a)) < 0.1
        text = bd.to_string(np, *digest(a))
        assert bd.likeness(np, bd.from_string(np, text), digest(a)) == 1.0
    assert bd.likeness(np, digest(b""), digest(b"")) == 1.0 and bd.likeness(np, digest(b""), digest(given[0])) == 0.0


def edited(rows):
    """Hashes of edited texts: descending ids, nulls last, ties by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(spark, odd, odd_rows, nothing):
    plain = list(enumerate(texts(200)))
    for rows, df in (([(i, t) for i, t, *_ in odd_rows], odd), (plain, spark.createDataFrame(plain, "doc_id long, text string").repartition(7)), (plain[:1], None)):
        df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
        got = bd.edited_likeness(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edited(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        alone = {(r.doc_id, r.fingerprint) for r in bd.fingerprints(df).collect()}
        assert {(r.doc_id, r.fingerprint) for r in got} == alone
    assert bd.edited_likeness(nothing).count() == 0 and bd.fingerprints(nothing).count() == 0


def test_equal_texts_have_equal_fingerprints(tables):
    rows = bd.fingerprints(tables.documents).join(tables.documents, "doc_id")
    assert rows.groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).filter("n > 1").count() == 0


def plain_hash(window: bytes) -> int:
    keep = (1 << 64) - 1
    h = 0x9E3779B97F4A7C15
    for k in range(0, len(window), 8):
        h ^= int.from_bytes(window[k : k + 8], "little")
        h = h * 0xFF51AFD7ED558CCD & keep
        h ^= h >> 32
        h = h * 0xC4CEB9FE1A85EC53 & keep
        h ^= h >> 29
    return h


def plain_features(text: bytes, ranks) -> list[int]:
    """Points for the rarest window of every run of windows, one run after the other."""
    rank = []
    for i in range(len(text) - bd.WINDOW + 1):
        counts = Counter(text[i : i + bd.WINDOW])
        rank.append(int(ranks[(bd._FULL - sum(bd._TERM[c] for c in counts.values())) * 1000 // bd._FULL]))
    points = Counter()
    for first in range(1 - bd.RUN, len(rank)):
        run = [(rank[i], i) for i in range(max(first, 0), min(first + bd.RUN, len(rank))) if rank[i] >= 0]
        if run:
            points[min(run)[1]] += 1
    windows = [text[i : i + bd.WINDOW] for i in sorted(points) if points[i] >= bd.POINTS]
    if not windows and text:
        windows = [text + bytes(-len(text) % 8) + len(text).to_bytes(8, "little")]
    return [plain_hash(w) for w in dict.fromkeys(windows)]


def plain_chain(hashes):
    """Bits of each filter of the chain, as sets."""
    chain = []
    for n, h in enumerate(hashes):
        if n % bd.ELEMENTS == 0:
            chain.append(set())
        chain[-1] |= {(h >> 11 * k) % bd.BITS for k in range(bd.HASHES)}
    return chain


def test_features_and_chain_against_a_plain_version():
    rnd = random.Random(5)
    given = [t.encode() for t in texts(40)] + [b"a" * 300, b"ab" * 200, bytes(rnd.randrange(256) for _ in range(500)), b"x" * 63, b"x" * 64, " né ".encode() * 90, " ".join(texts(25)).encode()]
    ranks = bd.ranks_of(np, bd.histogram(np, given))
    for t, found in zip(given, bd.features(np, given, ranks)):
        assert found.tolist() == plain_features(t, ranks)
        chain, sizes = bd.filters(np, found)
        plain = plain_chain(found.tolist())
        assert [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in chain] == plain
        assert sizes.tolist() == [min(bd.ELEMENTS, len(found) - i) for i in range(0, len(found), bd.ELEMENTS)]
    assert max(len(plain_chain(f.tolist())) for f in bd.features(np, given, ranks)) > 1


def test_likeness_against_sets():
    long = " ".join(texts(30))
    given = [t.encode() for t in texts() if len(t) > 1500][:6] + [long.encode(), (long[: len(long) // 2] + " and then something else").encode()]
    ranks = bd.ranks_of(np, bd.histogram(np, given))
    found = [bd.features(np, [t], ranks)[0] for t in given]
    for one in found:
        for other in found:
            a, b = sorted((one, other), key=lambda f: (-(-len(f) // bd.ELEMENTS), len(f), bd.filters(np, f)[0].tobytes()))
            x, y = plain_chain(a.tolist()), plain_chain(b.tolist())
            total = 0.0
            for k, own in enumerate(x):
                best = 0.0
                for bits in y:
                    most, least = min(len(own), len(bits)), len(own) * len(bits) / bd.BITS
                    cut = least + bd.SLACK * (most - least)
                    best = max(best, min(1.0, max(0.0, (len(own & bits) - cut) / max(most - cut, 1e-9))))
                total += best * min(bd.ELEMENTS, len(a) - k * bd.ELEMENTS)
            want = 1.0 if x == y else total / len(a)
            assert abs(bd.likeness(np, bd.filters(np, one), bd.filters(np, other)) - want) < 1e-8
