"""The audit against plain loops over documents and orders."""

import random
import re
from collections import Counter
from itertools import permutations

from gradeloom.llm import filter_audit as fa
from tests.llm.conftest import prose

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failed = []
    for i, t, p in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and i > least[t]:
            f.add("E")
        failed.append((i, p, f))
    out, shares = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, _, p in rows}:
            left = [(i, f) for i, p, f in failed if p == part]
            everything = left
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                kept = [(i, f) for i, f in left if name not in f]
                shares[part, name] += len(gone)
                out[part, order, step] = [
                    len(kept), len(gone), sum(name in f for _, f in everything) - len(gone), sum(f == {name} for _, f in everything),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                left = kept
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_against_loops(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    texts = [prose(rnd, 230) for _ in range(3)]
    for i in range(150):
        kind = rnd.randrange(7)
        text = [rnd.choice(texts), prose(rnd, 210), "a b c " * 90, prose(rnd, 205).upper(), prose(rnd, 202) + " 5 % | x", prose(rnd, 30), "A#" * 3][kind]
        rows.append((rnd.randrange(10_000), text, rnd.choice(["web", "book", None])))
        if rnd.random() < 0.5:
            labels.append((rows[-1][0], rnd.randrange(2), rnd.choice([0, 1, None])))
    labels += [labels[0], (None, 1, 1), (10_001, 1, 1)]
    docs = spark.createDataFrame([(i, t, p) for i, t, p in rows], "doc_id bigint, text string, source string").repartition(4)
    assert got(fa.audit(docs, spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_limits_are_exact(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:199]), " ".join(words), " ".join(words[:100] * 2), " ".join(words[:99] + words[:99] + words[:2]), "AA" + "x" * 98, "AAA" + "x" * 97, "\x0b\x0c w \x0d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fa.own_failures(df.t)).collect()] == [1, 0, 0, 2, 1, 5, 1]


def test_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 1, 1)], LABELS)
    assert got(fa.audit(odd, labels)) == plain([(i, t, s) for i, t, _, s in odd_rows], [(5, 1, 0), (6, 0, 1)])
    assert got(fa.audit(odd, labels.limit(0))) == plain([(i, t, s) for i, t, _, s in odd_rows], [])
    assert fa.audit(nothing, labels).count() == 0
