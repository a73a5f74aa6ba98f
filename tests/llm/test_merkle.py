"""Manifests against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest

from gradeloom.llm import merkle as mk

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """Root of a list, and for each place the siblings and sides on its way up."""
    ways = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(hashes):
                ways[k].append(("L" if i & 1 else "R", hashes[i ^ 1]))
            else:
                ways[k].append(("-", ""))
            at[k] = i // 2
        hashes = [h(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
    return hashes[0], ways


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[0])
        trees[lang] = tree([leaf(r) for _, r in by[lang]])
    root, upper = tree([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        for (_, r), way in zip(by[lang], trees[lang][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for side, sibling in way + above:
                folded = h(sibling, folded) if side == "L" else h(folded, sibling)
            out.append((r[0], leaf(r), trees[lang][0], root, h(*(s for _, s in way + above)), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_against_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(mk, "LEVELS", levels)
    rnd = random.Random(levels)
    for sizes in ({"a": 1}, {"a": 2}, {"a": 37, "b": 1, "é": 4, None: 17, "": 9, "z": 33}):
        rows = [(rnd.randrange(10**6), rnd.choice([None, "s", "ü"]), lang, rnd.choice([None, 5, 900]), rnd.choice([None, "", "tëxt\n"])) for lang, n in sizes.items() for _ in range(n)]
        df = spark.createDataFrame(rows, COLUMNS).repartition(5)
        assert got(mk.manifest(df, mk.tampered_sample())) == plain(rows)


def test_blocks_of_a_thousand(spark):
    rows = [(i, "s", "en" if i % 10 else "de", i, f"text {i}") for i in range(3500)]
    found = got(mk.manifest(spark.createDataFrame(rows, COLUMNS).repartition(6), mk.tampered_sample()))
    assert found == plain(rows)
    assert sum(not r[-1] for r in found) == sum(zlib.crc32(str(i).encode()) % 7 == 0 for i in range(3500))


def test_nothing_tampered_verifies(spark):
    rows = [(i, None, None, 1, "x" * i) for i in range(9)]
    assert all(r[-1] for r in got(mk.manifest(spark.createDataFrame(rows, COLUMNS))))


def test_odd_rows(odd, odd_rows, nothing):
    rows = [(i, source, lang, None if t is None else len(t), t) for i, t, lang, source in odd_rows]
    assert got(mk.manifest(odd, mk.tampered_sample())) == plain(rows)
    assert mk.manifest(nothing, mk.tampered_sample()).count() == 0


def test_row_limit_of_the_session_is_restored(spark, nothing):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "77")
    mk.manifest(nothing)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "77"
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
