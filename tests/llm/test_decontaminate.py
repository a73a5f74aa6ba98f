"""Hits against a plain search for every window at every place."""

import random
import re
from hashlib import sha256

import pytest

from gradeloom.llm import decontaminate as dc
from tests.llm.conftest import prose

ITEMS = "item_id bigint, text string, doc_id string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))]


def plain(rows, items):
    windows = {}
    for item, text in items:
        words = [w for w, _, _ in split(text)]
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        words = split(text)
        names = [w for w, _, _ in words]
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(names) - size + 1):
                if (key := tuple(names[at : at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[key]
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1] = (spans[-1][0], words[k][2])
            else:
                spans.append(words[k][1:])
        out.append((i, len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), spans))
    return sorted(out, key=str)


def got(docs, benchmark):
    rows = dc.digests(*dc.find_passages(docs, benchmark)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, [tuple(s) for s in r.spans]) for r in rows), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    few = ["ab", "Cd", "é", "x1", "ÀB"]
    items = [(i, prose(rnd, rnd.randint(11, 40))) for i in range(20)]
    items += [(20, " ".join(rnd.choices(few, k=14))), (21, "Only five words, you see!"), (22, items[3][1]), (23, items[3][1] + " and more"), (3, "Second text under an id"), (None, items[5][1]), (24, None), (25, " ?! ")]
    rows = []
    for i in range(120):
        parts = [prose(rnd, rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 3)):
            words = (rnd.choice(items)[1] or "").split()
            at = rnd.randrange(len(words) or 1)
            passage = rnd.choice([" ", ", ", "\n- "]).join(words[at : at + rnd.randint(8, 30)])
            parts += [passage.upper() if passage.isascii() and rnd.random() < 0.5 else passage, rnd.choice(["", prose(rnd, 5), "😀 "]), " ".join(rnd.choices(few, k=30))]
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    return rows, items


@pytest.mark.parametrize("block", [100_000, 37])
def test_hits_against_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    rows, items = corpus(block)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = got(docs, spark.createDataFrame([(*x, "clash") for x in items], ITEMS))
    assert found == plain(rows, items)
    assert sum(r[5] for r in found) > 40 and not all(r[5] for r in found)


def test_windows_across_items_are_none(spark):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "eleven twelve")]
    rows = [(1, "two three four five six seven eight nine ten eleven"), (2, "ELEVEN, twelve."), (3, "eleven-twelfth"), (4, "xone two three four five six seven eight nine ten")]
    found = got(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(*x, None) for x in items], ITEMS))
    assert [r[2] for r in found] == [0, 2, 0, 0]


def test_letters_are_distinct_and_no_surrogates():
    letters = {dc._letter(i) for i in range(10 * dc.BLOCK)}
    assert len(letters) == 10 * dc.BLOCK and dc.UNKNOWN not in letters
    assert not any("\ud800" <= c <= "\udfff" for c in letters)


@pytest.mark.parametrize("block", [100_000, 20])
def test_odd_rows(spark, odd, odd_rows, nothing, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    items = [(1, odd_rows[5][1]), (2, "ßtraße 😀 end"), (3, "two"), (4, "x" * 5000)]
    benchmark = spark.createDataFrame([(*x, None) for x in items], ITEMS)
    assert got(odd, benchmark) == plain([r[:2] for r in odd_rows], items)
    assert got(odd, benchmark.limit(0)) == plain([r[:2] for r in odd_rows], [])
    assert got(nothing, benchmark) == []
