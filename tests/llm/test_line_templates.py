"""Templates against a plain loop over documents."""

import random
import re
from collections import defaultdict

from gradeloom.llm import line_templates as lt


def templates(line):
    tokens = re.sub(lt._HAS_DIGIT, lt.VARIABLE, line)
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", tokens) if w]
    n = len(tokens)
    if n == 0:
        return n, []
    out = [tuple(tokens)]
    if n >= lt.LONG:
        at = [lt.LEAD + k * (n - lt.LEAD) // lt.SEGMENTS for k in range(lt.SEGMENTS + 1)]
        out += [(k, *tokens[: at[k]], None, *tokens[at[k + 1] :]) for k in range(lt.SEGMENTS)]
    return n, out


def plain(rows):
    found = defaultdict(set)
    sizes = {}
    for i, text in rows:
        for line in set((text or "").split("\n")):
            n, keys = templates(line)
            for k in keys:
                found[n, k].add((i is None, i or 0, text or ""))
                sizes[n, k] = n
    keeper = {k: min(d) for k, d in found.items() if len(d) >= (lt.DOCS_LONG if sizes[k] >= lt.LONG else lt.DOCS_SHORT)}
    out = []
    for i, text in rows:
        own = (i is None, i or 0, text or "")
        kept = []
        for line in (text or "").split("\n"):
            n, keys = templates(line)
            if not any((n, k) in keeper and keeper[n, k][:2] != own[:2] for k in keys):
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def corpus():
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = say(60)
    rows = []
    for i in range(120):
        lines = [say(rnd.randint(3, 40)) for _ in range(rnd.randint(0, 6))]
        if i % 4 == 0:
            lines.append(passage)
        if i % 7 == 0:
            lines.append(f"posted on 2024-01-{i:02d} at {i}:00 in the usual forum by {say(1)}")
        if i % 5 == 0:
            lines.append("Short footer.")
        if i % 50 == 1:
            lines.append("seldom seen")
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows, passage


def test_recurring_lines_go_and_others_stay(spark):
    rows, passage = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lt.without_recurring_lines(df).collect()}
    want = dict(plain(rows))
    assert {i: r.text for i, r in got.items()} == want
    assert sum(passage in r.text for r in got.values()) == 1
    assert sum("posted on" in r.text for r in got.values()) == 1
    assert sum("Short footer." in r.text for r in got.values()) == 1 and sum("seldom seen" in r.text for r in got.values()) == 3
    for i, text in rows:
        assert (got[i].n_lines, got[i].n_dropped) == (len(text.split("\n")), len(text.split("\n")) - len(want[i].split("\n")) if want[i] or not got[i].n_dropped else got[i].n_dropped)


def test_lines_within_one_document_do_not_recur(spark):
    rows = [(1, "\n".join(f"line {i} of the log says that all is well here" for i in range(50))), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lt.without_recurring_lines(df).collect()} == {1: 0, 2: 0}


def test_odd_rows(odd, odd_rows, nothing):
    cleaned = lt.without_recurring_lines(odd)
    assert cleaned.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = cleaned.collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in rows), key=order) == sorted(plain([(i, t) for i, t, *_ in odd_rows]), key=order)
    assert {r.gone for r in rows} == {"clash"} and lt.without_recurring_lines(nothing).count() == 0
