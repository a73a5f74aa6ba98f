"""Statistics against plain Python, estimates against numpy, planted outliers."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import robust_quality as rq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_statistics(spark, odd, odd_rows):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "# ", "\t", "\x0b", "é "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rq.text_statistics(df).collect():
        assert tuple(r[n] for n in names) == plain(texts[r.doc_id])
    got = Counter(tuple(r[n] for n in names) for r in rq.text_statistics(odd).collect())
    assert got == Counter(plain(t) for _, t, *_ in odd_rows)


def vectors(rows):
    return [
        [np.log(max(c / max(n, 1), 1)), np.sqrt(s / max(n, 1)), d / max(lines, 1), r / max(n, 1)] for n, c, s, d, r, lines in rows
    ]


def mcd(x, with_size=False):
    """The same steps on arrays."""
    floors = np.array(list(rq.STATISTICS.values()))

    def reached(bins, share):
        bins = np.sort(bins)
        n = len(bins)
        return next(b for b in bins if (bins <= b).sum() >= share * n)

    grid = np.floor(x * 200)
    q1, q2, q3 = (np.array([reached(grid[:, i], s) for i in range(4)]) for s in (0.25, 0.5, 0.75))
    spread = lambda y, scale: scale * (np.einsum("ij,ik->jk", y, y) / len(y) - np.outer(y.mean(0), y.mean(0))) + np.diag(floors**2)
    found = []
    for mean, cov in (((q2 + 0.5) / 200, np.diag(np.maximum((q3 - q1) / 200 / 1.349, floors) ** 2)), (x.mean(0), spread(x, 1.0))):
        before, core = None, None
        for step in range(rq.MOST_STEPS + 1):
            det = np.linalg.det(cov)
            if step == rq.MOST_STEPS or (before is not None and not det < before * (1 - rq.LEAST_FALL)):
                break
            before = det
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log(d + 1e-9) * 64)
            core = x[bins <= reached(bins, rq.CORE)]
            mean, cov = core.mean(0), spread(core, rq.CONSISTENCY)
        found.append((det, len(found), mean, cov, core))
    _, _, mean, cov, core = min(found, key=lambda f: f[:2])
    return (mean, cov, len(core)) if with_size else (mean, cov)


def test_estimates_follow_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal([1.6, 0.1, 0.05, 0.02], [0.1, 0.1, 0.02, 0.02], (400, 4)), 2: rng.normal([2, 0, 0, 0], 0.3, (60, 4)), 3: np.array([[1.5, 0, 0, 0]])}
    groups[1][:80] += [0, 2, 0, 0.5]
    df = spark.createDataFrame([(g, row.tolist()) for g, x in groups.items() for row in x], "`group` long, x array<double>")
    for r in rq.estimate(df).collect():
        mean, cov = mcd(groups[r.group])
        assert np.allclose(r["mean"], mean, atol=1e-6)
        assert np.allclose(r["cov"], [cov[i, j] for i in range(4) for j in range(i + 1)], atol=1e-6)


def test_outliers_go_and_clean_documents_stay(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    rows = []
    for i in range(600):
        n = rnd.choice([20, 25, 40, 200, 1000])
        words = [word() for _ in range(n)]
        if i % 5 == 0:
            words = [w + rnd.choice(["###", "%%%", "***"]) for w in words]
        rows.append((i, " ".join(words), rnd.choice(["en", None]), rnd.choice(["a", "a", "a", "b", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in rq.judged_documents(df).collect():
        assert r.kept == (r.doc_id % 5 != 0), r
    assert {r.doc_id for r in rq.kept_documents(df).collect()} == {i for i in range(600) if i % 5}


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    judged = rq.judged_documents(odd).collect()
    assert len(judged) == len(odd_rows) and all(r.kept is not None for r in judged)
    kept = rq.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in judged)
    assert {r.n_words for r in kept.collect()} == {"clash"}
    assert rq.judged_documents(nothing).count() == 0 and rq.kept_documents(nothing).count() == 0


def test_a_language_without_sources_is_not_a_source_without_language(spark):
    """The two groups differ in their words; together they would make each other's documents outliers or normal."""
    rnd = random.Random(4)
    say = lambda low, high: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(low, high))) for _ in range(60))
    rows = [(i, say(3, 5), "en", None) for i in range(300)] + [(i, say(13, 15), None, "en") for i in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    far = {r.doc_id: r.distance for r in rq.judged_documents(df).collect()}
    assert max(far.values()) < 20 and max(far[i] for i in range(300)) > 0
