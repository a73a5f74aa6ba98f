"""Every stage of the pipeline against a plain version of it, each on its own input."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from gradeloom.llm import robust_quality as rq
from tests.llm.test_line_templates import plain as plain_lines
from tests.llm.test_lsh_forest import brute
from tests.llm.test_packing import reference_ids
from tests.llm.test_robust_quality import WORD, mcd, plain as plain_statistics
from tests.llm.test_source_mix import targets

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Outputs of all stages over documents with junk, copies, boilerplate and nulls."""
    rnd = random.Random(12)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    footer = say(55)
    rows = []
    for i in range(240):
        kind = i % 8
        text = "\n".join(say(rnd.randint(9, 40)) for _ in range(rnd.randint(1, 8)))
        if kind == 1:
            text += "\n" + footer
        if kind == 2 and rows:
            text = rows[rnd.randrange(len(rows))][1]
        if kind == 3 and rows:
            words = (rows[rnd.randrange(len(rows))][1] or "x").split(" ")
            words[rnd.randrange(len(words))] = "edit"
            text = " ".join(words)
        if kind == 4:
            text = " ".join(w + rnd.choice(["###", "$$$"]) for w in text.split())
        if kind == 5:
            text = rnd.choice([None, "", "too short", (say(4) + " ") * 30])
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", None]), None if text is None else len(text)))
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return folder, out


def kept_by_quality(rows):
    live = defaultdict(list)
    for r in rows:
        n, chars, symbols, dup, repeat = plain_statistics(r.text)
        if n < 20 or 100 * repeat > 30 * n:
            continue
        lines = sum(bool(WORD.search(x)) for x in (r.text or "").split("\n"))
        x = [np.log(max(chars / n, 1)), np.sqrt(symbols / n), dup / max(lines, 1), repeat / n]
        live[r.lang, r.source].append((r.doc_id, x))
    langs = defaultdict(list)
    for (lang, _), found in live.items():
        langs[lang] += [x for _, x in found]
    kept = set()
    limit = rq.chi2_quantile(rq.CUTOFF, rq.DIMENSION)
    of_lang = {lang: mcd(np.array(x)) for lang, x in langs.items()}
    for (lang, _), found in live.items():
        x = np.array([v for _, v in found])
        mean, cov, n = mcd(x, with_size=True)
        mean = (n * mean + rq.PRIOR * of_lang[lang][0]) / (n + rq.PRIOR)
        cov = (n * cov + rq.PRIOR * of_lang[lang][1]) / (n + rq.PRIOR)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        kept |= {i for (i, _), far in zip(found, d) if far <= limit}
    return kept


def test_quality(stages):
    _, out = stages
    assert {r.doc_id for r in out[1]} == kept_by_quality(out[0])
    junk = {r.doc_id for r in out[0] if r.doc_id % 8 == 4}
    clean = {r.doc_id for r in out[0] if r.doc_id % 8 in (0, 6, 7) and len(r.text.split()) >= 20}
    left = {r.doc_id for r in out[1]}
    assert not left & junk and clean <= left
    assert sorted(map(tuple, out[1]), key=str) == sorted((tuple(r) for r in out[0] if r.doc_id in left), key=str)


def test_lines(stages):
    _, out = stages
    want = dict(plain_lines([(r.doc_id, r.text) for r in out[1]]))
    assert {r.doc_id: r.text for r in out[2]} == want and len(out[2]) == len(out[1])
    assert all(r.n_chars == len(r.text) for r in out[2])


def test_near_duplicates(stages):
    _, out = stages
    rows = [(r.doc_id, r.text) for r in out[2]]
    want = {i for (i, _), (n, least) in zip(rows, brute(rows, 80)) if i == least}
    assert sorted(r.doc_id for r in out[3]) == sorted(want)


def test_mix(stages):
    _, out = stages
    size, by_source = {}, defaultdict(list)
    for r in out[3]:
        by_source[r.source].append(r)
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    target = targets(size)
    want = []
    for source, rows in by_source.items():
        rows = sorted(rows, key=lambda r: (hashlib.md5(f"17|{r.doc_id}".encode()).hexdigest()[:15], r.doc_id))
        left = int(target[source])
        for _ in range(2):
            for r in rows:
                n = len(WORD.findall(r.text))
                take = min(n, left)
                left -= take
                if take:
                    end = list(re.finditer(r"[^\x20\x09-\x0D]+", r.text))[take - 1].end()
                    want.append((r.doc_id, r.text if take == n else r.text[:end]))
    assert sorted((r.doc_id, r.text) for r in out[4]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in out[4])


def test_pack(stages):
    _, out = stages
    tokens = defaultdict(int)
    for r, ids in zip(out[4], reference_ids([r.text for r in out[4]])):
        tokens[r.doc_id] += len(ids)
    got, sequences = defaultdict(int), defaultdict(list)
    for r in out[5]:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == tokens
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_run_is_the_stages_in_a_row(spark, stages):
    folder, out = stages
    run = corpus_pipeline.run(spark, folder).collect()
    digest = lambda rows: sorted((r.doc_id, r.length, r.ids_crc32) for r in rows)
    assert sum(r.length for r in run) == sum(r.length for r in out[5])
    assert {d for d, *_ in digest(run)} == {d for d, *_ in digest(out[5])}


def test_columns_between_stages(stages):
    _, out = stages
    for rows in out[1:5]:
        assert list(rows[0].asDict()) == NAMES
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_registered(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries if re.match(r"op\d+_", name)}
    assert "pipeline" in queries and set(oracles) <= set(queries)


def test_stages_drop_what_earlier_ones_staged(spark, stages):
    folder, _ = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.quality(spark, docs, folder)
    mine = list(corpus_pipeline._tables)
    assert mine
    two = corpus_pipeline.lines(spark, one, folder)  # still reads what the first has staged
    assert two.count() == one.count() and set(corpus_pipeline._tables) & set(mine)
    corpus_pipeline.pack(spark, docs, folder)
    assert corpus_pipeline._tables == []
