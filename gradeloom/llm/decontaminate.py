"""Passages of a benchmark in documents, by one Aho-Corasick automaton over its windows.

Questions and answers are normalised (A to Z lowered, words of letters and digits) and cut
into windows of ``WINDOW`` consecutive words; a shorter item is one window. Every distinct
window has a number. The automaton's letters are words: each word of the benchmark is one
code point, every other word of a document is one that no window has. A document is scanned
once, all windows that occur in it come out, and the words inside of them are mapped back to
code points of the original text.

An automaton holds ``BLOCK`` windows at most, so its memory is bounded whatever the benchmark
is. A larger benchmark is worked through block by block, a pass over the documents for each;
a pass keeps texts where they are. What the windows say about items is looked up once for
each different set of windows, not for each document, so a passage that a third of all
documents share costs as much as one that stands in two.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import ensure_shared, stage, text_or_empty
from gradeloom.operators.ordered import with_rank

WINDOW = 10
#: Windows in one automaton: their words (ten times as many at most) fit into the code points.
BLOCK = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "array<struct<first:int,last:int,start:int,stop:int>>"
UNKNOWN = "\x01"


def words_of(text: str) -> list[str]:
    """Words with A to Z lowered; all other letters are kept as they are."""
    return WORD.findall(text.encode().lower().decode())


def windows_of(text: str, window: int = WINDOW) -> list[str]:
    words = words_of(text)
    size = min(window, len(words))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def _letter(i: int) -> str:
    """The i-th code point behind the unknown word, without surrogates."""
    return chr(i + 2 if i + 2 < 0xD800 else i + 2 + 0x800)


def merged(runs):
    """Runs (first, last, start, stop) as few as cover the same words, in order."""
    out: list[list[int]] = []
    for first, last, start, stop in sorted(runs):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, stop
        else:
            out.append([first, last, start, stop])
    return out


class Scanner:
    """All windows of a block that occur in a text."""

    def __init__(self, windows: list[tuple[int, str]]):
        import ahocorasick

        self.letters: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for number, window in windows:
            words = window.split(" ")
            coded = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in words)
            self.automaton.add_word(coded, (number, len(words)))
        self.automaton.make_automaton()

    def scan(self, text: str):
        """Number of words, runs of hit words with their code points, and the numbers of the windows."""
        words = words_of(text)
        known = self.letters.get
        found, runs = set(), []
        if self.letters:
            for last, (number, size) in self.automaton.iter("".join([known(w, UNKNOWN) for w in words])):
                found.add(number)
                first = last - size + 1
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
        if not runs:
            return len(words), [], []
        at = [m.span() for m in WORD.finditer(text)]
        return len(words), [(a, b, at[a][0], at[b][1]) for a, b in runs], sorted(found)


def _hit_array(pa, lists):
    rows = [row for rows in lists for row in rows]
    offsets = [0]
    for one in lists:
        offsets.append(offsets[-1] + len(one))
    parts = [pa.array([r[k] for r in rows], pa.int32()) for k in range(4)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["first", "last", "start", "stop"]))


def benchmark_windows(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with their number (from 1), and the items (as strings, null as '') of every number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(item, w) for item, text in zip(*(c.to_pylist() for c in batch.columns)) for w in dict.fromkeys(windows_of(text, window))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=["item", "window"])

    item = F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit(""))
    cut = stage(benchmark.select(item.alias("item"), text_or_empty(text_column).alias("t")).mapInArrow(run, "item string, window string").distinct(), "benchmark-items")
    numbered = stage(with_rank(cut.select("window").distinct(), [], ["window"], "number"), "benchmark-windows")
    return numbered, cut.join(numbered, "window").select("number", "item")


def _pass(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    """Id, mark, n_words, hits and windows of every row, for the windows of one block."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(block)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    _hit_array(pa, [hits for _, hits, _ in found]),
                    pa.array([w for _, _, w in found], pa.list_(pa.int64())),
                ],
                names=["id", "mark", "n_words", "hits", "windows"],
            )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, mark long, n_words long, hits {HITS}, windows array<long>")


def _with_later(rows: DataFrame, later: list[DataFrame]) -> DataFrame:
    """The rows of the first pass with what later passes have found in the same texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hits = [merged(tuple(h.values()) for h in one) for one in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _hit_array(pa, hits), batch.column(4)], names=batch.schema.names)

    more = later[0]
    for one in later[1:]:
        more = more.unionByName(one)
    found = more.groupBy("id", "mark").agg(F.flatten(F.collect_set("hits")).alias("more_hits"), F.flatten(F.collect_set("windows")).alias("more_windows"))
    other = stage(found.withColumnsRenamed({"id": "other_id", "mark": "other_mark"}), "contamination-later")
    joined = rows.join(other, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("mark") == F.col("other_mark")), "left")
    both = lambda a, b: F.concat(a, F.coalesce(b, F.slice(a, 1, 0)))
    every = joined.select("id", "mark", "n_words", both(F.col("hits"), F.col("more_hits")).alias("hits"), F.array_sort(both(F.col("windows"), F.col("more_windows"))).alias("windows"))
    return every.mapInArrow(run, rows.schema)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Hits of every row of ``docs``, and the items behind them.

    The first table has id, ``n_words``, ``hits`` (runs of hit words: first and last word, start
    and stop in code points of the original text, stop exclusive) and ``found``, the name of
    the set of windows that occur (null if none does). The second has ``found`` and ``items``,
    the sorted ids of the benchmark's items with a window in that set, as strings.

    Null and empty texts have no words and no hits; items without words have no window; an
    item's null id is ''; repeated items count once. Equal rows have equal results. Without
    documents there are no rows, without items no hits. Other columns are not read.
    """
    ensure_shared(docs.sparkSession)
    windows, items = benchmark_windows(benchmark, item_column, item_text, window)
    text = text_or_empty(text_column)
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    n_blocks = max(1, -(-windows.count() // BLOCK))
    passes = []
    for k in range(n_blocks):
        # as many rows as an automaton may hold
        block = [(r.number, r.window) for r in windows.filter(F.col("number").between(k * BLOCK + 1, (k + 1) * BLOCK)).collect()]
        found = _pass(texts, block)
        passes.append(stage(found if k == 0 else found.filter(F.size("hits") > 0), "contamination"))
    rows = stage(_with_later(passes[0], passes[1:]), "contamination") if len(passes) > 1 else passes[0]
    named = rows.withColumn("found", F.when(F.size("windows") > 0, F.md5(F.array_join(F.col("windows").cast("array<string>"), ",").cast("binary"))))
    sets = named.filter("found IS NOT NULL").groupBy("found").agg(F.first("windows").alias("windows"))
    listed = sets.select("found", F.explode("windows").alias("number")).join(items, "number").select("found", "item").distinct()
    behind = listed.groupBy("found").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return named.select(F.col("id").alias(id_column), "n_words", "hits", "found"), behind


def digests(rows: DataFrame, behind: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, ``n_words``, ``n_hit`` (words), ``n_items``, ``items_sha256``, ``contaminated`` and ``spans`` (code points) of every row."""
    hit_words = F.aggregate("hits", F.lit(0).cast("long"), lambda at, h: at + (h["last"] - h["first"] + 1))
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop")))
    sized = rows.select(id_column, "n_words", hit_words.alias("n_hit"), spans.alias("spans"), "found")
    # written, so that Spark can split the join for a passage in very many documents
    named = stage(behind.select("found", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "contamination-items")
    hit = sized.filter("found IS NOT NULL").join(named, "found")
    clean = sized.filter("found IS NULL").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return hit.unionByName(clean).select(id_column, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")
