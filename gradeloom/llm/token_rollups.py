"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed rows: what a document
counted before comes off, what it counts now goes on. Totals are sums of signed rows, so
totals never have to be computed anew. The ledger keeps the signed rows by document, which is
where a later batch finds what to take off: in ``BUCKETS`` folders by hash of the document, of
which a batch reads those of its own documents. ``compact`` folds what is committed into one
base with a row for each live document, so the ledger that is read does not grow with the
number of batches.

Every attempt at a batch writes to folders of its own and a commit entry last. Readers look at
committed attempts only, of one batch at the first; an attempt that failed half way is
left behind, and a batch that is committed is not applied again, however often it is
delivered.
"""

from __future__ import annotations

from functools import reduce
from time import time_ns
from urllib.parse import quote, unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm.common import stage
from gradeloom.llm.tokens import encoder

CHANGES = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, op string, seq bigint"
LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, sign int"
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
GROUP = ["source", "lang", "tokenizer"]
#: Folders of the ledger by hash of the document.
BUCKETS = 32


def bpe_counts(rows: DataFrame, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """``rows`` without the text, with ``n_tokens`` of it by a byte-level vocabulary."""
    others = [c for c in rows.columns if c != text_column]

    def run(batches):
        import pyarrow as pa

        bpe = encoder(vocabulary)
        for batch in batches:
            n = [len(bpe.encode(t or "", allowed_special="all")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*others, "n_tokens"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["n_tokens bigint"])
    return rows.select(text_column, *others).mapInArrow(run, schema)


def _bucket(document):
    return F.pmod(F.xxhash64(document.isNull(), F.coalesce(document, F.lit(0))), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._place(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _attempts(self) -> dict[str, str]:
        """Committed batches with the attempt that counts, in the order of their names."""
        found: dict[str, str] = {}
        for name in self._names("commits"):
            batch, entry = name.rsplit(".", 1)
            found.setdefault(batch, entry.split("-", 1)[1])
        return found

    def committed(self) -> list[str]:
        """Batches in the order of their names that count."""
        return sorted(map(unquote, self._attempts()))

    def _base(self) -> tuple[str | None, set[str]]:
        """The base that covers most batches, and those batches."""
        best: tuple[str | None, set[str]] = (None, set())
        for name in self._names("bases"):
            files, marker = self._place("bases", name, "covered", "_SUCCESS")
            if files.exists(marker):
                covered = {r["batch"] for r in self.spark.read.parquet(f"{self.folder}/bases/{name}/covered").collect()}  # a row for each batch
                best = max(best, (name, covered), key=lambda b: (len(b[1]), b[0] or ""))
        return best

    def _read(self, kind: str, schema: str, without: str | None = None) -> DataFrame:
        """Rows of the base and of what was committed after it, but for one batch."""
        base, covered = self._base()
        paths = [f"{self.folder}/{kind}/{batch}/{attempt}" for batch, attempt in self._attempts().items() if batch not in covered | {without}]
        if base:
            paths.append(f"{self.folder}/bases/{base}/{kind}")
        if not paths:
            return self.spark.createDataFrame([], schema)
        if kind == "ledger":  # folders of buckets, which Spark reads one root at a time
            schema = f"{LEDGER}, bucket int"
            return reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(p) for p in paths])
        return self.spark.read.schema(schema).parquet(*paths)

    def _write_ledger(self, rows: DataFrame, path: str) -> None:
        # a file for each bucket
        rows.withColumn("bucket", _bucket(F.col("doc_id"))).repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(path)

    def compact(self) -> bool:
        """Fold all committed batches into one base; says whether there was anything to fold.

        Batches that are committed meanwhile are not covered and stay beside it. What a base
        covers is written last, so one that failed half way is no base.
        """
        _, covered = self._base()
        names = list(self._attempts())
        if set(names) <= covered:
            return False
        base = f"{self.folder}/bases/{uuid4().hex}"
        ledger, deltas = self._read("ledger", LEDGER), self._read("deltas", DELTAS)
        live = ledger.groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        self._write_ledger(live.select("doc_id", "tokenizer", "source", "lang", "n_tokens", F.col("sign").cast("int").alias("sign")), f"{base}/ledger")
        deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{base}/deltas")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{base}/covered")
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch (columns of ``CHANGES``) unless it is committed; says whether it was applied.

        ``op`` is insert, delete or revise. Of several changes of a document and tokenizer in
        one batch the last by ``seq`` counts (ties: the larger count, then source and
        language). An insert of a known document revises it, a revision of an unknown one
        inserts it, a delete of an unknown one does nothing. A revision without source and
        language keeps what is known. A change without tokenizer or op, with another op, or
        without a count where one is needed is refused by an error, before anything is written.
        """
        if batch in self.committed():
            return False
        last = F.max(F.struct("seq", "n_tokens", "source", "lang", "op"))
        new = stage(changes.groupBy("doc_id", "tokenizer").agg(last.alias("new")).select("doc_id", "tokenizer", "new.*"), "rollup-batch")
        wrong = ~F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False)) | F.col("tokenizer").isNull() | ((F.col("op") != "delete") & F.col("n_tokens").isNull())
        if new.filter(wrong).limit(1).count():
            raise ValueError(f"batch {batch} has changes without tokenizer, count or known op")
        key = lambda side: [F.col(f"{side}.doc_id").eqNullSafe(F.col("new.doc_id")), F.col(f"{side}.tokenizer") == F.col("new.tokenizer")]
        touched = [r["bucket"] for r in new.select(_bucket(F.col("doc_id")).alias("bucket")).distinct().collect()]  # BUCKETS at most
        name, attempt = quote(batch, safe=""), uuid4().hex
        # another writer may have committed the same batch meanwhile; this attempt has to be as if it had not
        ledger = self._read("ledger", f"{LEDGER}, bucket int", name).filter(F.col("bucket").isin(touched)).drop("bucket")
        signed = ledger.alias("old").join(new.select("doc_id", "tokenizer").alias("new"), key("old"), "left_semi")
        live = signed.groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("live")).filter("live > 0").select("doc_id", *GROUP, "n_tokens")
        both = new.alias("new").join(live.alias("old"), key("old"), "left")
        known = F.col("old.tokenizer").isNotNull()
        row = lambda source, lang, n, sign: F.struct(source.alias("source"), lang.alias("lang"), n.alias("n_tokens"), F.lit(sign).alias("sign"))
        keep = known & (F.col("new.op") == "revise") & F.col("new.source").isNull() & F.col("new.lang").isNull()
        minus = F.when(known, row(F.col("old.source"), F.col("old.lang"), F.col("old.n_tokens"), -1))
        plus = F.when(
            F.col("new.op") != "delete",
            row(F.when(keep, F.col("old.source")).otherwise(F.col("new.source")), F.when(keep, F.col("old.lang")).otherwise(F.col("new.lang")), F.col("new.n_tokens"), 1),
        )
        moves = both.select("new.doc_id", "new.tokenizer", F.explode(F.array_compact(F.array(minus, plus))).alias("m"))
        written = f"{self.folder}/ledger/{name}/{attempt}"
        self._write_ledger(moves.select("doc_id", "tokenizer", "m.source", "m.lang", "m.n_tokens", "m.sign"), written)
        rows = self.spark.read.schema(LEDGER).parquet(written)
        deltas = rows.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        deltas.write.parquet(f"{self.folder}/deltas/{name}/{attempt}")
        files, entry = self._place("commits", f"{name}.{time_ns():020d}-{attempt}")
        files.create(entry, False).close()
        # of writers that had the same batch at the same time the first one counts
        return self._attempts()[name] == attempt

    def totals(self) -> DataFrame:
        """Documents and tokens of every group with documents; null sources and languages are groups of their own."""
        sums = self._read("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs > 0")
