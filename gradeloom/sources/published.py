"""Published tables: monitoring reports and recommendation data."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import schemas

PARTS = {"effects": schemas.EFFECTS, "dependencies": schemas.DEPENDENCIES, "messages": schemas.MESSAGES}


def write_report(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Append report rows, one folder per model version and time stamp."""
    df.write.mode("append").partitionBy("model_version", "stamp").format(format).save(path)


def read_report(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(format).load(path)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """(model_version, part, publication): the newest entry of each version and part."""
    try:
        rows = spark.read.schema(schemas.PUBLICATIONS).parquet(f"{root}/manifest")
    except AnalysisException as error:  # the first publication finds no table
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schemas.PUBLICATIONS)
    newest = F.max_by("publication", F.struct("published_at", "publication"))
    return rows.groupBy("model_version", "part").agg(newest.alias("publication"))


def read_reco_part(spark: SparkSession, root: str, part: str, version: int | None = None) -> DataFrame:
    """A part of what is published: of one version, or of all of them."""
    root = root.rstrip("/")
    entries = _manifest(spark, root).filter(F.col("part") == part).drop("part")
    if version is not None:
        entries = entries.filter(F.col("model_version") == version)
    known = [r["publication"] for r in entries.select("publication").distinct().collect()]  # one for each publication
    if not known:
        return spark.createDataFrame([], PARTS[part])
    columns = PARTS[part].split(", ", 1)[1]
    folders = [f"{root}/{part}/publication={p}" for p in known]
    rows = spark.read.schema(f"{columns}, publication STRING").option("basePath", f"{root}/{part}").parquet(*folders)
    return rows.join(entries, "publication").select(*[c.split()[0] for c in PARTS[part].split(", ")])


def publish_reco_data(
    spark: SparkSession,
    root: str,
    version: int,
    effects: DataFrame | None = None,
    dependencies: DataFrame | None = None,
    messages: DataFrame | None = None,
) -> None:
    """Store what recommendations of a version need; missing parts come from the version before.

    All or nothing: parts go to folders of their own, and the manifest entries that make
    them count are one small file, written last. A part that is empty is published as
    empty and carried over as such; publishing a version again replaces it.
    """
    root = root.rstrip("/")
    given = {"effects": effects, "dependencies": dependencies, "messages": messages}
    before = {r["part"]: r["publication"] for r in _manifest(spark, root).filter(F.col("model_version") == version - 1).collect()}
    for part, rows in given.items():
        if rows is None and part not in before:
            raise LookupError(f"version {version - 1} has no {part} to carry over")
    now, entries = datetime.now(timezone.utc), []
    for part, rows in given.items():
        publication = before.get(part)
        if rows is not None:
            publication = uuid.uuid4().hex
            columns = [c.split()[0] for c in PARTS[part].split(", ")][1:]
            rows.select(*columns).write.parquet(f"{root}/{part}/publication={publication}")
        entries.append((version, part, publication, now))
    spark.createDataFrame(entries, schemas.PUBLICATIONS).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
