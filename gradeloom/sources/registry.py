"""Runs, model versions and aliases as append-only tables.

Nothing is updated in place: the newest row holds. Tables grow by one small row
per event, so reading them is cheap. Versions and alias moves are numbered by log
entries that are created only if they are not there yet: of two writers one gets
the number, the other one tries the next. A writer that dies between its entry and its
row leaves a gap and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import schemas
from gradeloom.operators.split import split_by_owner
from gradeloom.sources.corpus import read_stage


def newest(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """The newest row per key: one aggregation, no sort of a whole group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row")).select(*by, "_row.*")


class Registry:
    """A folder of registry tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _claim(self, log: str, *names: str, seen: Callable[[], int] = lambda: 0) -> int:
        """The next free number (from 1) of a log, which belongs to this caller from now on; ``seen`` numbers are taken as well."""
        spark = self.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, "log", log, *(quote(n, safe="") or "%" for n in names)]))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        number = max([0, seen(), *(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())]) + 1
        while not self._created(files, spark._jvm.org.apache.hadoop.fs.Path(folder, str(number))):
            number += 1
        return number

    def _created(self, files, path) -> bool:
        """Create an empty file; False if it is there already."""
        place = files.makeQualified(path).toUri()
        if place.getScheme() == "file":  # where Hadoop looks first and creates then
            return self.spark._jvm.java.io.File(place.getPath()).createNewFile()
        try:
            files.create(path, False).close()
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True

    def _append(self, table: str, row: tuple, schema: str) -> None:
        # a folder for each row: of two writers that append to one folder, the first to finish cleans up the other's work
        self.spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{self.root}/{table}/{uuid.uuid4().hex}")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{table}")

    @property
    def runs(self) -> DataFrame:
        return self._read("runs", schemas.RUNS)

    @property
    def versions(self) -> DataFrame:
        return self._read("model_versions", schemas.MODEL_VERSIONS)

    @property
    def aliases(self) -> DataFrame:
        return self._read("aliases", schemas.ALIASES)

    def log_run(self, run_name: str, tags: dict, params: dict, metrics: dict, end_time: datetime | None = None, model=None) -> str:
        """Log a run; ``model`` is stored first, so that a logged run always has its model."""
        run_id = uuid.uuid4().hex
        if model is not None:
            model.write().save(f"{self.root}/models/{run_id}")
        text = lambda d: {k: str(v) for k, v in d.items()}
        row = (run_id, run_name, text(tags), text(params), {k: float(v) for k, v in metrics.items()}, end_time or datetime.now(timezone.utc))
        self._append("runs", row, schemas.RUNS)
        return run_id

    def find_run(self, run_name: str):
        """The newest run of that name, or None."""
        return newest(self.runs.filter(F.col("run_name") == run_name), ["run_name"], "end_time", "run_id").first()

    def register(self, name: str, run_id: str) -> int:
        """A new version of a model, numbered from 1; two writers never get one number."""

        def last() -> int:
            try:
                return self.versions.filter(F.col("name") == name).agg(F.max("version")).first()[0] or 0
            except AnalysisException as error:  # the first registration finds no table
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                return 0

        version = self._claim("versions", name, seen=last)
        self._append("model_versions", (name, version, run_id, datetime.now(timezone.utc)), schemas.MODEL_VERSIONS)
        return version

    def set_alias(self, name: str, alias: str, version: int) -> None:
        """Point an alias at a version; of several moves the one with the last number holds, whatever the clocks say."""
        move = self._claim("moves", name, alias)
        self._append("aliases", (name, alias, version, datetime.now(timezone.utc), move), schemas.ALIASES)

    def resolve_alias(self, name: str, alias: str) -> int:
        row = newest(
            self.aliases.filter((F.col("name") == name) & (F.col("alias") == alias)), ["name", "alias"], "move", "moved_at"
        ).first()
        if row is None:
            raise LookupError(f"no alias {alias!r} for {name!r}")
        return row["version"]

    def run_of(self, name: str, version: int):
        """The run that made a model version."""
        versions = self.versions.filter((F.col("name") == name) & (F.col("version") == version)).select("run_id")
        row = self.runs.join(versions, "run_id", "left_semi").first()
        if row is None:
            raise LookupError(f"no run for version {version} of {name!r}")
        return row

    def log_trials(self, run_id: str, trials: DataFrame) -> None:
        """Append the trial table of a search under the run that it belongs to."""
        trials.withColumn("run_id", F.lit(run_id)).coalesce(1).write.parquet(f"{self.root}/trials/{uuid.uuid4().hex}")

    def trials_of(self, run_id: str, missing: str | None = None) -> DataFrame:
        """The trials under a run or study; where none was ever stored, an empty table of the schema ``missing`` if one is given."""
        try:
            found = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/trials")
        except AnalysisException as error:
            if missing is None or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], missing)
        return found.filter(F.col("run_id") == run_id).drop("run_id")

    def load_model(self, name: str, version: int | None = None, alias: str | None = None, kind=RandomForestRegressionModel):
        """The fitted model of a version, or of the version that an alias points to."""
        if (version is None) == (alias is None):
            raise ValueError("name either a version or an alias")
        version = self.resolve_alias(name, alias) if version is None else version
        return kind.load(f"{self.root}/models/{self.run_of(name, version)['run_id']}")

    def training_set(self, name: str, version: int, owner: str = "developer") -> tuple[float | None, DataFrame]:
        """Test RMSE of a version and the training rows it was fitted on, split again the same way."""
        run = self.run_of(name, version)
        data = read_stage(self.spark, run["tags"]["dataset"])
        train, _ = split_by_owner(data, float(run["tags"]["test_size"]), int(run["tags"]["random_state"]), owner)
        return (run["metrics"] or {}).get("test_rmse"), train
