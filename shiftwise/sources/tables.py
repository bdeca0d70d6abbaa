"""Reading labelled tables and keeping a registry of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.columns import clean_double
from shiftwise.operators.prep import select_features

REGISTRY_SCHEMA = "name string, filename string, target_column string, selected_features array<string>"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Parquet or CSV; CSV infers its schema only when none is declared."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.format(fmt).load(path)


def as_labelled(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    keep: list[str] | None = None,
    unlabelled: bool = True,
) -> DataFrame:
    """Columns ``keep``, ``label string`` and the features as doubles; NaN becomes null.

    Rows without a label stay, with a null label, unless ``unlabelled`` is false.

    Where no features are named, all numeric columns are taken; named ones may also be text that holds numbers.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    keep = keep or []
    candidates = [c for c in df.columns if c != target and c not in keep]
    if features is None:
        candidates = [c for c in candidates if isinstance(df.schema[c].dataType, T.NumericType)]
    chosen = select_features(candidates, features)
    rows = df if unlabelled else df.where(F.col(target).isNotNull())
    return rows.select(
        *keep, F.col(target).cast("string").alias("label"), *[clean_double(c).alias(c) for c in chosen]
    )


def load_labelled(
    spark: SparkSession,
    path: str,
    target: str,
    features: list[str] | None = None,
    keep: list[str] | None = None,
    fmt: str | None = None,
    schema: str | None = None,
    unlabelled: bool = True,
) -> DataFrame:
    """Read a file and split off its label column."""
    return as_labelled(read_table(spark, path, fmt, schema), target, features, keep, unlabelled)


def x_y_split_by_name(columns: list[str]) -> tuple[list[str], list[str]]:
    """Names containing "target" are labels, the others features."""
    return [c for c in columns if "target" not in c], [c for c in columns if "target" in c]


@dataclass
class DatasetRegistry:
    """Named datasets below one folder, listed in a small registry table next to them.

    Every change writes a new version of the table; the highest version is the current one, so a lost job
    never leaves a half-written registry behind.
    """

    spark: SparkSession
    folder: str
    _version: int = field(default=0)

    def _path(self, version: int) -> str:
        return f"{self.folder}/registry/v={version:06d}"

    def _read(self) -> DataFrame:
        if self._version == 0:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self._path(self._version))

    def _write(self, df: DataFrame) -> None:
        df.coalesce(1).write.mode("errorifexists").parquet(self._path(self._version + 1))
        self._version += 1

    def reload(self) -> DatasetRegistry:
        """Look up the newest registry version on disk."""
        try:
            found = self.spark.read.parquet(f"{self.folder}/registry").agg(F.max("v")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None  # no registry yet
        self._version = int(found or 0)
        return self

    def save(self, name: str, data: DataFrame, target: str, features: list[str] | None = None) -> None:
        filename = name.replace(" ", "_")
        data.write.mode("overwrite").parquet(f"{self.folder}/data/{filename}")
        row = self.spark.createDataFrame([(name, filename, target, features)], REGISTRY_SCHEMA)
        self._write(self._read().where(F.col("name") != name).unionByName(row))

    def list(self) -> DataFrame:
        return self._read().orderBy("name")

    def get(self, name: str):
        return self._read().where(F.col("name") == name).first()

    def delete(self, name: str) -> None:
        """Take the name off the list and replace its rows by an empty table of the same shape."""
        info = self.get(name)
        if info is None:
            return
        path = f"{self.folder}/data/{info.filename}"
        schema = self.spark.read.parquet(path).schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        self._write(self._read().where(F.col("name") != name))

    def load(self, name: str, keep: list[str] | None = None) -> DataFrame:
        info = self.get(name)
        if info is None:
            raise KeyError(name)
        return load_labelled(
            self.spark, f"{self.folder}/data/{info.filename}", info.target_column, info.selected_features, keep
        )
