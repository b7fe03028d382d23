"""Sources: trees of files, document tables as files, case files, bug lists."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.exprs import EXCLUDED_DIRS, language_of

INCLUDE = ("*.py", "*.java")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, include: tuple[str, ...], excluded: tuple[str, ...], per_part: int):
        self.root, self.include, self.excluded, self.per_part = root, include, excluded, per_part

    def partitions(self) -> list[_Part]:
        """Lists names only; hidden, empty and underscored files count, which Spark's own file sources skip."""
        found = []
        for d, dirs, files in os.walk(self.root):
            dirs[:] = sorted(x for x in dirs if x not in self.excluded)
            found += [os.path.relpath(os.path.join(d, f), self.root) for f in files if f not in self.excluded and any(fnmatch(f, p) for p in self.include)]
        found = sorted(x.replace(os.sep, "/") for x in found)
        return [_Part(found[k : k + self.per_part]) for k in range(0, len(found), self.per_part)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        for p in partition.paths:
            with open(os.path.join(self.root, p), "rb") as f:
                yield p, f.read().decode("utf-8", "replace")


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root): path (relative) and content of the files of a tree.

    The tree must be visible to every executor.  Options: include (globs joined by commas), exclude (directory
    names joined by commas), filesperpartition.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: StructType) -> _TreeReader:
        o = self.options
        cut = lambda k, d: tuple(x for x in o[k].split(",") if x) if k in o else d
        return _TreeReader(o["path"], cut("include", INCLUDE), cut("exclude", EXCLUDED_DIRS), int(o.get("filesperpartition", 64)))


def source_files(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """path, language, content of a tree of source files."""
    spark.dataSource.register(SourceTree)
    df = spark.read.format("source_tree").option("include", ",".join(include)).option("exclude", ",".join(exclude)).load(os.fspath(root))
    return df.select("path", language_of(F.col("path")).alias("language"), "content")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A document table as files: the path is source/doc_id."""
    return documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def yaml_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML list of maps as a frame; missing keys are null, an empty file has no rows."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    fields = StructType.fromDDL(schema).fieldNames()
    return spark.createDataFrame([tuple(r.get(k) for k in fields) for r in rows], schema)


#: The columns of a bug list's CSV text.
BUG_CSV = "id string, classes string, tests string"


def read_bug_list(spark: SparkSession, path: str, project: str) -> DataFrame:
    """The bugs of a project from files of CSV text (id, modified classes, triggering tests), without a header."""
    return bug_list(spark.read.schema(BUG_CSV).csv(path).withColumn("project", F.lit(project)))


def run_bug_list(spark: SparkSession, command: list[str], project: str, folder: str | None = None) -> DataFrame:
    """The same from what a command writes; one that fails is an error."""
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr.strip()[:300]}")
    lines = spark.createDataFrame([(x,) for x in done.stdout.splitlines() if x.strip()], "line string")
    return bug_list(lines.select(F.from_csv("line", BUG_CSV).alias("b")).select("b.*").withColumn("project", F.lit(project)))


def bug_list(lines: DataFrame) -> DataFrame:
    """project, bug_id, modified_classes, triggering_tests from rows of project, id, classes and tests (lists joined by ;).

    Rows whose id isn't a number or that name no class are left out.
    """
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    out = lines.where(F.col("id").rlike(r"^\d+$")).select("project", F.col("id").alias("bug_id"), cut(F.col("classes")).alias("modified_classes"), cut(F.col("tests")).alias("triggering_tests"))
    return out.where(F.size("modified_classes") > 0)
