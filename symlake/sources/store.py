"""An index of Parquet tables: keyed upserts, replacement by file, counters, one commit for all tables.

Tables are cut into BUCKETS by a hash of the file (or key) of a row.  A write makes new
folders for the buckets that it touches and leaves the others as they are.  What belongs
to the index is said by a manifest; each commit writes the next one under a name of its
own, by a rename, so readers see all tables before or after a commit and an interrupted
one changes nothing.  Folders that the last KEPT manifests don't name are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULTS, TABLES

BUCKETS, KEPT = 64, 3


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt and merged, not broadcast: what is made from source files is far larger than Spark
    guesses from the tables that it comes from."""
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """Written as Parquet to the session's shared folder, where it has one, for frames that are costly and read often."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key; of rows of new with one key the last counts."""
    order = order or (["ord"] if "ord" in new.columns else [F.lit(0)])
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last_wins(new, keys, order), allowMissingColumns=True)


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame, column: str = "file_path") -> DataFrame:
    """old without the rows of the given files (one column), with new."""
    return old.join(files.toDF(column).distinct(), column, "left_anti").unionByName(new, allowMissingColumns=True)


def bucket_of(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, column: str) -> list[int]:
    """The buckets of a column's values."""
    return sorted(r.b for r in rows.select(bucket_of(column).alias("b")).distinct().collect())  # BUCKETS rows at most


class Store:
    """Tables of an index under one folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, dict[str, str]] | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._path(folder), self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self) -> list[str]:
        return [x for x in self._names("manifests") if x.endswith(".json")]

    def _manifest(self, name: str | None = None) -> dict[str, dict[str, str]]:
        """For each table the folder of each bucket, as the open commit or the last one has it."""
        if name is None and self._open is not None:
            return self._open
        found = self._manifests() if name is None else [name]
        return json.loads(self.spark.read.option("wholetext", True).text(self._path(f"manifests/{found[-1]}").toString()).first()[0]) if found else {}

    @contextmanager
    def commit(self) -> Iterator[Store]:
        """What is written inside becomes visible to others at once, at the end; within, reads see it already.  Commits may be nested."""
        if self._open is not None:
            yield self
            return
        last = self._manifests()
        self._open = self._manifest()
        try:
            yield self
            number = int(last[-1].split(".")[0]) + 1 if last else 1
            self._publish(f"{number:012d}.json", self._open)
        finally:
            self._open = None
        self._clean()

    def _publish(self, name: str, manifest: dict[str, dict[str, str]]) -> None:
        fs, made, final = self._fs(), self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{name}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(made, final):
            fs.delete(made, False)
            raise RuntimeError(f"another commit has been made meanwhile: {name}")

    def _clean(self) -> None:
        fs, all_ = self._fs(), self._manifests()
        for name in all_[:-KEPT]:
            fs.delete(self._path(f"manifests/{name}"), False)
        named = {f"{t}/{folder}" for m in all_[-KEPT:] for t, buckets in self._manifest(m).items() for folder in buckets.values()}
        for t in TABLES:
            for version in self._names(t):
                left = [b for b in self._names(f"{t}/{version}") if b.startswith("bucket=")]
                stale = [b for b in left if f"{t}/{version}/{b}" not in named]
                for folder in [version] if len(stale) == len(left) else [f"{version}/{b}" for b in stale]:
                    fs.delete(self._path(f"{t}/{folder}"), True)

    def _bucket(self, table: str) -> F.Column:
        _, keys, column = TABLES[table]
        return bucket_of(column or keys[0])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it; empty if there is none.  Columns that older rows lack have their default, or null."""
        schema = TABLES[table][0]
        held = self._manifest().get(table, {})
        paths = [f"{self.root}/{table}/{folder}" for b, folder in sorted(held.items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumns({c: F.coalesce(c, F.expr(v)) for c, v in DEFAULTS.get(table, {}).items()})

    def _put(self, table: str, rows: DataFrame, buckets: list[int] | None) -> None:
        """Rows become the given buckets of the table, or all of it."""
        schema, version = TABLES[table][0], f"v{uuid.uuid4().hex}"
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        rows.withColumn("bucket", self._bucket(table)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{table}/{version}")
        made = {x.partition("=")[2]: f"{version}/{x}" for x in self._names(f"{table}/{version}") if x.startswith("bucket=")}
        with self.commit():
            kept = {} if buckets is None else {b: f for b, f in self._open.get(table, {}).items() if int(b) not in buckets}
            self._open = self._open | {table: kept | made}

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        return buckets_of(rows, TABLES[table][2] or TABLES[table][1][0])

    def write(self, table: str, rows: DataFrame) -> None:
        self._put(table, rows, None)

    def upsert(self, table: str, rows: DataFrame, touched: list[int] | None = None) -> None:
        """touched: the buckets of the rows' files, where they are known already; as in the others below."""
        touched = self._touched(table, rows) if touched is None else touched
        self._put(table, upsert(self.read(table, touched), rows, TABLES[table][1]), touched)

    def replace_files(self, table: str, rows: DataFrame, files: DataFrame, touched: list[int] | None = None) -> None:
        """Rows of these files go, then the new ones come, the last of each key."""
        _, keys, column = TABLES[table]
        order = ["ord"] if "ord" in rows.columns else [F.col("line_start").desc_nulls_last()] if "line_start" in rows.columns else [F.lit(0)]
        touched = self._touched(table, files.toDF(column)) if touched is None else touched
        self._put(table, replace_by_file(self.read(table, touched), last_wins(rows, keys, order), files, column), touched)

    def replace_ids(self, table: str, rows: DataFrame, owners: DataFrame, touched: list[int] | None = None) -> None:
        """Rows with the ids of owners (id, and the file's column) go, then the new ones come."""
        touched = self._touched(table, owners) if touched is None else touched
        self._put(table, self.read(table, touched).join(owners.select("id").distinct(), "id", "left_anti").unionByName(rows, allowMissingColumns=True), touched)

    def counters(self) -> DataFrame:
        """name, n for the tables of the index."""
        parts = [self.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("files", "symbols", "chunks", "symbol_edges")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
