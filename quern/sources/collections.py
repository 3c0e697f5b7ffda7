"""Named collections of chunks and sets of tables as versioned Parquet, and database tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions import text as T
from quern.operators import ingest

CHUNK = "id string, text string, source_type string, url string, pdf string, title string, page int, chunk_index int, language string, source_group string, embedding array<float>, model string"
#: Parts of a collection; a write makes those anew that its rows fall into.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the version that this one was to be."""


class Snapshots:
    """Versions of a set of named parts under ``path``: ``v000001.json`` names the folders of each part.

    A version is one file that is created only if it is not there, so of two writers of one version
    the later fails and has to read again; readers see whole versions. Parts that a version does not
    change stay where an earlier one wrote them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, path = self._hadoop(self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def parts(self, version: int) -> dict[str, str]:
        """Folder of each part of a version; version 0 has none."""
        if version == 0:
            return {}
        text = self.spark.read.text(f"{self.path}/v{version:06d}.json", wholetext=True).first()
        return json.loads(text.value)

    def newest(self) -> tuple[int, dict[str, str]]:
        found = self.versions()
        n = found[-1] if found else 0
        return n, self.parts(n)

    def new_folder(self) -> str:
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def commit(self, base: int, changed: Mapping[str, str]) -> int:
        """Make version ``base + 1`` with the ``changed`` parts; ``Conflict`` if there is one already."""
        fs, _ = self._hadoop(self.path)
        target = f"{self.path}/v{base + 1:06d}.json"
        try:
            out = fs.create(self._hadoop(target)[1], False)
        except Exception as e:
            raise Conflict(target) from e
        out.write(bytearray(json.dumps({**self.parts(base), **changed}).encode()))
        out.close()
        return base + 1

    def write(self, tables: Mapping[str, DataFrame]) -> int:
        """All ``tables`` by name as one version: all of them can be read afterwards, or none."""
        base, _ = self.newest()
        folder = self.new_folder()
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
        return self.commit(base, {name: f"{folder}/{name}" for name in tables})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.newest()[1][name])


class Collection:
    """A table of chunks under ``root/name``, in buckets by the part of the id before its chunk number."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark = spark
        self.store = Snapshots(spark, f"{root.rstrip('/')}/{name}")

    def _of(self, folders: Iterable[str]) -> DataFrame:
        folders = sorted(set(folders))
        return self.spark.read.schema(CHUNK).parquet(*folders) if folders else self.spark.createDataFrame([], CHUNK)

    def read(self) -> DataFrame:
        """All chunks of the newest version; none if there is no version yet."""
        return self._of(self.store.newest()[1].values())

    def count(self) -> int:
        """Rows of the collection, 0 where it cannot be read."""
        try:
            return self.read().count()
        except AnalysisException:
            return 0

    def stage(self, rows: DataFrame) -> DataFrame:
        """``rows`` written once beside the collection and read back: what follows computes nothing of them again."""
        folder = f"{self.store.path}/staged-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], CHUNK).unionByName(rows, allowMissingColumns=True).write.parquet(folder)
        return self.spark.read.schema(CHUNK).parquet(folder)

    def drop_staged(self) -> None:
        """Delete what ``stage`` wrote."""
        fs, path = self.store._hadoop(self.store.path)
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName().startswith("staged-"):
                fs.delete(s.getPath(), True)

    def upsert(self, new: DataFrame, drop_stale: bool = False) -> None:
        """Insert or replace by id; with ``drop_stale`` other rows of the addresses written go.

        Of rows of one id the last by chunk_index, title and text stands. ``new`` is read several times,
        so hand in staged rows where they are dear. Only buckets that rows fall into are written; the
        rest of the collection stays as it is.
        """
        new = self.spark.createDataFrame([], CHUNK).unionByName(new, allowMissingColumns=True)
        base, parts = self.store.newest()
        old = self._of(parts.values())
        stored, fresh = (r.select("model").where("model is not null") for r in (old, new))
        models = {r.model for rows in (stored.limit(1), fresh.distinct().limit(2)) for r in rows.collect()}
        if len(models) > 1:
            raise ValueError(f"vectors of different models in one collection: {sorted(models)}")
        bucket = F.pmod(F.xxhash64(F.regexp_replace(F.coalesce("id", F.lit("")), r"::c[0-9]+$", "")), F.lit(BUCKETS)).cast("int")
        touched = new.select(bucket.alias("b")).distinct()
        if drop_stale:
            touched = touched.unionByName(old.join(new.select("url").where("url is not null").distinct(), "url", "left_semi").select(bucket.alias("b"))).distinct()
        touched = sorted(r.b for r in touched.collect())
        if not touched:
            return
        rows = self._of(parts[str(b)] for b in touched if str(b) in parts)
        if drop_stale:
            rows = ingest.without_stale(rows, new)
        merged = ingest.upsert(rows, new, order=["chunk_index", "title", "text"]).withColumn("bucket", bucket)
        folder = self.store.new_folder()
        merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
        written = self._buckets(folder)
        # a bucket whose rows are all gone keeps an empty folder
        changed = {str(b): f"{folder}/bucket={b}" for b in touched if str(b) in written}
        empty = [str(b) for b in touched if str(b) not in written]
        if empty:
            self.spark.createDataFrame([], CHUNK).write.parquet(f"{folder}/none")
            changed |= dict.fromkeys(empty, f"{folder}/none")
        self.store.commit(base, changed)

    def _buckets(self, folder: str) -> set[str]:
        """Buckets that a write left files for, from the names of its folders."""
        fs, path = self.store._hadoop(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {n.split("=")[1] for n in names if n.startswith("bucket=")}

    def filtered(self, **equal: str) -> DataFrame:
        """Chunks whose columns have the given values (pushed down to the files)."""
        out = self.read()
        for name, value in equal.items():
            out = out.where(F.col(name) == value)
        return out


def source_counts(chunks: DataFrame) -> DataFrame:
    """(source_type, n): rows by kind of source; null counts as pdf."""
    return chunks.groupBy(F.coalesce("source_type", F.lit("pdf")).alias("source_type")).agg(F.count("*").alias("n")).orderBy("source_type")


def pdf_counts(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """(pdf, n): rows by file, blank names left out, names starting with ``prefix`` only."""
    named = chunks.where((T.strip(F.coalesce("pdf", F.lit(""))) != "") & F.col("pdf").startswith(prefix))
    return named.groupBy("pdf").agg(F.count("*").alias("n")).orderBy("pdf")


def sample(chunks: DataFrame, order: list[str], n: int = 3, chars: int = 240) -> DataFrame:
    """The first rows by ``order`` with a collapsed preview and its language."""
    short = F.substring(T.collapse(F.col("text")), 1, chars)
    return chunks.orderBy(*order).limit(n).select(*order, short.alias("preview"), T.preview_language(F.col("text")).alias("preview_language"))


def json_keys(rows: DataFrame, json_col: str) -> DataFrame:
    """(key): distinct top-level keys of JSON objects, ordered; malformed rows have none."""
    return rows.select(F.explode(F.json_object_keys(json_col)).alias("key")).distinct().orderBy("key")


def metadata_keys(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(key): columns that are filled in some row, ordered."""
    filled = chunks.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    return filled.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in columns]))).alias("key")).orderBy("key")


def jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; ``partition`` (column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
