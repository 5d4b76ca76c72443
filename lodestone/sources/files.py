"""File sources and sinks: JSON lines, archives, typed Parquet, reuse by hash, reports."""

from __future__ import annotations

import hashlib
import json
import os
import tarfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUSINESS = "business_id string, name string, address string, city string, state string, postal_code string, latitude double, longitude double, stars double, review_count bigint, is_open int, attributes string, categories string"
REVIEW = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, text string, date string"
USER = "user_id string, name string"  # and the source's own column of the joining time


def archive_members(path: str | Path, wanted: Sequence[str]) -> dict[str, int]:
    """Sizes of the wanted members of a TAR, read from its headers only; a missing member raises."""
    with tarfile.open(path) as tar:
        found = {m.name: m.size for m in tar if m.isfile() and m.name in set(wanted)}
    if missing := sorted(set(wanted) - set(found)):
        raise FileNotFoundError(f"archive lacks {missing}")
    return found


def extract_members(path: str | Path, wanted: Sequence[str], folder: str | Path) -> list[Path]:
    """Extracts only the wanted members, each to a partial file that is renamed when complete."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    archive_members(path, wanted)
    out = []
    with tarfile.open(path) as tar:
        for name in wanted:
            target = folder / Path(name).name
            part = target.with_suffix(target.suffix + ".partial")
            with tar.extractfile(name) as source, part.open("wb") as sink:  # type: ignore[union-attr]
                while block := source.read(1 << 20):
                    sink.write(block)
            os.replace(part, target)
            out.append(target)
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON lines read with ``schema``; bad lines keep their text in ``_corrupt``. Nested values of string columns stay JSON text."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~broken).select("r.*").drop("_corrupt"), rows.where(broken).select(F.col("value").alias("_corrupt"))


def reject_by_first_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and (reason, n) by the first rule each other row fails; a null rule fails."""
    reason = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules))
    marked = df.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def curated_businesses(raw: DataFrame, city: str, categories: Sequence[str], min_reviews: int = 1) -> tuple[DataFrame, DataFrame]:
    """Open businesses of a city with enough reviews and an allowed category, typed; and the counts of rejections."""
    listed = raw.withColumn("categories", F.filter(F.transform(F.split("categories", ","), lambda x: F.trim(x)), lambda x: x != ""))
    allowed = F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    rules = [("identity", F.col("business_id").isNotNull() & (F.trim("business_id") != "")), ("city", F.lower(F.trim("city")) == city.lower()), ("closed", F.col("is_open") == 1), ("few_reviews", F.col("review_count") >= min_reviews), ("category", allowed)]
    good, rejected = reject_by_first_reason(listed, rules)
    return good.withColumnRenamed("attributes", "attributes_json").drop("is_open", "stars", "review_count"), rejected


def curated_reviews(raw: DataFrame, businesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews of the selected businesses with valid ids, rating, text and date; and the counts of rejections."""
    typed = raw.withColumn("date", F.try_to_timestamp("date").cast("timestamp_ntz")).join(businesses.select("business_id").distinct(), "business_id", "left_semi")
    rules = [("identity", F.coalesce(F.trim("review_id") != "", F.lit(False)) & F.coalesce(F.trim("user_id") != "", F.lit(False))), ("stars", F.col("stars").between(1, 5)), ("text", F.col("text").isNotNull()), ("date", F.col("date").isNotNull())]
    return reject_by_first_reason(typed, rules)


def curated_users(raw: DataFrame, users: DataFrame, since: str) -> DataFrame:
    """(user_id, name, since) of the selected users only; ``since`` names the source's joining time, null where it can't be read."""
    rows = raw.where(F.col("user_id").isNotNull()).join(users.select("user_id").distinct(), "user_id", "left_semi")
    return rows.select("user_id", "name", F.try_to_timestamp(F.col(since)).cast("timestamp_ntz").alias("since"))


def strict_cast(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns and types of ``schema`` (``not null`` allowed); a null in a required column fails the job."""
    out = []
    for field in T._parse_datatype_string(schema).fields:
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"null in required column {field.name}")).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def write_parquet(df: DataFrame, path: str, schema: str | None = None) -> None:
    """Writes ZSTD Parquet; Spark commits the folder only when all tasks have succeeded."""
    (strict_cast(df, schema) if schema else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def atomic_text(path: str | Path, text: str) -> None:
    """Writes beside the target and renames, so a reader sees the old or the new file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".partial")
    part.write_bytes(text.encode("utf-8"))
    os.replace(part, path)


def atomic_json(path: str | Path, value: object) -> None:
    """Byte-stable JSON: sorted keys, fixed spacing, final newline."""
    atomic_text(path, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n")


def fingerprint(paths: Sequence[str | Path], config: Mapping[str, object]) -> str:
    """SHA-256 over names, sizes and times of change of the files, in order, and the configuration; no content is read."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode())
    for path in paths:
        for part in sorted(Path(path).rglob("*.parquet")) if Path(path).is_dir() else [Path(path)]:
            known = part.stat()
            digest.update(f"{part.name}\x1f{known.st_size}\x1f{known.st_mtime_ns}\n".encode())
    return digest.hexdigest()


def built_once(spark: SparkSession, out: str, inputs: Sequence[str | Path], config: Mapping[str, object], build) -> DataFrame:  # noqa: ANN001
    """The table ``out``: reused if its manifest has the fingerprint of inputs and configuration, else built by ``build()``.

    ``out`` may be on any file system. The manifest goes first and comes back last, so a broken build is never reused.
    """
    manifest, now = f"{out}.manifest.json", fingerprint(inputs, config)
    known = json.loads("".join(r[0] for r in spark.read.text(manifest, wholetext=True).collect())) if exists(spark, manifest) else {}
    if known.get("fingerprint") != now or not exists(spark, f"{out}/_SUCCESS"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        write_parquet(build(), out)
        spark.createDataFrame([(json.dumps({"fingerprint": now, "config": dict(config)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(out)


def csv_report(df: DataFrame, path: str | Path, limit: int = 10_000) -> None:
    """A flat report file; a report of more than ``limit`` rows is refused, not cut."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"report has more than {limit} rows")
    atomic_text(path, rows.to_csv(index=False))


def markdown_report(df: DataFrame, path: str | Path, title: str, limit: int = 1_000) -> None:
    """A table under a title; bounded like :func:`csv_report`."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"report has more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    atomic_text(path, "\n".join(lines) + "\n")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class VersionedStore:
    """Rows by key in an append-only Parquet table: a put adds versions, a read takes the latest of each key by ``order``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), list(order)

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        """One row a key; nulls of ``order`` come before all values."""
        rows = self.spark.read.parquet(self.path)
        rest = [n for n in rows.columns if n not in self.keys and n not in self.order]
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("x")).select(*self.keys, *(F.col(f"x.{n}") for n in (*self.order, *rest)))


class VectorCache:
    """Vectors by the hash of their text, as a Parquet table: new ones are appended, the first written stands."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        """What was written so far; a cache that can't be read raises, only one that isn't there is empty."""
        schema = "text_sha256 string, vector array<float>"
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).dropDuplicates(["text_sha256"])

    def encode(self, texts: DataFrame, text_col: str, encoder) -> DataFrame:  # noqa: ANN001
        """``texts`` with vector; only texts not in the cache go through ``encoder(list of texts) -> list of vectors``, in Arrow batches."""
        import pyarrow as pa

        keyed = texts.withColumn("text_sha256", F.sha2(text_col, 256))
        fresh = keyed.where(F.col(text_col).isNotNull()).select("text_sha256", F.col(text_col).alias("t")).dropDuplicates(["text_sha256"]).join(self.load(), "text_sha256", "left_anti")

        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, v)) for v in encoder(b.column(1).to_pylist())], pa.list_(pa.float32()))], ["text_sha256", "vector"])

        fresh.mapInArrow(run, "text_sha256 string, vector array<float>").write.mode("append").parquet(self.path)
        return keyed.join(self.load(), "text_sha256", "left")
