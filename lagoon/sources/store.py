"""Stored correlation tables: Parquet by year and pair, metadata beside them, validation and merging."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions import hashing
from lagoon.sources import operations


def _dealt(data: DataFrame, time: str, pair: str) -> DataFrame:
    """Rows dealt by pair and day: a pair's year, gigabytes of correlations, is written by many tasks, and
    small days are put together at run time."""
    return data.withColumn("year", F.year(time)).repartition(F.col("year"), F.col(pair), F.to_date(F.col(time)))


def write(data: DataFrame, path: str, metadata: dict, time: str = "time", pair: str = "pair") -> bool:
    """Writes the table by year and pair, and its metadata with their hash; False where no row is done.

    Files become visible when the job commits; partitions that are written again are replaced.
    """
    if not data.where("status = 1").limit(1).count():
        return False
    spark = data.sparkSession
    _dealt(data, time, pair).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", pair).parquet(f"{path}/xc")
    meta = metadata | {"sha256_hash_metadata": hashing.hash_object(metadata)}
    spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a stored table, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(data: DataFrame, path: str, metadata: dict, time: str = "time", pair: str = "pair") -> None:
    """Adds rows to a table (or begins it). Rows of one key are resolved when the table is merged, so a
    run that is repeated or resumed only ever adds files."""
    spark = data.sparkSession
    digest = hashing.hash_object(metadata)
    if not exists(spark, path):
        meta = metadata | {"sha256_hash_metadata": digest}
        spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.parquet(f"{path}/meta")
    elif not validate(read_metadata(spark, path), digest):
        raise ValueError("the stored table has other metadata")
    _dealt(data, time, pair).write.mode("append").partitionBy("year", pair).parquet(f"{path}/xc")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return {r.key: json.loads(r.value) for r in spark.read.parquet(f"{path}/meta").collect()}  # a few attributes


def validate(
    metadata: dict, metadata_hash: str | None = None, required: tuple[str, ...] = ("title", "institution", "author", "source"), *,
    preprocess_hash: str | None = None, version: str | None = None, columns: dict[str, str] | None = None, schema=None,
) -> bool:
    """Whether required attributes are there and the hash is theirs (and the one expected).

    Further gates where given: the hash of the ``preprocess`` recipes (JSON, whose own hash must hold), the
    version that wrote the table, and columns by name and type that a ``schema`` must have.
    """
    own = metadata.get("sha256_hash_metadata")
    if not all(k in metadata for k in required) or own != hashing.hash_object(metadata) or (metadata_hash is not None and own != metadata_hash):
        return False
    if preprocess_hash is not None:
        try:
            if operations.operations_to_dict(metadata.get("preprocess", "{}"))["sha256_hash"] != preprocess_hash:
                return False
        except ValueError:
            return False
    if version is not None and metadata.get("lagoon_version") != version:
        return False
    have = {f.name: f.dataType.simpleString() for f in schema} if schema is not None else {}
    return columns is None or all(have.get(c) == kind for c, kind in columns.items())


def read(spark: SparkSession, path: str, extract: bool = False, **checks) -> DataFrame | None:
    """The table, or None where its metadata are not valid; ``extract`` hides what is not done."""
    data = spark.read.parquet(f"{path}/xc")
    if not validate(read_metadata(spark, path), schema=data.schema, **checks):
        return None
    for f in data.schema:  # spans of time are read as seconds
        if f.dataType.typeName().startswith("interval day") or f.dataType.simpleString().startswith("interval day"):
            data = data.withColumn(f.name, F.extract(F.lit("DAY"), f.name) * 86400.0 + F.extract(F.lit("HOUR"), f.name) * 3600 + F.extract(F.lit("MINUTE"), f.name) * 60 + F.extract(F.lit("SECOND"), f.name).cast("double"))
    return _masked(data) if extract else data


def _masked(data: DataFrame) -> DataFrame:
    return data.withColumn("cc", F.when(F.col("status") == 1, F.col("cc")))


def mfread(spark: SparkSession, paths: list[str], extract: bool = False) -> DataFrame | None:
    """Valid tables whose metadata equal the first valid one's, united.

    All metadata are read in one job; tables get the first one's schema, so none is opened to infer it.
    """
    if not paths:
        return None
    folder = F.regexp_extract(F.input_file_name(), "([^/]+)/meta/[^/]*$", 1)
    by_folder: dict[str, dict] = {}
    if len({p.rstrip("/").rsplit("/", 1)[-1] for p in paths}) == len(paths):
        # a few attributes of each table
        for r in spark.read.parquet(*[f"{p.rstrip('/')}/meta" for p in paths]).select(folder.alias("folder"), "key", "value").collect():
            by_folder.setdefault(unquote(r.folder), {})[r.key] = json.loads(r.value)
    found, template, schema = None, None, None
    for p in sorted(paths):
        meta = by_folder.get(p.rstrip("/").rsplit("/", 1)[-1]) or read_metadata(spark, p)
        if not validate(meta, template):
            continue
        template = template or meta["sha256_hash_metadata"]
        data = (spark.read.schema(schema) if schema else spark.read).parquet(f"{p}/xc")
        schema = schema or data.schema
        found = data if found is None else found.unionByName(data)
    return None if found is None else merge([_masked(found) if extract else found])


def validate_list(files: DataFrame, path: str = "path", digest: str = "hash", ok: str = "valid") -> DataFrame:
    """Valid files whose hash is the first valid file's."""
    first = files.where(F.col(ok)).agg(F.min_by(digest, path).alias("_h"))
    return files.where(F.col(ok)).join(F.broadcast(first), F.col(digest) == F.col("_h"), "left_semi")  # one row


def merge(tables: list[DataFrame], keys: tuple[str, ...] = ("pair", "time")) -> DataFrame:
    """Outer combination on keys: of rows of one key the done one, then the first table's."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("_i", F.lit(i))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    order = [F.desc(F.col("status") == 1)] if "status" in rows.columns else []
    w = Window.partitionBy(*keys).orderBy(*order, "_i")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_i")


def combine_first(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys; values of ``new`` where it has them, else of ``old``."""
    a, b = new.alias("a"), old.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, cond, "full").select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in new.columns])


def historicize(metadata: dict, operation: str, arguments: dict, version: str) -> dict:
    """Metadata with an operation appended to their history."""
    line = f"lagoon-{version}: {operation}({json.dumps(arguments, sort_keys=True)})"
    return metadata | {"history": [*metadata.get("history", []), line]}
