"""Readers and writers."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, schema=None, split: str = "train") -> DataFrame:
    """JSON lines, CSV, TSV or Parquet by suffix; any other path is a Parquet folder."""
    if path.endswith((".jsonl", ".json", ".jsonl.gz", ".jsonl.zst")):
        if split != "train":
            raise ValueError("local files have the split train only")
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(path)
    if path.endswith((".csv", ".tsv")):
        reader = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


class Catalog:
    """Dataset names with revisions and splits to folders below a root."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str, split: str = "train", revision: str = "main") -> str:
        return f"{self.root}/{name}/{revision}/{split}.parquet"

    def read(self, spark: SparkSession, name: str, split: str = "train", revision: str = "main") -> DataFrame:
        return spark.read.parquet(self.path(name, split, revision))


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def read_with_file(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines with the stem of their file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path).select("*", F.regexp_extract("_metadata.file_name", r"^(.*?)\.jsonl?", 1).alias("file"))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table through JDBC; give partitionColumn, bounds and numPartitions for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


BATCH_RESULT = "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<role:string,content:string>, finish_reason:string>>, usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>, error string"


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, content, finish_reason, prompt_tokens, completion_tokens) of batch responses."""
    r = spark.read.schema(BATCH_RESULT).json(path)
    choice = F.try_element_at("response.body.choices", F.lit(1))
    return r.select("custom_id", choice["message"]["content"].alias("content"), choice["finish_reason"].alias("finish_reason"), F.col("response.body.usage.prompt_tokens").alias("prompt_tokens"), F.col("response.body.usage.completion_tokens").alias("completion_tokens"))


def usage_cost(results: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    return results.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), (F.sum(F.coalesce("prompt_tokens", F.lit(0)) * prompt_price + F.coalesce("completion_tokens", F.lit(0)) * completion_price) / 1e6).alias("cost"))


def write_jsonl(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).json(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_shards(df: DataFrame, path: str, index: str, size: int = 250) -> None:
    """Shards of a dense index, a folder each."""
    df.withColumn("shard", F.floor(F.col(index) / size)).repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def config_hash(config: dict, version: str = "v1") -> str:
    return hashlib.sha256(json.dumps(config | {"version": version}, sort_keys=True).encode()).hexdigest()[:10]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, root: str, config: dict, make) -> DataFrame:
    """The result stored under the hash of its config, made and written on the first call.

    A result counts as stored when its commit mark is there; any other error of reading is raised,
    and nothing that is stored is overwritten.
    """
    path = f"{root.rstrip('/')}/{config_hash(config)}"
    if not _exists(spark, f"{path}/data/_SUCCESS"):
        # Left over of a run that broke off: it has no commit mark.
        make().write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return spark.read.parquet(f"{path}/data")


def token_dtype(vocabulary: int) -> str:
    """Smallest unsigned type that holds every id."""
    return next(name for name, bits in (("uint8", 8), ("uint16", 16), ("uint32", 32), ("uint64", 64)) if vocabulary - 1 < 2**bits)


def export_tokens(df: DataFrame, path: str, shard: str, order: str, ids: str, labels: str, vocabulary: int) -> DataFrame:
    """Token files, label masks and gzip CSVs of boundaries, one set a shard; returns their sizes.

    A shard's files are written under a temporary name and renamed, the boundaries last: they are
    the commit mark, so a task that is repeated leaves whole files only. ``path`` must be a folder
    that all executors share.
    """
    import gzip

    import numpy as np
    import pandas as pd

    dtype = token_dtype(vocabulary)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        name = str(pdf[shard].iloc[0])
        os.makedirs(path, exist_ok=True)
        flat = np.concatenate([np.asarray(x, dtype) for x in pdf[ids]]) if len(pdf) else np.empty(0, dtype)
        mask = np.concatenate([np.asarray(x) != -100 for x in pdf[labels]])
        ends = np.cumsum([len(x) for x in pdf[ids]])
        for suffix, data in (("tokens", flat.tobytes()), ("labels_mask", mask.tobytes()), ("csv.gz", gzip.compress("".join(f"{a},{b}\n" for a, b in zip([0, *ends[:-1]], ends)).encode(), mtime=0))):
            temporary = f"{path}/.{name}.{suffix}.{os.getpid()}"
            with open(temporary, "wb") as f:
                f.write(data)
            os.replace(temporary, f"{path}/part-{name}.{suffix}")
        return pd.DataFrame({"shard": [name], "documents": [len(pdf)], "tokens": [len(flat)], "trainable": [int(mask.sum())]})

    return df.select(shard, order, ids, labels).groupBy(shard).applyInPandas(run, "shard string, documents bigint, tokens bigint, trainable bigint")


def encode_tests(x: Column) -> Column:
    """JSON text as base64 of zlib."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(s):
        import base64
        import zlib

        return s.map(lambda v: None if v is None else base64.b64encode(zlib.compress(v.encode())).decode())

    return run(x)


def decode_tests(x: Column) -> Column:
    """JSON, plain or as base64 of zlib; anything else is null. Pickles are never loaded."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(s):
        import base64
        import zlib

        def one(v):
            if v is None:
                return None
            try:
                json.loads(v)
                return v
            except ValueError:
                pass
            try:
                out = zlib.decompress(base64.b64decode(v, validate=True)).decode("utf-8")
                json.loads(out)
                return out
            except Exception:  # noqa: BLE001
                return None

        return s.map(one)

    return run(x)


def markdown(df: DataFrame, order: str, digits: dict[str, int] | None = None) -> str:
    """A small result as a Markdown table."""
    rows = df.orderBy(order).limit(10_000).collect()
    cell = lambda c, v: f"{v:.{(digits or {}).get(c, 2)}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in rows])
