"""What the operators share: the shared scratch folder, cutting lineage, and Arrow maps that add columns."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode, where every task can read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs
    one task of the following stage, not the whole history. sweep: let the driver collect its garbage, so that the
    shuffle files of earlier steps go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if sweep:
        del df
        for _ in range(2):  # the second time for what the first has let go
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.5)
    out = spark.read.parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `cut` wrote, once no result still to be computed reads it."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def add_columns(
    df: DataFrame,
    source: str,
    fields: dict[str, str],
    work: Callable[[], Callable[[list], Sequence[list]]],
    keep: Sequence[str],
    rows: int = 1024,
) -> DataFrame:
    """Map-only: `work()` makes, once a task, a function from the values of column `source` to one list for each of
    `fields` (name -> SQL type). The columns `keep` pass through; a field of the same name takes their place."""
    keep = [c for c in keep if c not in fields]
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for batch in batches:
            at = batch.schema.names.index("__source")
            for a in range(0, batch.num_rows, rows):  # small batches bound the memory of both sides
                part = batch.slice(a, rows)
                values = made(part.column(at).to_pylist())
                columns = [part.column(part.schema.names.index(c)) for c in keep]
                columns += [pa.array(v, types[t]) for v, t in zip(values, fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *fields])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source")).mapInArrow(run, schema)


def rows_of(df: DataFrame) -> int:
    return df.count()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
