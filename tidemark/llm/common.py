"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points that one chunk of whole texts holds before it is worked on.
CHUNK = 1 << 19
#: Bytes that an Arrow batch between Spark and its Python workers holds (more if one row is longer), where the session doesn't set any. Spark bounds rows alone, and whole texts make 10,000 rows tens of MB, several times over on either side.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def own_dir() -> str:
    """One temporary folder a driver that is a whole machine's Spark by itself."""
    return tempfile.mkdtemp(prefix="tidemark-")


#: Paths that this driver has written.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Where that is unset: in the warehouse on a cluster, a temporary one if Spark runs in this process alone."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master)
        base = own_dir() if alone else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def cleared(spark: SparkSession) -> int:
    """Deletes what this driver has written to the shared folder; results that haven't been read or written elsewhere are lost. Gives the number of paths."""
    jvm = spark.sparkContext._jvm
    n = 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: cuts the lineage, survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed_path(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing needs any more: what was made of it is stored itself."""
    sc = df.sparkSession.sparkContext
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def trimmer() -> Callable[[int], int] | None:
    """glibc's malloc_trim(); other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def freed() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := trimmer():
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of few bytes. A worker process outlives its task, and an executor has more of them than cores: what is free after a task goes back to the system."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            freed()

    return df.mapInArrow(task, schema)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = CHUNK, least: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about `most` code points (more if one text is longer) with their texts, nulls as empty. Shorter texts count as `least` code points."""
    for batch in batches:
        column = batch.column(text)
        sizes = [max(n or 0, least) for n in pc.binary_length(column).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                part = batch.slice(begin, i - begin)
                yield part, [x or "" for x in part.column(text).to_pylist()]
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            part = batch.slice(begin)
            yield part, [x or "" for x in part.column(text).to_pylist()]


def packed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _text, _doc): the other columns in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c != text]
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*rest).alias("_doc"))


def unpacked(df: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `like`, with the texts of df."""
    return df.select(*(F.col("_text" if c == text else f"_doc.`{c}`").alias(c) for c in like.columns))


def recounted(df: DataFrame, text: str = "text") -> DataFrame:
    """n_chars, where there is such a column, as the text has them."""
    return df.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df
