"""Token ids in ORC files, and what is read back from them.

Rows are dealt out by ranges of the document id, sorted within each range, encoded there, and written as
one ORC file a range, so that file order is id order. ORC stores the ids with integer run-length encoding
in stripes, with row indexes and Bloom filters on the document id: a reader takes stripes in parallel and
skips those whose statistics or filters rule an id out.

A row of a file: the document id, the number of its range (`shard`), the number of ids before it in that
range (`before`), how many it has (`n_ids`), and its ids, which end with END. Only one number a file goes
to the driver: the ids it holds.

Edge cases: a null or empty text holds END alone; null document ids come first; rows of the same id stand
in order of a hash of their texts, repeated rows side by side; an empty table gives an empty result;
other columns are ignored. A text is encoded piece by piece: the library's model takes the pieces that a
cache lacks, and the library the whole text if it holds the string of an added token.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import Pieces
from tidemark.llm.common import chunks, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
END = 0
STRIDE, STRIPE_BYTES = 1000, 16 << 20


def alphabet() -> dict[int, str]:
    """The characters by which the byte-level model names bytes: printable ones of Latin-1 stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Library(Pieces):
    """The tokenizers library's model over the pieces that the cache lacks."""

    #: A byte that UTF-8 never holds parts the pieces, and becomes a space, which no byte is named by.
    PART = 255
    ALPHABET = str.maketrans(alphabet() | {PART: " "})

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = self.tokenizer.model.tokenize
        found = [[t.id for t in split(p)] for p in bytes([self.PART]).join(pieces).decode("latin-1").translate(self.ALPHABET).split(" ")]
        return np.fromiter(itertools.chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_flat(), with END behind the ids of each text."""
        whole = {i: self.tokenizer.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts) if any(t in x for t in self.added)}
        ids, cuts = self.encode_flat(["" if i in whole else x for i, x in enumerate(texts)] if whole else texts)
        sizes = np.diff(cuts)
        for i, own in whole.items():
            sizes[i] = len(own)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(int(starts[-1]), END, np.int32)
        place = np.ones(len(out), bool)
        place[starts[1:] - 1] = False
        for i, own in whole.items():
            out[starts[i] : starts[i + 1] - 1] = own
            place[starts[i] : starts[i + 1]] = False
        out[place] = ids
        return out, starts


@functools.cache
def library(path: str) -> Library:
    return Library(path)


def write(df: DataFrame, to: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """The ids of all texts, in files of ascending ids, under `to`."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = df.select(F.col(key), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).cast("string").alias("_text"))
    dealt = one.repartitionByRange(n, F.col(key).asc_nulls_first(), "_hash").sortWithinPartitions(F.col(key).asc_nulls_first(), "_hash").select(key, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, before = library(path), TaskContext.get().partitionId(), 0
        for part, texts in chunks(batches):
            flat, starts = own.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(texts), shard, np.int32)), pa.array(starts[:-1] + before), pa.array(np.diff(starts).astype(np.int32)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))], names=[key, "shard", "before", "n_ids", "ids"])
            before += int(starts[-1])

    encoded = dealt.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, shard int, before bigint, n_ids int, ids array<int>")
    encoded.write.option("orc.bloom.filter.columns", key).option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE_BYTES).option("orc.compress", "ZSTD").orc(to)


def read(spark: SparkSession, where: str) -> DataFrame:
    """The rows of the files, with `start`: ids of all documents before."""
    rows = spark.read.orc(where)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, itertools.accumulate((n for _, n in sizes), initial=0))], "shard int, _base long")
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of rows that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy().tolist()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in itertools.pairwise(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return rows.select(key, "start", "ids").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), to)
    return checksums(read(spark, to))
