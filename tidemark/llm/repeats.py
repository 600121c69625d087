"""Removal of repeated byte strings by sorted contexts of sampled suffixes.

Every string of LENGTH bytes has an anchor: a GRAM-byte window in it whose hash is the least. Equal
strings have equal anchors at equal places, so it is enough to look at the suffixes that start at anchors.
The corpus is cut into shards (runs of whole documents within a task). A shard sorts its anchored suffixes,
cut off at LENGTH bytes, each with the bytes before it; suffixes whose contexts are the same on both sides
become one row that lists its places. Shards meet by anchor. There the interleave of their rows is refined
in rounds: all rows start as one block, and in each round the blocks are split by the next 8 bytes; where a
block splits, the common prefix of the neighbours is known. The same, from the anchor to the left, gives
common extensions to the left. A string that starts o bytes before the anchor is repeated if another row
agrees with it for o bytes to the left and LENGTH - o to the right: for each o the intervals of common
prefixes number the rows on both sides, and rows with equal numbers are repeated.

An anchor that stands in more than HEAVY places would bring too many rows to one task. Its shards' rows are
taken where the texts are, without a shuffle of texts, and each string that holds the anchor is counted on
its own, by a digest of its bytes: counts are added up before and after a shuffle, so that no group of rows
ever meets in one task, however common it is. Strings of SPAN neighbouring places have most of their bytes in
common; where that part stands once only, none of them is looked at.

Anchors met once in the corpus hold no repeated string and are left out before contexts are cut.

Texts travel between tasks compressed one by one, which takes about half the room of Spark's own block
compression.

Edge cases: null texts count as empty; texts under LENGTH bytes keep all; repeated rows are copies of
each other, so long ones lose all; keys may be null or repeated; an empty table gives an empty result;
other columns are ignored. Strings are compared as bytes, so a cut may leave half a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, removed_path, stored, table
from tidemark.llm.quality import TABLE, mixed, powers

LENGTH, GRAM = 400, 128
#: Grams in a string, and the most bytes that a string has before its anchor.
GRAMS = LENGTH - GRAM + 1
WIDTH = LENGTH - GRAM
#: Documents of a shard, and bytes beyond which it takes no further one.
SHARD, SHARD_BYTES = 500, 1 << 22
#: Places of an anchor beyond which its strings are counted one by one.
HEAVY = 65_536


def extreme(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each `width` values in a row, by running extremes within blocks from both sides."""
    f = np.minimum if least else np.maximum
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    fill = np.uint64(2**64 - 1 if least else 0)
    blocks = np.full(rows * width, fill)
    blocks[: len(x)] = x
    blocks = blocks.reshape(rows, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of a text of bytes; of grams of the same hash each is one."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * up[: len(data)], dtype=np.uint64)])
    n = len(data) - GRAM + 1
    grams = mixed((total[GRAM:] - total[:n]) * down[:n])
    least = extreme(grams, GRAMS, True)
    # a gram is an anchor if one of the strings that hold it has no lesser one
    around = np.concatenate([np.zeros(GRAMS - 1, np.uint64), least, np.zeros(GRAMS - 1, np.uint64)])
    at = np.flatnonzero(extreme(around, GRAMS, False) == grams)
    return at, grams[at]


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, which compare as the bytes do."""
    n, size = rows.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = rows
    return padded.view(">u8").astype(np.uint64)


def common_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes of unlike words agree."""
    differ = x ^ y
    out = np.zeros(len(x), np.int64)
    for skip in (4, 2, 1):
        zero = differ >> np.uint64(64 - 8 * skip) == 0
        out += np.where(zero, skip, 0)
        differ = np.where(zero, differ << np.uint64(8 * skip), differ)
    return out


def merged(words: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of sorted runs in one order, and the bytes that each has in common with the row before.

    run tells which sorted run a row is of; the rows of a run stand in order. Each round splits the blocks
    of rows that agree so far by their next word; only blocks of several rows take part.
    """
    n, rounds = words.shape
    order = np.argsort(run, kind="stable")
    block = np.zeros(n, np.int64)
    common = np.full(n, rounds * 8, np.int64)
    if n:
        common[0] = 0
    live = np.arange(n)
    for r in range(rounds):
        if not len(live):
            break
        word, own = words[order[live], r], block[live]
        # within a block the rows of each run are sorted by this word, so a stable sort only interleaves runs
        again = np.lexsort((word, own))
        order[live] = order[live][again]
        word = word[again]
        split = np.flatnonzero((own[1:] == own[:-1]) & (word[1:] != word[:-1])) + 1
        common[live[split]] = 8 * r + common_bytes(word[split - 1], word[split])
        new = np.zeros(len(live), bool)
        new[:1] = True
        new[1:] = own[1:] != own[:-1]
        new[split] = True
        block[live] = np.cumsum(new)
        several = ~(new & np.append(new[1:], True))
        live = live[several]
    return order, common


def extents(right: np.ndarray, left: np.ndarray, room_right: np.ndarray, room_left: np.ndarray, copies: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the furthest byte to the left and to the right of its anchor that a repeated string reaches; -1 where none is.

    right, left: bytes from the anchor on, and before it backward; room: how many of them there are;
    copies: places that the row stands for; run: the shard of the row.
    """
    n = len(right)
    far_left, far_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return far_left, far_right
    order, common = merged(words_of(right), run)
    # runs are sorted by what follows the anchor; by what precedes it every row is a run of its own
    order_left, common_left = merged(words_of(left), np.zeros(n, np.int64))
    many = copies > 1
    for o in range(WIDTH + 1):
        to = LENGTH - o
        fit = (room_left >= o) & (room_right >= to)
        if not fit.any():
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[order] = np.cumsum(common < to)
        b[order_left] = np.cumsum(common_left < o)
        rows = np.flatnonzero(fit)
        key = a[rows] * (n + 1) + b[rows]
        ranked = np.argsort(key, kind="stable")
        same = key[ranked][1:] == key[ranked][:-1]
        twice = np.zeros(len(rows), bool)
        twice[ranked[1:]] |= same
        twice[ranked[:-1]] |= same
        hit = rows[twice | many[rows]]
        far_left[hit] = o  # grows with o
        far_right[hit] = np.maximum(far_right[hit], to)
    return far_left, far_right


def row_id(key: str, text: str) -> Column:
    """16 bytes that tell rows apart by key and text; equal for repeated rows only. Null texts count as empty ones."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.md5(F.col(key).cast("string")), F.lit("-")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))))


def squeezed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, key, _text): row ids, keys, and texts as compressed bytes."""
    one = df.select(row_id(key, text).alias("_row"), F.col(text).cast("string").alias("_text"), F.col(key).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [compress(x.as_py().encode("utf-8", "surrogatepass")) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], names=["_row", "_text", "_key"])

    return one.mapInArrow(run, f"_row binary, _text binary, _key {df.schema[key].dataType.simpleString()}")


def found_anchors(one: DataFrame) -> DataFrame:
    """(gram, _row, at): the anchors of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            at, grams, size = [], [], []
            for x in texts:
                a, g = anchors(np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8))
                at.append(a), grams.append(g), size.append(len(a))
            rows = part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), size)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), rows, pa.array(np.concatenate(at).astype(np.int32))], names=["gram", "_row", "at"])

    return one.mapInArrow(run, "gram bigint, _row binary, at int")


def met_again(every: DataFrame, heavy: int) -> DataFrame:
    """(gram, _row, at, n): anchors that may stand anywhere else, and rows without `_row` that count one.

    Rows come sorted in ranges of anchors, of which a common one takes several, so that no task gets more
    than its part of it. An anchor met once within its range goes, unless it is at an end of the range and
    may stand in the next one too. Counts come for anchors at both ends and for those of more than `heavy`
    places: added up they are those of all anchors of more than `heavy` places.
    """
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartitionByRange(n, "gram", "_row", "at").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "_row", "at", "n"]
        rows = lambda part: pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64())], names=names)
        # the anchor at hand, its places so far, its only row if there was one, and whether it is the range's first
        open_, count, held, first = None, 0, None, True

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([count], pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(begin, len(gram)))
            if open_ is not None:
                goes_on = gram[0] == open_
                if not goes_on and (first or count > heavy):
                    yield told()
                if held is not None and (goes_on or first):
                    yield rows(held)
                    held = None
                if goes_on:
                    total = size.copy()
                    total[0] += count
                else:
                    total, first, held = size, False, None
            else:
                total = size
            keep = total > 1
            if first and len(total) > 1:  # the first anchor ends here
                keep[0] = True
                open_, count = int(gram[0]), int(total[0])
                yield told()
                first = False
            for i in np.flatnonzero(total[:-1] > heavy).tolist():
                if i or not (open_ == int(gram[0]) and count == int(total[0])):
                    open_, count = int(gram[begin[i]]), int(total[i])
                    yield told()
            open_, count = int(gram[-1]), int(total[-1])
            if count == 1:
                held = batch.slice(len(gram) - 1)
            yield rows(batch.filter(pa.array(np.repeat(keep, size))))
        if open_ is not None:
            if held is not None:
                yield rows(held)
            yield told()

    return dealt.mapInArrow(run, "gram bigint, _row binary, at int, n bigint")


PLACES = pa.list_(pa.struct([("row", pa.binary()), ("at", pa.int32())]))


RUNS = "gram bigint, shard bigint, right binary, left binary, copies bigint, places array<struct<row: binary, at: int>>"


def contexts(part: list[tuple[bytes, bytes, int, list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a shard, contexts alike on both sides as one. part: (row, bytes of the text, times, anchors as place and hash)."""
    found: dict[tuple[bytes, bytes], list] = {}
    for name, data, times, own in part:
        for at, gram in own:
            entry = found.setdefault((data[at : at + LENGTH], data[max(0, at - WIDTH) : at][::-1]), [gram, 0, []])
            entry[1] += times
            entry[2].append({"row": name, "at": at})
    order = sorted(found)
    shard = int.from_bytes(hashlib.blake2b(part[0][0], digest_size=7).digest(), "big") if part else 0
    for i in range(0, len(order), 4096):
        some = order[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([found[k][0] for k in some], pa.int64()), pa.array([shard] * len(some), pa.int64()), pa.array([k[0] for k in some], pa.binary()), pa.array([k[1] for k in some], pa.binary()), pa.array([found[k][1] for k in some], pa.int64()), pa.array([found[k][2] for k in some], PLACES)], names=["gram", "shard", "right", "left", "copies", "places"])


def in_shards(rows: Iterator[tuple[bytes, bytes, int, list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if len(held) >= SHARD or size >= SHARD_BYTES:
            yield from contexts(held)
            held, size = [], 0
    yield from contexts(held)


def shard_runs(rows: DataFrame) -> DataFrame:
    """(gram, shard, right, left, copies, places): the rows of each shard. rows: (_row, compressed _text, times, grams array<struct<at, gram>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        yield from in_shards((name.as_py(), expand(x.as_py()), times.as_py(), [(a["at"], a["gram"]) for a in own.as_py()]) for b in batches for name, x, times, own in zip(*b.columns))

    return rows.mapInArrow(run, RUNS)


def common_runs(one: DataFrame, common: list[int]) -> DataFrame:
    """As shard_runs(), of some anchors alone, from the texts where they are: nothing is shuffled. one: (_row, _text)."""
    wanted = one.sparkSession.sparkContext.broadcast(np.array(sorted(common), np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, bytes, int, list[tuple[int, int]]]]:
            for part, texts in chunks(batches):
                for name, x in zip(part.column(0), texts):
                    data = x.encode("utf-8", "surrogatepass")
                    at, grams = anchors(np.frombuffer(data, np.uint8))
                    hit = np.isin(grams, wanted.value)
                    if hit.any():
                        yield name.as_py(), data, 1, list(zip(at[hit].tolist(), grams[hit].view(np.int64).tolist()))

        yield from in_shards(rows())

    return one.mapInArrow(run, RUNS)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, filled up with zeros, and their sizes."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(len(data), width), np.array([len(x) for x in data], np.int64)


def repeated(runs: DataFrame) -> DataFrame:
    """(_row, begin, end): spans of repeated strings, from rows that are dealt out by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            right, room_right = matrix(whole["right"], LENGTH)
            left, room_left = matrix(whole["left"], WIDTH)
            far_left, far_right = extents(right, left, room_right, room_left, whole["copies"].to_numpy(), whole["shard"].to_numpy())
            hit = np.flatnonzero(far_left >= 0)
            places = whole["places"].take(pa.array(hit)).combine_chunks()
            size = np.diff(places.offsets.to_numpy())
            flat = places.flatten()
            at = flat.field("at").to_numpy().astype(np.int64)
            return pa.RecordBatch.from_arrays([flat.field("row"), pa.array((at - np.repeat(far_left[hit], size)).astype(np.int32)), pa.array((at + np.repeat(far_right[hit], size)).astype(np.int32))], names=["_row", "begin", "end"])

        # rows come by anchor: work on groups of whole anchors of some size
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            gram = batch.column(0).to_numpy()
            if count + batch.num_rows >= 16384:
                last = np.flatnonzero(gram != gram[-1])
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut == 0 and held and held[-1].column(0)[-1].as_py() != gram[-1]:
                    yield spans(held)
                    held, count = [], 0
                elif cut:
                    yield spans([*held, batch.slice(0, cut)])
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield spans(held)

    return runs.mapInArrow(run, "_row binary, begin int, end int")


#: Strings of so many neighbouring places before the anchor are looked at together first.
SPAN = 39


def digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def room(right: bytes, left: bytes) -> tuple[int, int]:
    """The fewest and the most bytes before the anchor that a string of LENGTH bytes around it can have."""
    return max(0, LENGTH - len(right)), len(left)


def spans_of(right: bytes, left: bytes) -> Iterator[tuple[int, bytes]]:
    """What all strings of a span have in common, and so any two rows that share one of them: (span, digest)."""
    low, high = room(right, left)
    for j in range(low // SPAN, high // SPAN + 1):
        yield j, digest(bytes([j]) + left[: SPAN * j] + right[: LENGTH - SPAN * (j + 1) + 1])


def strings_of(right: bytes, left: bytes, spans: list[int]) -> Iterator[tuple[int, bytes]]:
    """(bytes before the anchor, digest) of each string of LENGTH bytes in some spans. left is read backward."""
    whole, (low, high) = left[::-1] + right, room(right, left)
    for j in spans:
        for o in range(max(low, SPAN * j), min(high, SPAN * (j + 1) - 1) + 1):
            yield o, digest(whole[high - o : high - o + LENGTH])


def keyed(runs: DataFrame, of: Callable[..., Iterator[tuple[int, bytes]]], *more: str) -> DataFrame:
    """(_id, o, digest, copies) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            out = [(name, o, d, n) for name, n, *row in zip(*(c.to_pylist() for c in part.columns)) for o, d in of(*row)]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["_id", "o", "digest", "copies"])

    return runs.select("_id", "copies", "right", "left", *more).mapInArrow(run, "_id bigint, o int, digest binary, copies bigint")


def met_twice(keys: DataFrame) -> DataFrame:
    """The rows of keys whose digest stands for more than one place."""
    twice = stored(keys.groupBy("digest", "o").agg(F.sum("copies").alias("n")).where("n > 1").select("digest", "o"))
    return keys.join(twice, ["digest", "o"])


def counted(runs: DataFrame) -> DataFrame:
    """(_row, begin, end), as repeated() finds them, for anchors of any number of places: only digests meet, and counts of them."""
    own = stored(runs.withColumn("_id", F.monotonically_increasing_id()))
    live = stored(met_twice(keyed(own, spans_of)).groupBy("_id").agg(F.sort_array(F.collect_list("o")).alias("spans")))
    far = met_twice(keyed(own.join(live, "_id"), strings_of, "spans")).groupBy("_id").agg(F.max("o").alias("_left"), (LENGTH - F.min("o")).alias("_right"))
    place = own.join(far, "_id").select("_left", "_right", F.explode("places").alias("p"))
    return place.select(F.col("p.row").alias("_row"), (F.col("p.at") - F.col("_left")).alias("begin"), (F.col("p.at") + F.col("_right")).alias("end"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(_row, spans): of each row id with repeated strings their spans in bytes, unmerged."""
    one = df.select(row_id(key, text).alias("_row"), F.col(text).cast("string").alias("_text"))
    # rows repeated as a whole have one row id: their anchors count as often as they stand there
    every = stored(found_anchors(one))
    met = stored(met_again(every, heavy))
    removed_path(every)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most two anchors a range, and those of more than `heavy` places
    common = [r.gram for r in met.where("n IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > heavy).collect()]
    own = met.where("_row IS NOT NULL")
    if common:
        many = df.sparkSession.createDataFrame([(g,) for g in common], "gram bigint")
        own = own.join(F.broadcast(many), "gram", "left_anti")
    # dealt out by row before it is added up
    own = own.repartition(n, "_row").groupBy("_row", "at", "gram").agg(F.count("*").alias("times"))
    grams = own.groupBy("_row").agg(F.max("times").alias("times"), F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("grams"))
    rows = squeezed(df, key, text).drop("_key").join(grams, "_row").groupBy("_row").agg(F.first("_text").alias("_text"), F.first("times").alias("times"), F.first("grams").alias("grams"))
    runs = shard_runs(rows.select("_row", "_text", "times", "grams"))
    found = repeated(runs.repartition(n, "gram").sortWithinPartitions("gram", "shard", "right"))
    if common:
        found = found.unionByName(counted(common_runs(one, common)))
    return found.groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, compressed _text, spans) of all rows."""
    return squeezed(df, key, text).join(find(df, key, text), "_row", "left").select("_key", "_text", "spans")


def removed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, spans): each text with the runs of bytes to remove, as they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in (batch.slice(i, SHARD) for i in range(0, batch.num_rows, SHARD)):
                texts = [None if x is None else expand(x).decode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(2)], names=[key, text, "spans"])

    return with_spans(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string, spans array<struct<begin: int, end: int>>")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats): sizes in bytes; has_repeats tells whether any byte goes."""
    found = with_spans(table(spark, sf_dir, "documents"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for x, spans in zip(batch.column(1), batch.column(2)):
                data = expand(x.as_py()) if x.is_valid else b""
                cuts = union([(s["begin"], s["end"]) for s in spans.as_py() or []])
                kept = [data[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)])]
                out.append((len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(b"".join(kept)).hexdigest(), bool(cuts)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"])

    return found.mapInArrow(run, f"doc_id {found.schema['_key'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, has_repeats boolean")
