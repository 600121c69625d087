"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

A text is a weighted set: its shingles of five words, each weighted by how often it stands there. Darts
are thrown, the same for all texts, into the plane of (weight, rank) of every shingle, cell by cell from
low ranks up; a text keeps those that fall below its weights. A dart also names one of the coordinates
of the signature; the dart of least rank of each coordinate is its value, so that two values agree with
the probability of the weighted Jaccard similarity. A text needs ranks only up to about
(k ln k + 2k) / total weight, so that long texts throw as few darts as short ones; where a coordinate
stays empty, ranks twice as high are taken.

Texts of the same words are one node. Bands of signature values put nodes into buckets. In each bucket
the most central node (the one whose buckets are the fullest) is held against the others: a star, not
all pairs. Pairs are checked exactly, by both texts, and links of the threshold or more are joined into
components. Buckets that hold several components after that are dealt out in cells of bounded size; a cell
counts the common shingles of all its nodes as products of matrices, so that every pair in it is checked
exactly, and only what ties components together leaves it. Nothing is estimated there: two texts at a
similarity of 0.8 are missed only where they share no bucket, about three times in a million.

Edge cases: texts of one to four words are one shingle; null and empty texts, and texts without words,
are alike only where they are the same text (null counts as empty); repeated rows are copies; keys may
be null or repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CHUNK, chunks, mapped, packed, stored, table, unpacked
from tidemark.llm.decontamination import SYMBOLS, words_sql
from tidemark.llm.quality import hashed, mixed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Values of a signature.
COORDINATES = BANDS * ROWS
#: Darts that a text throws at first.
DARTS = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
LOWEST = 2.0**-6
#: Code points that a short text counts as: it throws as many darts as a long one.
SHORT = 1024
SALT = np.uint64(0xD1B54A32D192ED03)


def digest_of(text: str) -> bytes:
    """Tells texts apart by their words, those without words by themselves."""
    words = text.encode("utf-8", "surrogatepass").translate(SYMBOLS).split()
    return hashlib.md5(b" ".join(words) if words else b"\0" + text.encode("utf-8", "surrogatepass")).digest()


class Shingled:
    """The weighted shingles of some texts."""

    def __init__(self, texts: list[str]):
        parts = [x.encode("utf-8", "surrogatepass").translate(SYMBOLS) for x in texts]
        data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        size = np.array([len(x) + 1 for x in parts], np.int64)
        begin = np.cumsum(size) - size
        full = data != 32
        starts = np.flatnonzero(full & np.concatenate([[True], ~full[:-1]]))
        stops = np.flatnonzero(~full & np.concatenate([[False], full[:-1]]))
        words = hashed(data, starts, stops)
        cut = np.searchsorted(starts, np.append(begin, len(data)))
        self.n_words = np.diff(cut)
        # a text of fewer words than a shingle has one shingle
        count = np.where(self.n_words > 0, np.maximum(self.n_words - SHINGLE + 1, 1), 0)
        doc = np.repeat(np.arange(len(texts)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + cut[:-1][doc]
        last = cut[1:][doc]
        total = np.zeros(len(doc), np.uint64)
        padded = np.append(words, np.zeros(1, np.uint64))
        for j in range(SHINGLE):
            word = np.where(at + j < last, padded[np.minimum(at + j, len(words))], np.uint64(0))
            total = mixed(total * SALT + word + np.uint64(j + 1))
        order = np.lexsort((total, doc))
        doc, total = doc[order], total[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])])[: len(doc)]
        first = np.flatnonzero(new)
        self.doc, self.shingle = doc[first], total[first]
        self.weight = np.diff(np.append(first, len(doc)))


@functools.cache
def poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ..., up to all but nothing."""
    terms, p, n = [], math.exp(-mean), 0
    while n < mean + 12 * math.sqrt(mean) + 20:
        terms.append(p)
        n += 1
        p *= mean / n
    return np.cumsum(terms)


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """A row of k values for each of n weighted sets; weights are positive, zeros for an empty set."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    strips = np.ceil(weight).astype(np.int64)
    unit = np.repeat(np.arange(len(doc)), strips)
    strip = np.arange(len(unit)) - np.repeat(np.cumsum(strips) - strips, strips)
    limit = np.minimum(np.asarray(weight, np.float64)[unit] - strip, 1.0)
    owner, name = doc[unit], mixed(element[unit] + strip.astype(np.uint64) * SALT)
    high = np.where(total > 0, DARTS / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        who, own, part, top = owner[mine], name[mine], limit[mine], high[owner[mine]]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, width, cell = 0.0, LOWEST, 0
        while len(who):
            seed = mixed(own + np.uint64((cell + 1) * 0xA24BAED4963EE407 % 2**64))
            count = np.searchsorted(poisson(width), uniform(seed), side="right")
            some = np.flatnonzero(count)
            count = count[some]
            dart = np.repeat(some, count)
            order = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            key = mixed(seed[dart] + (order + 1).astype(np.uint64) * SALT)
            rank = low + width * uniform(mixed(key ^ SALT))
            inside = (rank < top[dart]) & (uniform(mixed(key + SALT)) < part[dart])
            dart, key, rank = dart[inside], key[inside], rank[inside]
            found.append((who[dart] * k + (mixed(key * SALT + np.uint64(7)) % np.uint64(k)).astype(np.int64), rank, key))
            low += width
            width = low
            cell += 1
            more = top > low
            who, own, part, top = who[more], own[more], part[more], top[more]
        place, rank, key = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((key, rank, place))
        place, key = place[order], key[order]
        first = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
        full = np.zeros((n, k), bool)
        full.ravel()[place[first]] = True
        done = todo & full.all(axis=1)
        chosen = place[first][done[place[first] // k]]
        out.ravel()[chosen] = key[first][done[place[first] // k]]
        todo &= ~done
        high[todo] *= 2
    return out


def bands(rows: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * SALT, (len(rows), 1))
    for r in range(ROWS):
        out = mixed(out * SALT + rows[:, r : BANDS * ROWS : ROWS])
    return out.view(np.int64)


def sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, bands): of each row its node and band hashes."""
    one = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, most=CHUNK // 2, least=SHORT):
            own = Shingled(texts)
            rows = signatures(own.doc, own.shingle, own.weight, len(texts))
            some = own.n_words > 0
            hashes = pa.array([b if s else None for b, s in zip(bands(rows), some)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([digest_of(x) for x in texts], pa.binary()), hashes], names=[key, "digest", "bands"])

    return one.transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, digest binary, bands array<bigint>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def pair_chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, dict[bytes, str]]]:
    """Slices of batches of (a, b, text of a, text of b) whose different texts have about `most` code points (more if a pair is longer), with these texts by digest."""
    for batch in batches:
        names: dict[bytes, str] = {}
        begin = total = 0
        for i, (a, b, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            new = {d: t for d, t in ((a, x), (b, y)) if d not in names}
            if total and total + sum(map(len, new.values())) > most:
                yield batch.slice(begin, i - begin), names
                names, begin, total, new = {}, i, 0, {a: x, b: y}
            names |= new
            total += sum(map(len, new.values()))
        if begin < batch.num_rows:
            yield batch.slice(begin), names


def checked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those (a, b) of the pairs whose texts are similar enough. texts: (digest, text)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    own = stored(texts.join(wanted, "digest", "left_semi"))
    both = pairs.join(own.select(F.col("digest").alias("a"), F.col("text").alias("_a")), "a").join(own.select(F.col("digest").alias("b"), F.col("text").alias("_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names in pair_chunks(batches):
            shingled = Shingled(list(names.values()))
            cut = np.searchsorted(shingled.doc, np.arange(len(names) + 1))
            sets = {d: (shingled.shingle[x:y], shingled.weight[x:y]) for d, x, y in zip(names, cut[:-1], cut[1:])}
            keep = [similarity(sets[a], sets[b]) >= least for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "_a", "_b").transform(mapped, run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(digest, label): of each linked node the least node that links lead to, by least labels of neighbours and a jump to the label's own label each round."""
    both = stored(links.select("a", "b").unionAll(links.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("digest")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("digest").alias("b"), "label"), "b").groupBy(F.col("a").alias("digest")).agg(F.min("label").alias("near"))
        next_ = labels.join(near, "digest").select("digest", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = next_.select(F.col("digest").alias("new"), F.col("new").alias("jump"))
        moved = stored(next_.join(jump, "new", "left").select("digest", F.coalesce("jump", "new").alias("label"), (F.coalesce("jump", "new") != F.col("old")).alias("moved")))
        labels = moved.select("digest", "label")
        if moved.where("moved").isEmpty():
            return labels


#: Nodes, and shingles of them, that a block holds; a cell has two blocks.
CELL, CELL_SHINGLES = 1024, 1 << 20
#: Entries of a matrix of nodes and shingles.
ENTRIES = 1 << 22


def elements(texts: DataFrame) -> DataFrame:
    """(digest, elements): the shingles of each text, the second of a kind told from the first and so on, so that weights become sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in chunks(batches, most=CHUNK // 2):
            found = Shingled(own)
            copy = np.arange(int(found.weight.sum())) - np.repeat(np.cumsum(found.weight) - found.weight, found.weight)
            names = mixed(np.repeat(found.shingle, found.weight) + copy.astype(np.uint64) * SALT).view(np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(found.doc, weights=found.weight, minlength=len(own)).astype(np.int64))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(names))], names=["digest", "elements"])

    return texts.select("digest", "text").transform(mapped, run, "digest binary, elements array<bigint>")


def similar(flat: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Of sets, one behind the other in flat, which pairs have a Jaccard similarity of `least` or more."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    ranked, owner = flat[order], owner[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    alone = new & np.append(new[1:], True)
    column = np.cumsum(new & ~alone)[~alone] - 1  # elements of one set only add nothing
    owner = owner[~alone]
    both = np.zeros((n, n), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    step = max(1, min(n_columns, ENTRIES // max(n, 1)))
    cuts = np.searchsorted(column, np.arange(0, n_columns + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows, at = np.unique(owner[a:b], return_inverse=True)
        part = np.zeros((len(rows), step), np.float32)
        part[at, column[a:b] - k * step] = 1
        if len(rows) == n:
            both += part @ part.T
        else:
            both[np.ix_(rows, rows)] += part @ part.T
    linked = np.empty((n, n), bool)
    for a in range(0, n, 256):
        own = both[a : a + 256].astype(np.float64)
        linked[a : a + 256] = own / (sizes[a : a + 256, None] + sizes - own) >= least
    np.fill_diagonal(linked, True)
    return linked


def ties(label: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Of each node a node that links lead to from its component: the same one for all that hang together."""
    n_labels = int(label.max()) + 1
    i, j = np.nonzero(linked)
    root = np.arange(n_labels)
    if len(i):
        a, b = np.unique(np.sort(np.stack([label[i], label[j]]), axis=0), axis=1)
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, before[a], least)
            np.minimum.at(root, before[b], least)
            root = root[root]
            if (root == before).all():
                break
    first = np.full(n_labels, len(label))
    np.minimum.at(first, label, np.arange(len(label)))
    return first[root[label]]


def open_links(own: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): nodes of different components in a bucket that links lead to from one another.

    own: (bucket, digest, label). A bucket is dealt out in cells of two blocks of nodes, so that none of
    its size comes to one task; a cell gives no more rows than it has nodes.
    """
    sets = stored(elements(texts.join(own.select("digest").distinct(), "digest", "left_semi")))
    own = own.join(sets.select("digest", F.size("elements").alias("_size")), "digest")
    sizes = stored(own.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("_size") / CELL_SHINGLES)).cast("int").alias("_n")))
    block = F.pmod(F.xxhash64("digest", "bucket"), F.col("_n")).cast("int")
    own = own.drop("_size").join(sizes, "bucket").withColumn("_block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = own.select("bucket", F.least("_block", "_o").alias("_i"), F.greatest("_block", "_o").alias("_j"), "digest", "label")
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.join(sets, "digest").select("bucket", "_i", "_j", "digest", "label", "elements").repartition(n, "bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cells: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = cells.combine_chunks()
            keys = np.stack([cells[c].to_numpy() for c in ("bucket", "_i", "_j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), cells.num_rows]
            sets = cells["elements"].combine_chunks()
            places, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            label = np.unique(np.array(cells["label"].to_pylist(), object), return_inverse=True)[1] if cells.num_rows else np.zeros(0)
            left, right = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1 and (label[a:b] != label[a]).any():
                    names = np.unique(label[a:b], return_inverse=True)[1]
                    to = ties(names, similar(flat[places[a] : places[b]], np.diff(places[a : b + 1]), least))
                    some = np.flatnonzero(label[a:b] != label[a:b][to])
                    left.append(some + a)
                    right.append(to[some] + a)
            if left:
                digest = cells["digest"].combine_chunks()
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["a", "b"])

        # whole cells at a time: what may go on in the next batch is held
        held: list[pa.RecordBatch] = []
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            other = np.flatnonzero((keys != np.array(last)[:, None]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or [held[-1].column(i)[0].as_py() for i in range(3)] != last):
                yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from found(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    return dealt.transform(mapped, run, "a binary, b binary").distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, digest, label): of each row its node, and the least node of its class.

    What is joined by bucket or label is stored before, so that both sides are plain shuffles, and the
    optimiser can split a bucket or class that holds a large part of all rows.
    """
    rows = stored(sketched(df, key, text))
    member = rows.where("bands IS NOT NULL").groupBy("digest").agg(F.first("bands").alias("bands")).select("digest", F.explode("bands").alias("bucket"))
    shared = stored(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    member = stored(member.join(shared, "bucket"))
    degree = member.groupBy("digest").agg(F.sum("size").alias("degree"))
    member = stored(member.drop("size").join(degree, "digest"))
    # one text for each node that a pair may need
    texts = texts_by_digest(df, member.select("digest").distinct(), text)

    leader = stored(member.groupBy("bucket").agg(F.max(F.struct("degree", "digest")).alias("leader")).select("bucket", F.col("leader.digest").alias("leader")))
    links = stored(checked(ordered_pairs(member.join(leader, "bucket"), "leader", "digest"), texts, least))
    labels = components(links)
    # buckets that hold several components
    own = stored(member.join(labels, "digest", "left").select("bucket", "digest", F.coalesce("label", "digest").alias("label")))
    open_ = stored(own.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("bucket"))
    if not open_.isEmpty():
        more = stored(open_links(stored(own.join(open_, "bucket")), texts, least))
        if not more.isEmpty():
            labels = components(links.unionAll(more))
    return rows.select(key, "digest").join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def ordered_pairs(df: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct pairs (a, b), a before b."""
    return stored(df.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct())


def texts_by_digest(df: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(digest, text): one text for each wanted node. A task passes each text on once, so that copies don't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, texts in chunks(batches, text=0):
            new = {}
            for i, x in enumerate(texts):
                if (d := digest_of(x)) not in seen:
                    new[d] = i
                    seen.add(d)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), part.column(0).take(pa.array(list(new.values()), pa.int32()))], names=["digest", "text"])

    every = df.select(F.col(text).cast("string").alias("_text")).transform(mapped, run, "digest binary, text string")
    return stored(every.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, class_size, is_first): class_id is the least doc_id of the class."""
    found = stored(classes(table(spark, sf_dir, "documents")))
    sizes = stored(found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return found.join(sizes, "label").select("doc_id", "class_id", "class_size", F.equal_null("doc_id", "class_id").alias("is_first"))


def first_of_classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """df with one row of each class: of its rows of the least key (null before all) one of the least text."""
    whole = packed(df, key, text)
    found = classes(whole, "_key", "_text", least)
    kept = found.groupBy("label").agg(F.min(F.struct("_key", "digest")).alias("kept")).select(F.col("kept._key").alias("_first"), F.hex("kept.digest").alias("_of"))

    @F.pandas_udf("string")
    def named(texts):
        return texts.map(lambda x: digest_of(x or "").hex().upper())

    own = whole.withColumn("_digest", named(F.col("_text").cast("string")))
    one = own.join(kept, (F.col("_digest") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_first")), "left_semi")
    place = F.row_number().over(Window.partitionBy("_key", "_digest").orderBy(F.col("_text").asc_nulls_first()))
    return unpacked(one.withColumn("_place", place).where("_place = 1"), df, text)


def sql() -> str:
    """All pairs that share a shingle, and all that links lead to: for small tables."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, {words_sql('text')} AS w FROM documents),
    s AS (SELECT doc_id, shingle, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS shingle FROM w) GROUP BY ALL),
    n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS m FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m / (x.n + y.n - m)::DOUBLE >= {SIMILARITY} UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id WHERE len(x.w) = 0),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size, x = min(y) AS is_first FROM r GROUP BY x"""
