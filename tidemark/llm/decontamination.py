"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of whole documents. Its words become symbols: 1.. for words that the benchmark knows,
0 for any other word and for the end of a document; of zeros in a row one is kept, as no phrase holds
a 0. Suffixes are sorted by prefix doubling, every 0 being a terminator of its own, in order of place.
All phrases are searched backward at the same time through the ranks of a wavelet matrix of the
transform; occurrences are located by walking to sampled suffix positions; the word spans that they
cover are merged.

A phrase is `window` consecutive words of an item; an item of fewer words, but not none, is one phrase.
Words: A-Z lower-cased, then runs of anything but ASCII other than digits and letters.

Edge cases: null or empty texts have no words and no hits; items that are null or have no words are
never found; repeated item_ids and texts are kept apart as rows of the benchmark but reported once by
id; a null item_id is reported as the string "null"; empty tables give empty or unhit results; other
columns are ignored; a text of any length is one document of one shard.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, mapped, table

WINDOW = 13
#: Code points of a shard (more if one text is longer).
SHARD = 4 << 20
#: UTF-8 bytes of benchmark texts that one pass broadcasts; a larger benchmark takes several passes over the same partitions.
BLOCK = 16 << 20
#: One in so many suffix positions is kept.
SAMPLE = 8
#: Every byte that is no part of a word becomes a space, A-Z become a-z.
SYMBOLS = bytes(c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(SYMBOLS).split()


class Phrases:
    """The distinct phrases of some items, as symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(name)
        self.items = [sorted(x) for x in found.values()]
        self.sizes = np.array([len(x) for x in found], np.int64)
        # right-aligned, so that column j is the symbol that the j-th backward step takes
        self.backward = np.zeros((len(found), max(self.sizes, default=0)), np.int64)
        for i, x in enumerate(found):
            self.backward[i, : len(x)] = x[::-1]


def suffix_rows(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes; every 0 ends its suffixes and is smaller than what stands later."""
    n, per = len(symbols), 63 // bits
    at = np.flatnonzero(symbols)
    # how many symbols up to the next 0
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, at)] - at
    key = np.zeros(len(at), np.int64)
    padded = np.concatenate([symbols, np.zeros(per, symbols.dtype)]).astype(np.int64)
    for j in range(per):
        key = (key << bits) | np.where(left > j, padded[at + np.minimum(j, left)], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.zeros(n, np.int64)  # by position: where the group of its suffix begins; 0 for terminators
    length = per
    while True:
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[at[order]] = begin + 1
        # groups of several suffixes that go on are sorted by what follows; those that have ended stand in order of place
        several = ~(new & np.append(new[1:], True))
        todo = np.flatnonzero(several & (left[order] >= length))
        if not len(todo):
            break
        who = order[todo]
        after = rank[at[who] + length]
        again = np.lexsort((after, begin[todo]))
        order[todo] = who[again]
        # a tie of two that end right there is settled by place, which the stable sort keeps
        after, group = after[again], begin[todo]
        new[todo[1:]] |= (group[1:] == group[:-1]) & (after[1:] != after[:-1])
        length *= 2
    return np.concatenate([ends, at[order]])


class FMIndex:
    def __init__(self, symbols: np.ndarray, bits: int):
        """symbols: of the shard, ending with 0; each below 2 ** bits."""
        rows = suffix_rows(symbols, bits)
        n = len(symbols)
        last = symbols[rows - 1].astype(np.int64)  # the transform; row of position 0 gets the final 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << bits) + 1))])
        self.bits = bits
        self.ones: list[np.ndarray] = []  # the wavelet matrix: at each level, ones before each place
        self.zeros: list[int] = []
        level = last
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.last = last
        sampled = (rows % SAMPLE == 0) | (symbols[rows] == 0) | (last == 0)
        self.sampled, self.place = sampled, np.where(sampled, rows, -1)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol occurs in the transform before the row."""
        begin, end = np.zeros_like(row), row
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = (symbol >> b) & 1
            one_begin, one_end = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin = np.where(bit == 1, zeros + one_begin, begin - one_begin)
            end = np.where(bit == 1, zeros + one_end, end - one_end)
        return end - begin

    def search(self, backward: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, from and to, of each phrase."""
        low = np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), len(self.last), np.int64)
        for j in range(backward.shape[1]):
            live = np.flatnonzero((sizes > j) & (high > low))
            if not len(live):
                break
            symbol = backward[live, j]
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.first[symbol] + both[: len(live)]
            high[live] = self.first[symbol] + both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position of each row: walk left until one is sampled."""
        row, out = row.copy(), np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        steps = 0
        while len(todo):
            here = row[todo]
            done = self.sampled[here]
            out[todo[done]] = self.place[here[done]] + steps
            todo, here = todo[~done], here[~done]
            row[todo] = self.first[self.last[here]] + self.rank(self.last[here], here)
            steps += 1
        return out


def hits(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(position, phrase) of all occurrences in the symbols of a shard."""
    none = np.zeros(0, np.int64)
    if not len(phrases.items):
        return none, none
    # runs of known words, each with one 0 behind
    known = np.concatenate([[False], symbols > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return none, none
    size = end - begin + 1
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(start - begin, size)
    text = np.where(np.arange(len(at)) == np.repeat(start + size - 1, size), 0, symbols[np.minimum(at, len(symbols) - 1)])
    index = FMIndex(text, max(1, len(phrases.vocabulary).bit_length()))
    low, high = index.search(phrases.backward, phrases.sizes)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    return at[index.locate(rows)], which


def merged(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Spans joined where they touch or overlap: start, end, start, end, ..."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return np.stack([begin[new], end[last]], axis=1).ravel().tolist()


def searched(texts: list[str], phrases: Phrases) -> Iterator[tuple[int, list[int], list[str]]]:
    """Of each text of a shard: words, merged hit spans in words, names of the items found."""
    get, parts, sizes = phrases.vocabulary.get, [], []
    for x in texts:
        own = words(x)
        sizes.append(len(own))
        parts.append(np.fromiter(map(get, own, itertools.repeat(0)), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    place, which = hits(np.concatenate(parts), phrases)
    doc = np.searchsorted(bounds, place, side="right") - 1
    order = np.argsort(doc, kind="stable")
    place, which, doc = place[order], which[order], doc[order]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, n in enumerate(sizes):
        a, b = cut[i], cut[i + 1]
        if a == b:
            yield n, [], []
            continue
        begin = place[a:b] - bounds[i]
        names = {name for k in np.unique(which[a:b]).tolist() for name in phrases.items[k]}
        yield n, merged(begin, begin + phrases.sizes[which[a:b]]), sorted(names)


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block: int = BLOCK) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size: rows are dealt out by their id once their whole size is known."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == b)
        yield [(r["name"], r["text"]) for r in part.toLocalIterator()]


def search(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, text, n_words, spans array<int>, items array<string>): spans hold starts and ends of merged runs of hit words."""
    keep = [c for c in keep or [] if c not in (key, text)]
    out = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.struct(F.lit(0).alias("_none"), *keep).alias("_rest"), F.lit(0).cast("long").alias("_words"), F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema = out.schema
    for items in blocks(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for part, texts in chunks(batches, most=SHARD):
                counts, spans, names = [], [], []
                for (n, own, found), old, before in zip(searched(texts, phrases), part.column(4).to_pylist(), part.column(5).to_pylist()):
                    both = np.array([*old, *own]).reshape(-1, 2)
                    counts.append(n)
                    spans.append(merged(both[:, 0], both[:, 1]) if old and own else old or own)
                    names.append(sorted({*before, *found}))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=part.schema.names)

        out = out.transform(mapped, run, schema)
    return out.select(F.col("_key").alias(key), *(F.col(f"_rest.`{c}`").alias(c) for c in keep), F.col("_text").alias(text), F.col("_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def hit_words(spans: str = "spans"):
    """Words that the spans cover: ends less starts."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hit: str = "n_hit", total: str = "n_words"):
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(total))


def without(text: str, spans: list[int]) -> str:
    """The text less the characters of the words in the spans, and what stands between these."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated())


def words_sql(text: str) -> str:
    """SQL of words()."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sql() -> str:
    return f"""
    WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words_sql('text')} AS w FROM benchmark),
    p AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM p), d AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n),
    h AS (SELECT doc_id, i, d.n, item FROM d JOIN p ON p.n = d.n AND p.phrase = array_to_string(w[i:i + d.n - 1], ' ')),
    c AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
