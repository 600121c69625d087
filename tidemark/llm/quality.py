"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of all vote patterns in the corpus (their number is bounded by the labellers, not by the
documents) estimates how accurate each labeller is for either class, and the posterior of each pattern.
The posteriors then are the labels of a linear scorer over hashed features: words, runs of four character
classes, and binned measurements. It is fitted on a bounded sample of documents, chosen by a hash of key
and text, and scores every whole text.

Edge cases: null, empty and white-space texts have no words; all labellers that need words vote bad or
nothing on them, and they are scored like any other; repeated rows get the same score; keys may be null
or repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import CHUNK, chunks, mapped, table

#: Documents, at most about, that the scorer is fitted on.
SAMPLE = 4000
BITS = 16
#: Frequent short words of some languages.
FREQUENT = "a an and as at be by for from he in is it of on or she that the they this to was were which will with auf das dem den der des die ein eine er für ich ist mit nicht sich sie und von zu au aux dans de des du elle en est et il la le les ne par pas pour que qui sur un une al como con del el ella en es la las los más no para pero por que se su un una y".split()
SYMBOLS = "#$%&*<>=@\\^_`{|}~"
STEPS, RATE, DECAY = 150, 4.0, 1e-5
KEEP = 0.5

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Class by byte: lower case and letters beyond ASCII, upper case, digits, white space; any other stands for itself.
CLASSES = np.arange(256, dtype=np.int64)
CLASSES[97:123] = CLASSES[128:] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4
CLASSES[5:9] = 0


def powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for i, by in enumerate((STEP, BACK)):
            POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 2), by)]).cumprod(dtype=np.uint64)
    return POWERS


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice of bytes, the same wherever it stands."""
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * up[: len(data)], dtype=np.uint64)])
    out = (total[end] - total[begin]) * down[begin]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _frequent() -> np.ndarray:
    data = [w.encode() for w in sorted(set(FREQUENT))]
    ends = np.cumsum([len(w) for w in data])
    return np.sort(hashed(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1]), ends))


FREQUENT_HASHES = _frequent()


class Measured:
    """Words, character classes and measurements of some whole texts."""

    def __init__(self, texts: list[str]):
        parts = [x.encode("utf-8", "surrogatepass") for x in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        size = np.array([len(x) for x in parts], np.int64)
        end = np.cumsum(size + 1) - 1
        begin = end - size
        blank = CLASSES[data] == 4
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        self.words = hashed(data, starts, stops)
        self.word_cut = np.searchsorted(starts, np.append(begin, len(data)))
        low = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint8)
        bare = stops - np.isin(data[np.maximum(stops - 1, 0)], np.frombuffer(b".,!?;:", np.uint8))
        lower = hashed(low, starts, np.maximum(bare, starts))
        n = np.diff(self.word_cut)
        doc = np.repeat(np.arange(len(texts)), n)

        def per_doc(flags: np.ndarray, cut_low: np.ndarray, cut_high: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[cut_high] - total[cut_low]

        a, b = self.word_cut[:-1], self.word_cut[1:]
        again = np.concatenate([[False], (lower[1:] == lower[:-1]) & (doc[1:] == doc[:-1])]) if len(doc) else np.zeros(0, bool)
        order = np.lexsort((lower, doc))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (lower[order][1:] != lower[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=len(texts))
        # lines, blank ones left out, and how many of them stand elsewhere in the text too
        breaks = np.flatnonzero(data == 10)
        line_begin = np.append(0, breaks[:-1] + 1)
        line = hashed(data, line_begin, breaks)
        line_doc = np.searchsorted(begin, line_begin, side="right") - 1
        full = breaks > line_begin
        line, line_doc = line[full], line_doc[full]
        order = np.lexsort((line, line_doc))
        fresh = np.ones(len(order), bool)
        if len(order):
            fresh[1:] = (line[order][1:] != line[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
        lines = np.bincount(line_doc, minlength=len(texts))
        symbols = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
        words, letters = np.maximum(n, 1), np.maximum(per_doc(np.isin(CLASSES[data], (1, 2)), begin, end), 1)
        self.measures = {
            "words": n.astype(float),
            "symbols": per_doc(symbols, begin, end) / words,
            "capitals": per_doc(CLASSES[data] == 2, begin, end) / letters,
            "exclamations": per_doc(data == 33, begin, end) / words,
            "bars": per_doc(data == 124, begin, end) / words,
            "again": per_doc(again, a, b) / words,
            "distinct": distinct / words,
            "frequent": per_doc(FREQUENT_HASHES[np.minimum(np.searchsorted(FREQUENT_HASHES, lower), len(FREQUENT_HASHES) - 1)] == lower, a, b) / words,
            "stops": per_doc(data == 46, begin, end) / words,
            "same_lines": 1 - np.bincount(line_doc[order][fresh], minlength=len(texts)) / np.maximum(lines, 1),
            "length": per_doc((data & 0xC0) != 0x80, begin, end) / words,
        }
        self.measures["same_lines"][lines == 0] = 0
        kinds = CLASSES[data]
        pads = np.concatenate([kinds, np.zeros(3, np.int64)])
        four = (((kinds << 7 | pads[1:-2]) << 7 | pads[2:-1]) << 7 | pads[3:]).astype(np.uint64)
        # only runs within one text
        self.runs = (mixed(four * STEP) >> np.uint64(64 - BITS)).astype(np.int64)
        self.run_begin, self.run_end = begin, np.maximum(begin, end - 3)

    def votes(self) -> np.ndarray:
        """1 good, -1 bad, 0 nothing; a row for each text, a column for each labeller."""
        m = self.measures
        some = m["words"] >= 5
        long = m["words"] >= 40

        def vote(good: np.ndarray, bad: np.ndarray, where: np.ndarray = some) -> np.ndarray:
            return np.where(where & bad, -1, np.where(where & good, 1, 0))

        return np.stack([
            vote(m["symbols"] < 0.03, m["symbols"] > 0.15),
            vote((m["symbols"] < 0.1) & (m["bars"] < 0.02), (m["symbols"] > 0.4) | (m["bars"] > 0.1)),
            vote(m["capitals"] < 0.1, m["capitals"] > 0.35),
            vote(m["exclamations"] < 0.02, m["exclamations"] > 0.2),
            vote(m["again"] < 0.04, m["again"] > 0.15),
            vote(m["distinct"] > 0.35, m["distinct"] < 0.2, long),
            vote(m["frequent"] > 0.1, m["frequent"] < 0.04, long),
            vote(m["same_lines"] < 0.1, m["same_lines"] > 0.3),
            vote((m["stops"] > 0.02) & (m["stops"] < 0.4), (m["stops"] < 0.004) | (m["stops"] > 0.8), long),
            np.where(m["words"] < 3, -1, 0),
        ], axis=1)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text its feature numbers, in three ranges of 2 ** BITS, and their values."""
        shift = np.uint64(64 - BITS)
        words = (mixed(self.words + np.uint64(1)) >> shift).astype(np.int64)
        bins = self.binned()
        for i in range(len(bins)):
            out = []
            for base, own in ((0, words[self.word_cut[i] : self.word_cut[i + 1]]), (1 << BITS, self.runs[self.run_begin[i] : self.run_end[i]])):
                which, count = np.unique(own, return_counts=True)
                out.append((base + which, count / max(1, len(own))))
            yield np.concatenate([out[0][0], out[1][0], bins[i]]), np.concatenate([out[0][1], out[1][1], np.full(bins.shape[1], 0.25)])

    def binned(self) -> np.ndarray:
        """A number for each measurement of each text: it and its order of magnitude, hashed."""
        scaled = np.stack([np.clip(np.round(4 * np.log2(x + 1e-3)), -48, 80) for x in self.measures.values()], axis=1).astype(np.int64) + 64
        numbers = (np.arange(scaled.shape[1]) * 1024 + scaled + 1).astype(np.uint64)
        return (2 << BITS) + (mixed(numbers * STEP) >> np.uint64(64 - BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        words = weights[(mixed(self.words + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)]
        runs = weights[(1 << BITS) + self.runs]
        total = []
        for values, a, b in ((words, self.word_cut[:-1], self.word_cut[1:]), (runs, self.run_begin, self.run_end)):
            sums = np.array([math_sum(values[x:y]) for x, y in zip(a.tolist(), b.tolist())])
            total.append(sums / np.maximum(b - a, 1))
        linear = bias + total[0] + total[1] + 0.25 * weights[self.binned()].sum(axis=1)
        return 1 / (1 + np.exp(-linear))


def math_sum(x: np.ndarray) -> float:
    """Depends on the values of one text alone, not on what stands around it."""
    return float(x.sum())


def patterns(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def accuracies(pattern: np.ndarray, count: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, probability of each vote by class and labeller, share of good) by expectation-maximisation, votes taken as independent within a class.

    A labeller that says nothing is left out of the pattern's likelihood, so that short texts form no
    class of their own. It starts from the view that one bad vote outweighs two good ones; a small count
    is added to each cell, so that no probability is 0.
    """
    votes = pattern[:, None] // 3 ** np.arange(labellers) % 3
    balance = (votes == 2).sum(axis=1) - 2 * (votes == 0).sum(axis=1)
    posterior = np.clip(0.6 + 0.1 * balance, 0.05, 0.95)
    for _ in range(rounds):
        share = float((posterior * count).sum() / max(count.sum(), 1))
        share = min(max(share, 1e-3), 1 - 1e-3)
        table = np.empty((2, labellers, 3))
        for c, p in enumerate((1 - posterior, posterior)):
            for v in range(3):
                table[c, :, v] = ((votes == v) * (p * count)[:, None]).sum(axis=0) if v != 1 else 0
        table[:, :, ::2] += 1
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(np.where(table > 0, table, 1))
        odds = np.log(share / (1 - share)) + sum(log[1, j, votes[:, j]] - log[0, j, votes[:, j]] for j in range(labellers))
        new = 1 / (1 + np.exp(-odds))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, table, share


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by accelerated gradient descent over the sample."""
    weights, bias = np.zeros(3 << BITS), 0.0
    if not rows:
        return weights, bias
    which = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    seen, which = np.unique(which, return_inverse=True)
    # features weigh by how little they usually say, so that rare ones are learnt as fast as common ones
    scale = 1 / np.sqrt(np.bincount(which, weights=value**2, minlength=len(seen)) / len(rows) + 1e-4)
    scaled = value * scale[which]
    w, speed = np.zeros(len(seen)), np.zeros(len(seen))
    b = b_speed = 0.0
    step = RATE / max(1.0, np.bincount(row, weights=scaled**2).mean())
    for _ in range(STEPS):
        odds = np.bincount(row, weights=scaled * (w + 0.9 * speed)[which], minlength=len(rows)) + b + 0.9 * b_speed
        error = (labels - 1 / (1 + np.exp(-odds))) / len(rows)
        speed = 0.9 * speed + step * (np.bincount(which, weights=scaled * error[row], minlength=len(seen)) - DECAY * w)
        b_speed = 0.9 * b_speed + step * error.sum()
        w, b = w + speed, b + b_speed
    weights[seen] = w * scale
    return weights, b


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, kept columns, text, weak, score, good): posterior from the votes, score of the linear model, and whether it reaches KEEP."""
    keep = [c for c in keep or [] if c not in (key, text)]
    one = df.select(F.xxhash64(key, text).alias("_hash"), F.col(text).cast("string").alias("_text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, most=CHUNK // 2):
            yield pa.RecordBatch.from_arrays([pa.array(patterns(Measured(texts).votes()), pa.int64())], names=["pattern"])

    counted = one.transform(mapped, vote, "pattern bigint").groupBy("pattern").count().orderBy("pattern").collect()
    labellers = Measured([]).votes().shape[1]
    pattern, count = (np.array([r[i] for r in counted], np.int64) for i in range(2))
    posterior, _, _ = accuracies(pattern, count, labellers)
    total = int(count.sum())
    # the part of all hashes that leaves about as many documents as the bound
    top = min(2**63 - 1, int(2**64 * min(1.0, sample / max(total, 1))) - 2**63)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, most=CHUNK // 2):
            own = Measured(texts)
            found = list(own.features())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(patterns(own.votes()), pa.int64()), pa.array([w.astype(np.int32) for w, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["_hash", "pattern", "which", "value"])

    drawn = one.where(F.col("_hash") <= top).dropDuplicates(["_hash"]).transform(mapped, featured, "_hash bigint, pattern bigint, which array<int>, value array<float>").toArrow().sort_by("_hash")
    labels = posterior[np.searchsorted(pattern, np.asarray(drawn["pattern"], np.int64))] if drawn.num_rows else np.zeros(0)
    rows = [(np.asarray(w.values), np.asarray(v.values, np.float64)) for w, v in zip(drawn["which"], drawn["value"])]
    weights, bias = fitted(rows, labels)
    shared = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias, pattern, posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, pattern, posterior = shared.value
        weights = weights.astype(np.float64)
        for part, texts in chunks(batches, most=CHUNK // 2):
            own = Measured(texts)
            weak = posterior[np.searchsorted(pattern, patterns(own.votes()))]
            found = own.scores(weights, bias)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(weak, pa.float64()), pa.array(found, pa.float64())], names=[*part.schema.names[:3], "weak", "score"])

    whole = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.struct(F.lit(0).alias("_none"), *keep).alias("_rest"))
    schema = StructType([*whole.schema.fields, StructField("weak", DoubleType()), StructField("score", DoubleType())])
    out = whole.transform(mapped, score, schema)
    return out.select(F.col("_key").alias(key), *(F.col(f"_rest.`{c}`").alias(c) for c in keep), F.col("_text").alias(text), F.col("weak"), F.col("score"), (F.col("score") >= KEEP).alias("good"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select("doc_id", F.round("weak", 6).alias("weak"), F.round("score", 6).alias("score"), "good")
