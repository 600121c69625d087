"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value found is an
entity to protect, and so is the class that it belongs to: the domain of an address, the first three parts
of an IP address, the issuer's digits of a card, the first digits of a phone number. Classes are met in
more documents than values, so that words that give away an employer, a network, a bank or a place have
counts to show. Terms are the words outside base spans of the documents that hold it; over the whole
corpus

    n(t, e)   documents that hold both t and e
    n(t)      documents that hold t
    n(e)      documents that hold e
    N         documents

give the pointwise mutual information PMI(t; e) = log(N p(t|e) / n(t)), and the information content
IC(e) = log(N / n(e)). For p(t|e) stands the lower confidence bound (Wilson's, `z` deviates) of n(t,e) in
n(e), so that few documents count for less and none are left out. A term discloses e as far as
PMI(t; e) / IC(e) goes; at `remove` or more it is removed, at `generalise` or more it is replaced by a
placeholder, wherever it stands in a document that holds e. Documents without e keep it: none of them, and
none of the sanitised ones, has both any more.

The corpus is read once for spans, entities and terms; that table (only texts with personal data have
terms in it, and are themselves there) is written to the shared folder and everything else derives from
it. Counting n(t) reads the words once more: tasks count in tables of bounded size, whose rows are added up
by term. Of all pairs of an entity and a term those whose n(e) and n(t) alone keep the disclosure below the
threshold, whatever n(t, e) is, are left out before they are counted. Nothing that grows with the corpus goes
through the driver or is broadcast, and both sides of the joins by term and by entity are stored before, so
that the optimiser can split a common one.

Edge cases: null and empty texts have no spans; repeated rows get the same spans each and count as
documents; keys may be null or repeated, as rows are told apart by key and text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, mapped, packed, stored, table, unpacked

KINDS = ["email", "ip", "card", "phone"]
#: What a class of each kind is.
CLASSES = ["domain", "net", "issuer", "region"]
#: Added spans, behind the base kinds in order.
TERM_KINDS = ["generalised", "removed"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can't start within a run of digits: what fails at its start fails there too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
#: In ASCII texts: letters in lower case, a space for anything else.
LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
GENERALISE, REMOVE = 0.6, 0.85
#: Deviates of the confidence bound: 99 in 100, two-sided.
Z = 2.576
#: Terms that a task counts before it passes their counts on.
HELD = 150_000
#: Digits that tell the issuer of a card, and the region of a phone number.
ISSUER, REGION = 6, 4


def emails(text: str) -> list[tuple[int, int]]:
    """From one @ to the next: the run of local characters before it, and the domain behind."""
    out, bound, at = [], 0, text.find("@")
    while at >= 0:
        before = text[bound:at]
        size = len(before) - len(before.rstrip(LOCAL))
        bound = at + 1
        if size and (m := DOMAIN.match(text, bound)):
            bound = m.end()
            out.append((at - size, bound))
        at = text.find("@", bound)
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; leftmost non-overlapping for each kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


def entity(text: str, kind: int) -> str:
    return f"{KINDS[kind]}:{text.lower() if kind < 2 else re.sub(r'[^0-9]', '', text)}"


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The values that a text holds, and their classes."""
    out = set()
    for start, end, kind in spans:
        value = entity(text[start:end], kind)
        bare = value.split(":", 1)[1]
        wide = {0: bare.rpartition("@")[2], 1: bare.rpartition(".")[0], 2: bare[:ISSUER], 3: bare[:REGION]}[kind]
        out |= {value, f"{CLASSES[kind]}:{wide}"}
    return sorted(out)


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end): the words that no span touches; spans are in order."""
    out, k, last = [], 0, 0
    for m in TERM.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            last = max(last, spans[k][1])
            k += 1
        if last <= start:
            out.append((m[0].lower(), start, end))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
SPANS_SQL = "array<struct<start: int, `end`: int, kind: int>>"


def row_id(key: str, text: str) -> Column:
    """Tells rows apart by key and text; equal for repeated rows only."""
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _row, base array<struct<start, end, kind>>, entities, terms, _held): one pass over the texts; _held is the text where there are spans."""
    one = df.select(F.col(key), F.col(text).cast("string").alias("_text"), row_id(key, text).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            found = [base_spans(x) for x in texts]
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], SPANS)
            entities = pa.array([entities_of(x, s) for x, s in zip(texts, found)], pa.list_(pa.string()))
            terms = pa.array([sorted({t for t, _, _ in outside(x, s)}) if s else [] for x, s in zip(texts, found)], pa.list_(pa.string()))
            held = pa.array([x if s else None for x, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), spans, entities, terms, held], names=[key, "_row", "base", "entities", "terms", "_held"])

    return one.transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, _row string, base {SPANS_SQL}, entities array<string>, terms array<string>, _held string")


def frequencies(df: DataFrame, text: str = "text", most: int = HELD) -> DataFrame:
    """(term, n_docs): documents that hold each term of the corpus, in one pass; a task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "surrogatepass") for t in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n_docs"])
            count.clear()
            return out

        for _, texts in chunks(batches, text=0):
            for x in texts:
                count.update({t for t in x.encode().translate(LETTERS).split() if len(t) > 1} if x.isascii() else {m.lower().encode("utf-8", "surrogatepass") for m in set(TERM.findall(x))})
                if len(count) > most:
                    yield full()
        yield full()

    one = df.select(F.col(text).cast("string").alias("_text")).transform(mapped, run, "term string, n_docs bigint")
    return one.groupBy("term").agg(F.sum("n_docs").alias("n_docs"))


def bounded(k: Column, n: Column, z: float) -> Column:
    """Wilson's lower confidence bound of a share that k in n show."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing(df: DataFrame, found: DataFrame, text: str = "text", z: float = Z, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, disclosure, kind): the pairs beyond the thresholds."""
    n = found.count()
    total = F.lit(float(max(n, 2)))
    counts = stored(frequencies(df, text))
    own = stored(found.where(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("_d"), "entities", "terms"))
    entities = stored(own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")))
    # words of a document with their counts, and its entities with theirs
    terms = own.select("_d", F.explode("terms").alias("term")).join(counts, "term").groupBy("_d").agg(F.collect_list(F.struct("term", "n_docs")).alias("terms"))
    named = own.select("_d", F.explode("entities").alias("entity")).join(entities, "entity")

    def share(both: Column, n_docs: Column) -> Column:
        # a term is in as many documents as hold it with an entity at least; one whose entity is everywhere discloses nothing
        pmi = F.log(total * bounded(both, F.col("n_entity"), z) / F.greatest(n_docs, both))
        return F.when(F.col("n_entity") < total, pmi / F.log(total / F.col("n_entity"))).otherwise(0.0)

    # of the words of a document only those go on whose counts leave them a chance, however often they stand beside the entity
    chance = named.join(terms, "_d").select("entity", "n_entity", F.explode(F.filter("terms", lambda t: share(F.least(F.col("n_entity"), t["n_docs"]), t["n_docs"]) >= generalise)).alias("t"))
    pairs = chance.groupBy("entity", F.col("t.term").alias("term"), "n_entity", F.col("t.n_docs").alias("n_docs")).agg(F.count("*").alias("n_both"))
    return pairs.withColumn("disclosure", share(F.col("n_both"), F.col("n_docs"))).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, 5).otherwise(4).alias("kind"))


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """(key, _row, base, added): of each row its base spans and those of disclosing terms, as (start, end, kind); kinds 0 to 3 are KINDS, 4 and 5 TERM_KINDS."""
    found = stored(scan(df, key, text))
    pairs = disclosing(df, found, text, **thresholds)
    kinds = {"generalised": 4, "removed": 5}
    # terms beyond the thresholds only: less than the words of the documents of an entity
    own = stored(pairs.groupBy("entity").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(f"_{name}") for name, k in kinds.items())))
    # of the terms of an entity, those in the row
    near = found.where(F.size("terms") > 0).select("_row", "entities", "terms").dropDuplicates(["_row"]).select("_row", "terms", F.explode("entities").alias("entity"))
    hit = near.join(own, "entity").select("_row", *(F.array_intersect("terms", f"_{name}").alias(name) for name in kinds))
    hit = hit.groupBy("_row").agg(*(F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name in kinds))
    one = found.select(key, "_row", "base", "_held").join(hit, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, held, generalised, removed = (batch.column(i).to_pylist() for i in range(2, 6))
            added = []
            for spans, x, less, more in zip(base, held, generalised, removed):
                kind = dict.fromkeys(less or [], 4) | dict.fromkeys(more or [], 5)
                places = outside(x, [(s["start"], s["end"], s["kind"]) for s in spans]) if kind else []
                added.append([{"start": a, "end": b, "kind": kind[t]} for t, a, b in places if t in kind])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(added, SPANS)], names=[key, "_row", "base", "added"])

    return one.select(key, "_row", "base", "_held", *kinds).transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, _row string, base {SPANS_SQL}, added {SPANS_SQL}")


def written(spans_column: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS + TERM_KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans_column: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans_column, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


PLACEHOLDERS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with placeholders; of overlapping spans the earliest, then the longest, gives the name, and all that they cover goes."""
    out, last = [], 0
    for start, end, kind in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if start >= last:
            out += [text[last:start], PLACEHOLDERS[kind]]
        last = max(last, end)
    return "".join([*out, text[last:]])


def sanitise(df: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """df with the personal data and the disclosing terms of its texts replaced; null texts stay null."""
    own = packed(df, key, text)
    found = spans(own, "_key", "_text", **thresholds).select("_row", F.concat("base", "added").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_row"])
    one = own.withColumn("_row", row_id("_key", "_text")).join(found, "_row", "left")

    @F.pandas_udf("string")
    def replace(texts, spans):
        return texts.combine(spans, lambda x, s: x if x is None or s is None else redacted(x, [(r["start"], r["end"], r["kind"]) for r in s]))

    return unpacked(one.withColumn("_text", F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(replace(F.col("_text").cast("string"), "_spans"))), df, text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    every = ordered(F.concat("base", "added"))
    # F.filter gives a function of two arguments the index as well
    of_kind = lambda k: lambda s: s["kind"] == k
    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_terms"))
