"""URL filters: all glob rules at once, by a bit-parallel automaton.

Every glob is a run of bits: bit 0 stands for "nothing matched yet", bit i for "i literals matched".
A wildcard keeps its bit alive (the loop mask). One Shift-And step over multiword masks moves all
globs over one symbol; the step is vectorised over the URLs of a batch, longest first, so that each
step touches only URLs that still have symbols.

Canonical form of a URL: a dot, the host (A-Z lower-cased), a boundary that no URL can hold, the path.
A rule `example.com/en/` is the glob `*.example.com<boundary>/en/*`, so it fits the host and its subdomains.

Edge cases: a null URL or one without `://` has an empty host and path, fits no rule and is allowed;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

BOUNDARY = "\x00"  # in globs; symbol 256 in canonical URLs
#: Host and path rules of the query, with their verdicts.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Globs over the canonical form that block what no rule fits.
GLOBS = ["*.spam-*", "*.cheap-*", "*-pills.*", "*casino*", "*.porn*", "*/ads/*", "*/tracker/*", "*.exe", "*.zip"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Globs:
    """Masks of all globs; `*` stands for any run of symbols, BOUNDARY for that between host and path."""

    def __init__(self, globs: Sequence[str]):
        bits = sum(len(g.replace("*", "")) + 1 for g in globs)
        words = max(1, -(-bits // 64))
        self.moves = np.zeros((257, words), np.uint64)  # by symbol: bits that it can reach
        self.loops, self.first = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for glob in globs:
            self.set(self.first, at)
            for c in glob:
                if c == "*":
                    self.set(self.loops, at)
                    continue
                symbols = [256] if c == BOUNDARY else c.encode()
                if len(symbols) > 1:
                    raise ValueError(f"a glob holds ASCII only: {glob!r}")
                at += 1
                self.set(self.moves[symbols[0]], at)
            self.last.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1

    @staticmethod
    def set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, canonical: list[np.ndarray]) -> np.ndarray:
        """Whether each glob (column) fits each whole sequence of symbols (row)."""
        sizes = np.array([len(x) for x in canonical], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([np.zeros(0, np.uint16), *(canonical[i] for i in order)])
        sizes = sizes[order]
        begin = np.cumsum(sizes) - sizes
        state = np.tile(self.first, (len(sizes), 1))
        live = len(sizes)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sizes[0]) if live else 0):
            while sizes[live - 1] <= t:
                live -= 1
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.moves[flat[begin[:live] + t]]) | (now & self.loops)
        out = np.empty((len(sizes), len(self.last)), bool)
        for k, (word, bit) in enumerate(self.last):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def canonical(host: str, path: str) -> np.ndarray:
    left, right = (np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16) for x in (f".{host}", path))
    return np.concatenate([left, [np.uint16(256)], right])


def as_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}{BOUNDARY}{slash}{path}*"


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[str] = GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, n_globs): the longest rule that fits (else null), its verdict or else `block` if a glob fits, the number of globs that fit."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    one = df.select(F.col(key), F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    order = sorted(rules, key=lambda x: -len(x[0]))
    globs = list(globs)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, n_globs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Globs([*(as_glob(r) for r, _ in order), *globs])
        n = len(order)
        names = np.array([*(r for r, _ in order), None], object)
        verdicts = np.array([*(v for _, v in order), None], object)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                hits = own.match([canonical(h, p) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())])
                first = np.where(hits[:, :n].any(axis=1), hits[:, :n].argmax(axis=1), n)
                count = hits[:, n:].sum(axis=1)
                verdict = np.where(first < n, verdicts[first], np.where(count > 0, "block", "allow"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[first], pa.string()), pa.array(verdict, pa.string()), pa.array(count, pa.int64())], names=[key, "host", "path", "rule", "verdict", "n_globs"])

    return one.mapInArrow(run, schema)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def sql() -> str:
    def like(glob: str) -> str:
        escaped = glob.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace(BOUNDARY, "\t")
        return "c LIKE '" + escaped.replace("\t", "' || chr(1) || '") + "' ESCAPE '!'"

    order = sorted(RULES, key=lambda x: -len(x[0]))
    rule = " ".join(f"WHEN {like(as_glob(r))} THEN '{r}'" for r, _ in order)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in order)
    count = " + ".join(f"({like(g)})::BIGINT" for g in GLOBS)
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, '.' || host || chr(1) || path AS c FROM b),
    d AS (SELECT *, CASE {rule} END AS rule, {count} AS n_globs FROM c)
    SELECT page_id, host, path, rule, CASE {verdict} WHEN n_globs > 0 THEN 'block' ELSE 'allow' END AS verdict, n_globs FROM d"""
