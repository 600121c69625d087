"""What Python workers hold at once, and what they give back."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import bpe, common, near_dedup  # noqa: E402


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat('river stone ', 2000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = docs.transform(common.mapped, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 1000
    assert max(r.size for r in got) < 2 * common.BATCH_BYTES


def test_a_session_keeps_its_own_bound(spark):
    old = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.set(common.BATCH, "12345678")
        bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
        assert spark.conf.get(common.BATCH) == "12345678"
    finally:
        spark.conf.unset(common.BATCH) if old is None else spark.conf.set(common.BATCH, old)


def test_free_memory_goes_back_to_the_system():
    if not common.trimmer() or not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("needs glibc on Linux")

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])

    many = [bytes(2000) for _ in range(50_000)]
    last = many[-1]  # what is above the rest keeps the heap from shrinking by itself
    del many
    before = held()
    common.freed()
    assert before - held() > 50_000 and len(last) == 2000


def test_short_texts_make_small_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a b c"] * 4999 + [None])], names=["_key", "_text"])
    parts = list(common.chunks(iter([batch]), most=1 << 18, least=1024))
    assert max(len(texts) for _, texts in parts) <= 256
    assert [k for part, _ in parts for k in part.column(0).to_pylist()] == list(range(5000)) and parts[-1][1][-1] == ""


def test_sketches_of_many_short_texts_take_bounded_memory(monkeypatch, spark):
    most = []
    plain = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda doc, element, weight, n: most.append(n) or plain(doc, element, weight, n))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"river {i}" for i in range(2000)])], names=["doc_id", "_text"])
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    run = []
    monkeypatch.setattr(near_dedup, "mapped", lambda df, f, schema: run.append(f) or df)
    near_dedup.sketched(docs, "doc_id", "text")
    assert sum(b.num_rows for b in run[0](iter([batch]))) == 2000
    assert max(most) <= 256


def test_pairs_are_cut_by_the_size_of_their_texts():
    rnd = random.Random(5)
    texts = {bytes([i]) * 16: "word " * rnd.choice((3, 400, 20_000)) for i in range(40)}
    pairs = [tuple(sorted(rnd.sample(sorted(texts), 2))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((a, b, texts[a], texts[b]) for a, b in pairs))], names=["a", "b", "_a", "_b"])
    got = []
    for part, names in near_dedup.pair_chunks(iter([batch]), most=50_000):
        own = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
        assert names == {d: texts[d] for p in own for d in p}
        assert len(own) == 1 or sum(map(len, names.values())) <= 50_000
        got += own
    assert got == pairs
