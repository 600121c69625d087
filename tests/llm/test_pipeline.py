"""The pipeline's stages by themselves: columns, order, and what each keeps, against plain Python."""

import random

import pytest
from pyspark.sql import Row

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_corpus_operators import mixed_texts, plain_classes, plain_hits, plain_quality, plain_terms, plain_spans  # noqa: E402

from tidemark.llm import bpe, decontamination, near_dedup, pii  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, doc_id long, lang string, _doc string, _text string, score double, spans string, _row string, n_chars long"


def test_columns_with_clashing_names_come_through(spark):
    rnd = random.Random(1)
    words = "the of and to in is it that was with over under river stone light house green road".split()
    rows = [Row(text=" ".join(rnd.choices(words, k=60)) + ". Write to ann@mail.example.org today.", doc_id=i, lang="en", _doc="a", _text="b", score=0.5, spans="c", _row="d", n_chars=1) for i in range(30)]
    rows += [rows[0], Row(text=None, doc_id=90, lang=None, _doc=None, _text=None, score=None, spans=None, _row=None, n_chars=None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r._doc, r._text, r.score, r.spans, r._row) for r in out.collect()} <= {("a", "b", 0.5, "c", "d"), (None,) * 5}, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    assert corpus_pipeline.tokens(spark, docs.limit(0), SF).collect() == []


def test_stages_on_driver_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.good_only(spark, docs, SF)
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.1 * sum(1 - q for q in labels.values()) + 1
    first = corpus_pipeline.first_copies(spark, good, SF)
    ids = [r.doc_id for r in first.collect()]
    assert len(ids) == len(set(ids)) and len({near_dedup.digest_of(before[i].text or "") for i in ids}) == len(ids)
    clean = corpus_pipeline.without_benchmark(spark, first, SF)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = clean.collect()
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert not any(spans for _, spans, _ in decontamination.searched([r.text or "" for r in rows], decontamination.Phrases(items)))
    safe = corpus_pipeline.without_personal_data(spark, clean, SF)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert not any("@mail" in (t or "") for t in texts.values())
    own = bpe.codec(bpe.default_path())
    for r in corpus_pipeline.tokens(spark, safe, SF).collect():
        assert own.decode(r.ids).decode() == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    rnd = random.Random(3)
    item = " ".join(rnd.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split(), k=20))
    texts = mixed_texts(30, seed=9)
    long = texts[1] + " " + texts[2]
    new = mixed_texts(6, seed=21)
    texts += [long, long + " and one word more", long, f"{texts[4]} {item} {texts[5]}", f"{new[1]} The wombat of ann@firm.org, call +44 55 66 77 88.", f"{new[2]} The wombat of bob@firm.org", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    # quality
    own = [(i, t, score) for i, (t, score) in enumerate(zip(texts, plain_quality([t or "" for t in texts])[1]))]
    assert all(abs(score - 0.5) > 1e-3 for _, _, score in own)
    docs = [(i, t) for i, t, score in own if score >= 0.5]
    # copies
    label = plain_classes([t or "" for _, t in docs])
    docs = [d for k, d in enumerate(docs) if label[k] == k]
    # benchmark
    kept = []
    for i, t in docs:
        words = decontamination.words(t or "")
        n, hit, names = plain_hits([t or ""], [("1", item)], 13)[0]
        if hit:
            assert names == ["1"] and hit == 20 < n
            begin = next(k for k in range(n) if list(words[k : k + 20]) == list(decontamination.words(item)))
            t = decontamination.without(t, [begin, begin + 20])
            assert item not in t
        kept.append((i, t))
    # personal data
    spans = [[*plain_spans(t or ""), *added] for (_, t), added in zip(kept, plain_terms([t or "" for _, t in kept]))]
    safe = {i: t if t is None else pii.redacted(t, s) for (i, t), s in zip(kept, spans)}
    assert any("[EMAIL]" in (t or "") for t in safe.values())
    # tokens
    ranks = bpe.codec(bpe.default_path()).ranks
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (list(r.ids), r.n_tokens) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert got == {i: (ids := other.encode_ordinary(t or ""), len(ids)) for i, t in safe.items()}
    assert 15 < len(got) < 30
