"""Quality, personal data, decontamination, repeats and near-duplicates: against brute force, with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

pytest.importorskip("tidemark.llm")

from tidemark.llm import decontamination, near_dedup, pii, quality, repeats  # noqa: E402

SCHEMA = "doc_id long, text string, _row string, spans string, words string"


def documents(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, _row="clash", spans="clash", words="clash") for i, t in enumerate(texts)], SCHEMA)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(n))


# personal data

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (12 <= len(digits) <= 19 and total % 10 == 0) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(5)
    for alphabet in ("ab@.-_ %1", "0123456789. ", "0123456789 -", "+0123456789 ().-x", "a1@.+ -9("):
        for _ in range(4000):
            text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for x in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "@a" * 100_000, "+1" * 100_000, "1." * 100_000):
        pii.base_spans(x)


def plain_terms(texts):
    """The added spans of each text, from all pairs of an entity and a word."""
    found = [(plain_spans(t), [m for m in pii.TERM.finditer(t)]) for t in texts]
    words = [{m[0].lower() for m in w if not any(m.start() < b and a < m.end() for a, b, _ in s)} for s, w in found]
    wide = lambda x, k: (x.split("@")[-1].lower(), x.rpartition(".")[0], re.sub("[^0-9]", "", x)[: pii.ISSUER], re.sub("[^0-9]", "", x)[: pii.REGION])[k]
    named = [{pii.entity(t[a:b], k) for a, b, k in s} | {f"{pii.CLASSES[k]}:{wide(t[a:b], k)}" for a, b, k in s} for t, (s, _) in zip(texts, found)]
    every = Counter(w for t in texts for w in {m[0].lower() for m in pii.TERM.finditer(t)})
    entities = Counter(e for n in named for e in n)
    both = Counter((e, w) for n, ws in zip(named, words) for e in n for w in ws)

    def share(e, w):
        n, k, z = entities[e], both[e, w], pii.Z
        low = (k / n + z * z / 2 / n - z * (k / n * (1 - k / n) / n + (z / 2 / n) ** 2) ** 0.5) / (1 + z * z / n)
        return np.log(len(texts) * low / every[w]) / np.log(len(texts) / n)

    free = lambda m, s: not any(m.start() < b and a < m.end() for a, b, _ in s)
    return [[(m.start(), m.end(), max(4 + (share(e, m[0].lower()) >= pii.REMOVE) for e in own)) for m in w if free(m, s) and (own := [e for e in n if share(e, m[0].lower()) >= pii.GENERALISE])] for (s, w), n in zip(found, named)]


def test_pii_frames(spark):
    texts = [None, "", "call +1 (437) 555-0689 or a.b@c.example.org now", "é é 10.0.0.1 x", "same a@b.co", "same a@b.co"]
    texts += [f"the {w * 3} keeper zanzibar wrote {prose(random.Random(i), 9)} to key@holder.org today {prose(random.Random(i + 50), 30)}" for i, w in enumerate("abcdefgh")]
    texts += [prose(random.Random(i), 60) + " keeper the to" for i in range(100, 160)]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.end, s.kind) for s in got[i].base] == plain_spans(t or "")
    # a word that stands only beside one address gives it away; words of all texts don't
    hit = {texts[6][s.start : s.end] for s in got[6].added}
    assert "zanzibar" in hit and "the" not in hit and "to" not in hit
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text is None and clean[1].text == "" and clean[2].text == "call [PHONE] or [EMAIL] now" and clean[3].text == "é é [IP] x"
    assert clean[2]._row == "clash" and "zanzibar" not in clean[6].text and clean[4].text == clean[5].text == "same [EMAIL]"
    assert pii.spans(df.limit(0)).collect() == []


def test_entities_of_few_documents_have_terms(spark):
    texts = [f"{prose(random.Random(i), 40, 60)} the" for i in range(400)]
    texts += ["w1x the gazebo of once@one.org the w2x", *["w3x the marmot of twice@two.org the w4x"] * 5]
    got = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.added} for r in pii.spans(documents(spark, texts)).collect()}
    assert {"gazebo"} <= got[400] <= {"gazebo", "of"}  # in one document
    assert all({"marmot"} <= got[i] <= {"marmot", "of"} for i in range(401, 406))  # in copies
    assert not any(got[i] for i in range(400))


def test_terms_are_those_of_whole_documents(spark):
    texts = [f"{prose(random.Random(i), 40, 60)} the" for i in range(400)] + ["a tapir without an address"] * 2
    far = prose(random.Random(1), 90, 60)
    texts += [f"Tapir and OKAPI\n{far} the tapir {far} far@from.org {far} tapir", f"the okapi {far} next@one.org or far@from.org {far} Okapi", f"{far} other@one.org"]
    df = documents(spark, texts)

    want = plain_terms(texts)
    got = {r.doc_id: [tuple(s) for s in r.added] for r in pii.spans(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(df).collect()}
    assert clean[400] == texts[400] and not any(w in clean[i] for i in range(402, 405) for w in ("okapi", "far@"))
    assert len(want[402]) >= 2 and clean[402].count("[term]") == len(want[402])


def test_classes_of_values_have_terms(spark):
    texts = [f"{prose(random.Random(i), 40, 60)} the" for i in range(300)]
    texts += [f"{prose(random.Random(i), 40, 60)} the wombat n{i}@firm.org" for i in range(6)]
    one = "a@B.org, 1.2.3.4, 4111111111111111, +4412345678"
    assert pii.entities_of(one, pii.base_spans(one)) == ["card:4111111111111111", "domain:b.org", "email:a@b.org", "ip:1.2.3.4", "issuer:411111", "net:1.2.3", "phone:4412345678", "region:4412"]
    got = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.added} for r in pii.spans(documents(spark, texts)).collect()}
    # each value is in one of the six documents that hold the word, their domain in all six
    assert all(got[i] == {"wombat"} for i in range(300, 306)) and not any(got[i] for i in range(300))


def test_frequencies_in_tables_of_bounded_size(spark):
    texts = ["a bc Bc dé dé", None, "bc dé x", "bc bc"]
    for most in (pii.HELD, 1):
        assert {r.term: r.n_docs for r in pii.frequencies(documents(spark, texts), most=most).collect()} == {"bc": 3, "dé": 2}


def test_pii_query(spark, tmp_path):
    texts = [None, "", "a@b.co and c@d.co, 10.0.0.1", "10.0.0.1 10.0.0.2 4111 1111 1111 1111", "+1 (437) 555-0689", "no data", "no data"]
    texts += [f"{prose(random.Random(i), 20)} okapi z@zoo.org" for i in range(5)] + [prose(random.Random(i), 30) for i in range(50)]
    documents(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op3_pii(spark, f"file://{tmp_path}").collect()}
    assert len(rows) == len(texts)
    added = {r.doc_id: [tuple(s) for s in r.added] for r in pii.spans(documents(spark, texts)).collect()}
    assert any(added.values())
    names = ["email", "ip", "card", "phone", "generalised", "removed"]
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        write = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))
        r = rows[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, _, k in base) for kind in range(4))
        assert r.base_sha256 == hashlib.sha256(write(base).encode()).hexdigest()
        assert r.spans == write([*base, *added[i]]) and r.n_terms == len(added[i])


# decontamination


def plain_hits(texts, items, window):
    phrases = {}
    for name, t in items:
        w = decontamination.words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for t in texts:
        w = decontamination.words(t)
        hit, names = np.zeros(len(w), bool), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if found := phrases.get(tuple(w[i : i + size])):
                    hit[i : i + size] = True
                    names |= found
        out.append((len(w), int(hit.sum()), sorted(names)))
    return out


def test_fm_index_finds_what_brute_force_finds():
    rnd = random.Random(3)
    for _ in range(200):
        words = [*"abcd"[: rnd.randint(1, 4)], "Z1"]
        items = [(str(i), " ".join(rnd.choices(words[: max(1, len(words) - 1)], k=rnd.randint(0, 7)))) for i in range(rnd.randint(0, 5))]
        texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40]))) for _ in range(rnd.randint(1, 6))]
        texts += texts[:2]
        window = rnd.randint(1, 5)
        got = [(n, sum(s[1::2]) - sum(s[::2]), names) for n, s, names in decontamination.searched(texts, decontamination.Phrases(items, window))]
        assert got == plain_hits(texts, items, window)


def test_decontamination_frames(spark, monkeypatch):
    rnd = random.Random(9)
    item = prose(rnd, 30)
    texts = [None, "", f"{prose(rnd, 40)} {item.upper()} {prose(rnd, 40)}", prose(rnd, 400), "one two", f"x-{item}-y", f"x-{item}-y"]
    bench = spark.createDataFrame([Row(item_id=1, text=item, words="clash"), Row(item_id=2, text="one two", words="c"), Row(item_id=3, text=None, words="c"), Row(item_id=None, text=item, words="c"), Row(item_id=4, text="", words="c")], "item_id long, text string, words string")
    df = documents(spark, texts)
    want = plain_hits([t or "" for t in texts], [("1", item), ("2", "one two"), ("null", item)], 13)
    passes = {block: list(decontamination.blocks(bench, block=block)) for block in (decontamination.BLOCK, 100)}
    for block, found in passes.items():  # one pass, and several
        assert sum(map(len, found)) == 4 and (len(found) > 1) == (block == 100)
        monkeypatch.setattr(decontamination, "blocks", lambda b, f=found: iter(f))
        got = {r.doc_id: r for r in decontamination.search(df, bench, keep=["words"]).collect()}
        assert [(got[i].n_words, sum(got[i].spans[1::2]) - sum(got[i].spans[::2]), got[i]["items"]) for i in range(len(texts))] == want
    assert decontamination.without(texts[2], got[2].spans).count("W") == 0
    assert decontamination.without("Aa b, c! d", [1, 3]) == "Aa ! d"
    assert decontamination.search(df.limit(0), bench).collect() == []
    none = bench.limit(0)
    monkeypatch.undo()
    assert all(not r.spans for r in decontamination.search(df, none).collect())


# repeats


def plain_removed(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if count[d[i : i + 400]] > 1:
                hit[i : i + 400] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def test_repeats(spark):
    rnd = random.Random(1)
    sources = ["".join(rnd.choices("abc ", k=1500)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            a = rnd.randint(0, 1400)
            parts.append("".join(rnd.choices("abcdé", k=rnd.randint(0, 500))) if rnd.random() < 0.4 else rnd.choice(sources)[a : a + rnd.randint(1, 900)])
        texts.append("".join(parts))
    texts += ["a" * 1500, "ab" * 500, None, "", texts[0], "x" + "a" * 399, "y" * 400 + "é", "y" * 401, "z" * 400]
    got = {r.doc_id: repeats.union([(s.begin, s.end) for s in r.spans or []]) for r in repeats.removed(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts)
    assert repeats.removed(documents(spark, texts).limit(0)).collect() == []


@pytest.mark.parametrize("heavy", [0, 3])
def test_repeats_of_common_anchors(spark, heavy):
    rnd = random.Random(6)
    shared = "".join(rnd.choices("abcde", k=700))
    texts = ["".join(rnd.choices("abcde", k=rnd.randint(0, 300))) + shared[rnd.randint(0, 150) : rnd.randint(560, 700)] + "".join(rnd.choices("abcde", k=rnd.randint(0, 300))) for _ in range(12)]
    texts += ["xy" * 400, "line of text\n" * 60, "line of text\n" * 45, texts[0], "z" * 401, shared[:399]]
    found = repeats.find(documents(spark, texts), heavy=heavy)
    names = documents(spark, texts).select("doc_id", repeats.row_id("doc_id", "text").alias("_row"))
    got = {r.doc_id: repeats.union([(s.begin, s.end) for s in r.spans or []]) for r in names.join(found, "_row", "left").collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts)


@pytest.mark.parametrize("batch", [1, 7, 10000])
@pytest.mark.parametrize("heavy", [0, 5, 100])
def test_anchors_met_again(spark, heavy, batch):
    rnd = random.Random(heavy)
    rows = [(g, b"%d" % i, i) for i, g in enumerate([*range(300), *rnd.choices(range(40), k=500), *[17] * 400])]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = repeats.met_again(spark.createDataFrame(rows, "gram bigint, _row binary, at int").repartition(3), heavy).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.gram, r.at) for r in out if r._row is not None)
    count = Counter(g for g, _, _ in rows)
    assert len(got) == len(set(got)) and set(got) >= {(g, i) for g, _, i in rows if count[g] > 1}
    assert len(got) - sum(n for n in count.values() if n > 1) <= 2 * 4  # at most those at the ends of ranges
    told = Counter()
    for r in out:
        if r._row is None:
            told[r.gram] += r.n
    assert {g for g, n in told.items() if n > heavy} == {g for g, n in count.items() if n > heavy}
    assert all(told[g] == n for g, n in count.items() if n > heavy)


def test_row_ids_tell_key_and_text_apart(spark):
    df = spark.createDataFrame([("a", ":b"), ("a:", "b"), ("a", ":b"), (None, "x"), ("null", "x")], "key string, text string")
    assert df.select(repeats.row_id("key", "text")).distinct().count() == 4


def test_repeats_query(spark, tmp_path):
    rnd = random.Random(8)
    shared = "".join(rnd.choices("abcdé ", k=600))
    texts = [None, "", "short", shared + "tail", "head" + shared, "".join(rnd.choices("xyz", k=900))]
    documents(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in repeats.op6_repeats(spark, f"file://{tmp_path}").collect()}
    for i, cuts in enumerate(plain_removed(texts)):
        data = (texts[i] or "").encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)]))
        assert rows[i][1:] == (len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), bool(cuts))
    assert rows[3].has_repeats and not rows[5].has_repeats


def test_repeated_rows_lose_all(spark):
    df = spark.createDataFrame([Row(doc_id=None, text="q1" + "w" * 10 + prose(random.Random(4), 120))] * 2 + [Row(doc_id=3, text="short")], "doc_id long, text string")
    for r in repeats.removed(df).collect():
        assert repeats.union([(s.begin, s.end) for s in r.spans or []]) == ([] if r.doc_id else [(0, len(r.text))])


def test_merge_keeps_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (300, 40), dtype=np.uint8)
    rows[50:80] = rows[10]
    run = rng.integers(0, 4, 300)
    order, common = repeats.merged(repeats.words_of(rows), run)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], common[1:]):
        assert min(n, 40) == next((i for i in range(40) if a[i] != b[i]), 40)


# near-duplicates


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    estimates, truths = [], []
    for _ in range(150):
        a, b = rng.random((2, 30)) * 3 + 0.05
        names = rng.integers(0, 2**63, 30, dtype=np.uint64)
        s = near_dedup.signatures(np.repeat([0, 1], 30), np.tile(names, 2), np.concatenate([a, b]), 2)
        estimates.append((s[0] == s[1]).mean())
        truths.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(estimates) - np.mean(truths)) < 0.015


def plain_classes(texts):
    """The first of each class, by all pairs."""
    shingled = near_dedup.Shingled(texts)
    cut = np.searchsorted(shingled.doc, np.arange(len(texts) + 1))
    sets = [(shingled.shingle[a:b], shingled.weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = near_dedup.digest_of(texts[i]) == near_dedup.digest_of(texts[j])
            if same or len(sets[i][0]) and len(sets[j][0]) and near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_dedup(spark):
    rnd = random.Random(7)
    texts = [None, "", "  ", "...", "one", "one", "two words", "Two, words!"]
    for _ in range(12):
        base = prose(rnd, 200, 5000).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 3, 5, 9, 40):
            own = list(base)
            for _ in range(edits):
                own[rnd.randrange(len(own))] = f"new{rnd.random()}"
            texts.append(" ".join(own))
    # a text whose weights alone differ
    texts += ["a b c d e f " * 30, "a b c d e f " * 3]
    label = plain_classes([t or "" for t in texts])
    df = documents(spark, texts)
    got = {r.doc_id: bytes(r.label) for r in near_dedup.classes(df).collect()}
    firsts = {}
    for i in range(len(texts)):
        firsts.setdefault(got[i], i)
    assert [firsts[got[i]] for i in range(len(texts))] == label
    kept = sorted(r.doc_id for r in near_dedup.first_of_classes(df).collect())
    assert kept == sorted(set(label))
    assert near_dedup.classes(df.limit(0)).collect() == []
    assert near_dedup.first_of_classes(df.limit(0)).collect() == []


def test_similar_sets_and_ties(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 400)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), replace=False), rng.integers(0, 2**62, rng.integers(0, 60))])) for _ in range(60)] + [base[:5], base[:4], base[:400], np.unique(base)]
    want = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets])
    assert 100 < want.sum() < want.size / 2
    for entries in (near_dedup.ENTRIES, 1000):
        monkeypatch.setattr(near_dedup, "ENTRIES", entries)
        assert (near_dedup.similar(np.concatenate(sets), np.array([len(x) for x in sets]), 0.8) == want).all()
    label = rng.integers(0, 9, 30)
    label = np.unique(label, return_inverse=True)[1]
    linked = rng.random((30, 30)) < 0.01
    linked |= linked.T
    own = list(range(label.max() + 1))
    for i, j in zip(*np.nonzero(linked)):
        a, b = own[label[i]], own[label[j]]
        own = [min(a, b) if x in (a, b) else x for x in own]
    to = near_dedup.ties(label, linked)
    together = {tuple(np.flatnonzero(to == t)) for t in set(to.tolist())}
    assert together == {tuple(i for i in range(30) if own[label[i]] == r) for r in set(own)}


def test_links_of_open_buckets(spark, monkeypatch):
    rnd = random.Random(11)
    bases = [prose(rnd, 120, 5000).split() for _ in range(3)]
    texts = []
    for i in range(90):
        own = list(bases[i % 3])
        for _ in range(rnd.randint(0, 8)):
            own[rnd.randrange(len(own))] = f"new{rnd.random()}"
        texts.append(" ".join(own) + " end" * (i % 4))
    name = lambda i: f"{i:03}".encode()
    df = spark.createDataFrame([(b, name(i), name(i % 30)) for i in range(90) for b in (i % 3, 10 + i % 2)], "bucket long, digest binary, label binary")
    have = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], "digest binary, text string")
    shingled = near_dedup.Shingled(texts)
    cut = np.searchsorted(shingled.doc, np.arange(len(texts) + 1))
    sets = [(shingled.shingle[a:b], shingled.weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    def joined(links):
        own = [i % 30 for i in range(90)]
        for i, j in links:
            a, b = own[i], own[j]
            own = [min(a, b) if x in (a, b) else x for x in own]
        return own

    want = joined([(i, j) for i in range(90) for j in range(i) if (i % 3 == j % 3 or i % 2 == j % 2) and near_dedup.similarity(sets[i], sets[j]) >= 0.8])
    assert 3 < len(set(want)) < 30
    for cell in (near_dedup.CELL, 7):
        monkeypatch.setattr(near_dedup, "CELL", cell)
        found = [(int(bytes(r.a)), int(bytes(r.b))) for r in near_dedup.open_links(df, have, 0.8).collect()]
        assert joined(found) == want


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([Row(doc_id=None, text="a b c")] * 3 + [Row(doc_id=1, text="a b c"), Row(doc_id=2, text=None), Row(doc_id=2, text=None)], "doc_id long, text string")
    assert near_dedup.first_of_classes(df).count() == 2


# quality


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = np.array([0.9, 0.85, 0.8, 0.75])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((20000, 4)) < 0.3] = 0
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    posterior, table, share = quality.accuracies(pattern, count, 4)
    assert abs(share - 0.8) < 0.03 and np.abs(table[1, :, 2] - right).max() < 0.04
    assert ((posterior[np.searchsorted(pattern, quality.patterns(votes))] > 0.5) == truth).mean() > 0.85


def plain_measures(text):
    """By words and characters, one after the other."""
    words = [w for w in re.split("[ \t\n\v\f\r]+", text) if w]
    letters = [c for c in text.encode() if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128]
    bare = [(w[:-1] if w[-1] in ".,!?;:" else w) for w in words]
    bare = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in bare]
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    return {
        "words": float(len(words)), "symbols": sum(c in quality.SYMBOLS for c in text) / n, "capitals": sum(c.isascii() and c.isupper() for c in text) / max(1, len(letters)),
        "exclamations": text.count("!") / n, "bars": text.count("|") / n, "again": sum(x == y for x, y in zip(bare, bare[1:])) / n, "distinct": len(set(bare)) / n,
        "frequent": sum(w in quality.FREQUENT for w in bare) / n, "stops": text.count(".") / n, "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "length": len(text) / n,
    }


def plain_votes(m):
    pick = lambda good, bad, where: -1 if where and bad else 1 if where and good else 0
    some, long = m["words"] >= 5, m["words"] >= 40
    return [
        pick(m["symbols"] < 0.03, m["symbols"] > 0.15, some), pick(m["symbols"] < 0.1 and m["bars"] < 0.02, m["symbols"] > 0.4 or m["bars"] > 0.1, some),
        pick(m["capitals"] < 0.1, m["capitals"] > 0.35, some), pick(m["exclamations"] < 0.02, m["exclamations"] > 0.2, some), pick(m["again"] < 0.04, m["again"] > 0.15, some),
        pick(m["distinct"] > 0.35, m["distinct"] < 0.2, long), pick(m["frequent"] > 0.1, m["frequent"] < 0.04, long), pick(m["same_lines"] < 0.1, m["same_lines"] > 0.3, some),
        pick(0.02 < m["stops"] < 0.4, m["stops"] < 0.004 or m["stops"] > 0.8, long), -1 if m["words"] < 3 else 0,
    ]


def plain_quality(texts):
    """(weak, score) of each text: expectation-maximisation document by document, then a logistic model over counted features."""
    votes = [plain_votes(plain_measures(t)) for t in texts]
    p = [min(0.95, max(0.05, 0.6 + 0.1 * (v.count(1) - 2 * v.count(-1)))) for v in votes]
    for _ in range(200):
        share = min(1 - 1e-3, max(1e-3, sum(p) / len(p)))
        odds = [math.log(share / (1 - share))] * len(p)
        for j in range(10):
            good, bad = ({v: 1 + sum(w for w, own in zip(weights, votes) if own[j] == v) for v in (-1, 1)} for weights in (p, [1 - x for x in p]))
            for i, own in enumerate(votes):
                if own[j]:
                    odds[i] += math.log(good[own[j]] / sum(good.values())) - math.log(bad[own[j]] / sum(bad.values()))
        new = [1 / (1 + math.exp(-x)) for x in odds]
        moved, p = max(abs(a - b) for a, b in zip(new, p)), new
        if moved < 1e-9:
            break

    def features(t):
        data = np.frombuffer(t.encode(), np.uint8)
        number = lambda x, base: (base << quality.BITS) + (int(quality.mixed(np.array([x], np.uint64))[0]) >> (64 - quality.BITS))
        found = [m.span() for m in re.finditer(b"[^ \t\n\v\f\r]+", t.encode())]
        words = [number((int(quality.hashed(data, np.array([a]), np.array([b]))[0]) + 1) % 2**64, 0) for a, b in found]
        kinds = [int(k) for k in quality.CLASSES[data]]
        step = int(quality.STEP)
        runs = [number((((kinds[i] << 7 | kinds[i + 1]) << 7 | kinds[i + 2]) << 7 | kinds[i + 3]) * step % 2**64, 1) for i in range(len(kinds) - 3)]
        out = Counter()
        for own in (words, runs):
            for x in own:
                out[x] += 1 / len(own)
        rest = Counter()
        for i, x in enumerate(plain_measures(t).values()):
            rest[number((i * 1024 + int(np.clip(np.round(4 * np.log2(x + 1e-3)), -48, 80)) + 64 + 1) * step % 2**64, 2)] += 0.25
        return out, rest

    rows = [features(t) for t in texts]
    drawn = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
    table = [[*rows[i][0].items(), *((k, 0.25) for k, v in rows[i][1].items() for _ in range(round(v / 0.25)))] for i in drawn]
    square = Counter()
    for r in table:
        for k, v in r:
            square[k] += v * v
    scale = {k: 1 / math.sqrt(v / len(table) + 1e-4) for k, v in square.items()}
    w, speed = Counter(), Counter()
    b = b_speed = 0.0
    step = quality.RATE / max(1.0, sum((v * scale[k]) ** 2 for r in table for k, v in r) / len(table))
    for _ in range(quality.STEPS):
        error = []
        for i, r in zip(drawn, table):
            odds = sum(v * scale[k] * (w[k] + 0.9 * speed[k]) for k, v in r) + b + 0.9 * b_speed
            error.append((p[i] - 1 / (1 + math.exp(-odds))) / len(table))
        push = Counter()
        for e, r in zip(error, table):
            for k, v in r:
                push[k] += e * v * scale[k]
        for k in scale:
            speed[k] = 0.9 * speed[k] + step * (push[k] - quality.DECAY * w[k])
            w[k] += speed[k]
        b_speed = 0.9 * b_speed + step * sum(error)
        b += b_speed
    weight = {k: float(np.float32(w[k] * scale[k])) for k in scale}
    return p, [1 / (1 + math.exp(-(b + sum(v * weight[k] for own in r for k, v in own.items())))) for r in rows]


def mixed_texts(n, seed=4):
    """Some good, some bad ones."""
    rnd = random.Random(seed)
    good = "the of and to in is it that was with over under river stone light house green road".split()
    out = []
    for i in range(n):
        if i % 3:
            out.append(". ".join(" ".join(rnd.choices(good, k=12)) + f" w{i}é" for _ in range(5)) + ".")
        else:
            out.append(" ".join(rnd.choice(["BUY!!!", "$$$", "||", "CLICK", "###", "x"]) for _ in range(30)))
    return out


def test_quality_equals_a_plain_version(spark):
    texts = ["", "a", "two words", *mixed_texts(24), "same\nsame\nsame line\nsame"]
    own = quality.Measured(texts)
    for i, t in enumerate(texts):
        assert np.allclose([own.measures[k][i] for k in own.measures], list(plain_measures(t).values())), t
        assert own.votes()[i].tolist() == plain_votes(plain_measures(t))
    rows = {r.doc_id: r for r in quality.classify(documents(spark, texts)).collect()}
    weak, score = plain_quality(texts)
    assert np.allclose([rows[i].weak for i in range(len(texts))], weak, atol=1e-6)
    assert np.allclose([rows[i].score for i in range(len(texts))], score, atol=1e-5)
    assert [rows[i].good for i in range(3, 27)] == [bool(i % 3) for i in range(24)]


def test_scores_do_not_depend_on_neighbours():
    rnd = random.Random(2)
    texts = ["", "a", prose(rnd, 50), "X!! " * 30, "é" * 40, "line\n" * 9]
    rng = np.random.default_rng(0)
    weights = rng.standard_normal(3 << quality.BITS)
    together = quality.Measured(texts).scores(weights, 0.1)
    assert together.tolist() == [quality.Measured([t]).scores(weights, 0.1)[0] for t in texts]
    assert quality.Measured(texts).votes().tolist() == [quality.Measured([t]).votes()[0].tolist() for t in texts]


def test_quality_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op2_quality(spark, sf).collect()
    own = [(r.good, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([good == bool(label) for good, label in own]) > 0.97
    assert np.mean([good for good, label in own if label]) > 0.97


def test_quality_edge_cases(spark):
    df = documents(spark, [None, "", "   ", "x", prose(random.Random(1), 80), "same", "same"])
    rows = {r.doc_id: r for r in quality.classify(df, keep=["words"]).collect()}
    assert len(rows) == 7 and rows[5].score == rows[6].score and rows[0].score == rows[1].score and rows[3]["words"] == "clash"
    assert quality.classify(df.limit(0)).collect() == []
