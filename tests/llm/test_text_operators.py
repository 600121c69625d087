"""Encoding, filters, licences, token files and search: against the libraries and brute force, with edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tidemark.llm")

from tidemark.llm import bpe, licences, token_files, top_k, url_filter  # noqa: E402

TEXTS = [None, "", "   ", "Hello  world, it's we'll 're \n\n\t x", "né　漢字 1234 ½ \x1c\x85\xa0'S 'tis", "a" * 5000 + " b", "'" * 7 + "ll'd've'm", "<|endoftext|> in a text", "same text", "same text"]
SCHEMA = "doc_id long, text string, ids string, _text string, shard int"


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([Row(doc_id=i if i != 3 else None, text=t, ids="clash", _text="clash", shard=7) for i, t in enumerate(texts)], SCHEMA)


def test_boundaries_and_ids_match_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.codec(bpe.default_path())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(1)
    parts = [*"ab'stmdrvel  \n\t 12.!'é　\x1c\x85\xa0中½²", "'s", "'re", "'ll", "  "]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(5000)] + ["x" * 3000, " " * 500 + "a", "\n" * 300]
    assert own.encode(texts) == [other.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, own.encode(texts)):
        assert own.decode(ids) == t.encode()
        assert own.offsets(ids)[-1] == len(t.encode())


def test_scan_is_that_of_single_steps():
    rng = np.random.default_rng(0)
    of_class, _, table, _ = bpe.monoid()
    kinds = rng.integers(0, 11, 5000)
    state, want = bpe.FRESH, []
    for k in kinds.tolist():
        state = bpe.step(state, k)[0]
        want.append(state)
    assert table[bpe.scanned(of_class[kinds]), bpe.FRESH].tolist() == want


def test_table_of_pieces_keeps_slices_apart_when_places_collide(monkeypatch):
    monkeypatch.setattr(bpe.Table, "places", lambda self, words: np.zeros(len(words), np.int64))
    data = b"abcabdabcxyz" + b"q" * 32 + b"q" * 31 + bytes(3)
    begin = np.array([0, 3, 6, 9, 12, 44, 75, 75, 12])
    end = np.array([3, 6, 9, 12, 44, 75, 77, 78, 12])
    slices = [data[a:b] for a, b in zip(begin, end)]
    table = bpe.Table()
    words = table.rows(data, begin, end - begin)
    first, kind = bpe.unlike(words)
    assert len(first) == len(set(slices)) and [slices[first[k]] for k in kind] == slices
    assert (table.find(words) == -1).all()
    slots = table.add(words[first], first.astype(np.int32), np.ones(len(first), np.int64))
    assert table.find(words).tolist() == slots[kind].tolist()
    assert [table.flat[table.begin[s]] for s in table.find(words)] == first[kind].tolist()


def test_batched_merges_are_those_of_single_pieces():
    own = bpe.codec(bpe.default_path())
    rnd = random.Random(2)
    pieces = [bytes(rnd.choices(b"abcdeinorst \xc3\xa9\xff01", k=rnd.randint(1, 32))) for _ in range(3000)] + [b"a" * n for n in range(1, 33)]
    ids, count = own.encode_pieces(pieces)
    cuts = np.concatenate([[0], np.cumsum(count)]).tolist()
    assert [tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(cuts)] == [own.merged(p) for p in pieces]


def test_bpe_frames(spark):
    df = documents(spark)
    own = bpe.codec(bpe.default_path())
    rows = bpe.digests(df).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((hashlib.sha256(",".join(map(str, own.encode([t or ""])[0])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in TEXTS)
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in TEXTS)
    assert bpe.digests(df.limit(0)).collect() == []


def test_token_files(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    where = f"file://{tmp_path}/tokens"
    token_files.write(documents(spark), where)
    rows = sorted(token_files.checksums(token_files.read(spark, where)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = [3, *(i for i in range(len(TEXTS)) if i != 3)]
    start = 0
    for i, r in zip(order, rows, strict=True):
        ids = [*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, token_files.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = f"file://{tmp_path}/empty"
    token_files.write(documents(spark).limit(0), empty)
    assert token_files.checksums(token_files.read(spark, empty)).collect() == []


def like(glob: str, text: str) -> bool:
    """Whether a glob of `*` alone fits, by dynamic programming."""
    fits = [True] + [False] * len(text)
    for c in glob:
        fits = list(itertools.accumulate(fits, lambda a, b: a or b)) if c == "*" else [False, *(f and c == t for f, t in zip(fits, text))]
    return fits[-1]


def test_globs():
    rnd = random.Random(2)
    globs = ["".join(rnd.choices("ab.*", k=rnd.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rnd.choices("ab.", k=rnd.randint(0, 12))) for _ in range(300)]
    got = url_filter.Globs(globs).match([np.frombuffer(t.encode(), np.uint8).astype(np.uint16) for t in texts])
    assert got.tolist() == [[like(g, t) for g in globs] for t in texts]


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "http://example.com/EN/", "http://x.net/es/a#b", "http://xnet/es/", "ftp://net/fr/", "http://b.com", "http://b.com/", "no scheme", None, "", "http://evil.org/x.com/", "https://spam-farm.org", "http://a.org/casino", "http://ü.com/ß", "http://example.com/en/"]
    df = spark.createDataFrame([Row(page_id=i, url=u, html="x", host="clash", rule="clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "/EN/", "com/", "allow")
    assert got[3][2:] == ("net/es/", "block")
    assert got[4] == ("xnet", "/es/", None, "allow")
    assert got[5][2:] == ("net/fr/", "block")
    assert got[6] == ("b.com", "", None, "allow")
    assert got[7][2:] == ("com/", "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11][2] is None
    assert got[12][3] == got[13][3] == "block"
    assert got[14] == ("ü.com", "/ß", "com/", "allow")
    assert url_filter.judge(df.limit(0)).collect() == []


def test_licences(spark):
    texts = [None, "", "Some prose. RELEASED!! UNDER!! THE!! MIT!! LICENSE.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "All rights reserved.\nLicensed under CC BY-NC 4.0.", "released under the mit license and more words", "x. " * 3000 + "Released*** under&&& the%%% MIT### License.$$$"]
    df = spark.createDataFrame([Row(doc_id=i, text=t, sequence="clash", licences="clash") for i, t in enumerate(texts)], "doc_id long, text string, sequence string, licences string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].licences for i in range(7)] == ["", "", "MIT", "Apache-2.0", "CC-BY-NC-4.0,Proprietary", "", "MIT"]
    assert got[3].sequence == "".join(f"<{i}>" for n in ("apache_short", "apache_use", "apache_warranty") for i in licences.OF_NOTICE[n]) and got[4].kind == "restricted" and got[0].kind == "none" and got[0].n_sentences == 0
    assert licences.scan(df.limit(0)).collect() == []


def test_whole_licences_wrapped_and_in_comments(spark):
    import textwrap

    mit = ["MIT License", "Copyright (c) 2020 Some Body", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.']
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    names = ["3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    apache = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.']
    wanted = {"MIT": mit, "BSD-2-Clause": bsd, "BSD-3-Clause": bsd + names, "GPL-2.0-or-later": [gpl], "MPL-2.0": [mpl], "ISC": [isc], "Apache-2.0": apache}
    rows, want = [], {}
    for name, parts in wanted.items():
        for width in (58, 72, 80):
            for mark in ("", " * ", "# ", "// "):
                lines = "\n\n".join(textwrap.fill(p, width) for p in parts).split("\n")
                head = "/*\n" if mark == " * " else ""
                want[len(rows)] = name
                rows.append(head + "".join((mark + x).rstrip() + "\n" for x in lines) + ("*/\n" if head else "") + "\nint main() { return 0; }")
    # a notice on a line of its own among lines without an end
    want[len(rows)] = "CC-BY-4.0"
    rows.append("some heading without a stop\nLicensed under CC BY 4.0\nand a text that goes on")
    want[len(rows)] = ""
    rows.append(f"{gpl[:100]}, or so it was said of the GNU licence.\r\n\r\nNothing else")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(df).collect()} == want


def test_files_have_indexes_filters_and_run_lengths(spark, tmp_path):
    """What the ORC footers say, and a read of one document that leaves the other stripes out."""
    import pyarrow.orc as orc

    to = f"{tmp_path}/ids"
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("alpha beta gamma delta".split(), k=200)) for _ in range(6000)]
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    token_files.write(df, f"file://{to}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    import glob

    files = sorted(glob.glob(f"{to}/*.orc"))
    assert len(files) > 1
    first = []
    for name in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{name}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.STRIDE and reader.getCompressionKind().toString() == "ZSTD"
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0)) if hasattr(rows, "readStripeFooter") else None
        if footer is not None:
            kinds = [footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())]
            assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
            # integers in the second run-length encoding
            assert {footer.getColumns(i).getKind().toString() for i in range(1, footer.getColumnsCount())} == {"DIRECT_V2"}
        ids = orc.ORCFile(name).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        first.append(ids[0])
    assert first == sorted(first)
    assert spark.read.orc(f"file://{to}").where("doc_id = 3001").count() == 0  # odd: within the range, ruled out by the filter
    assert spark.read.orc(f"file://{to}").where("doc_id = 3000").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3000)]" in spark.read.orc(f"file://{to}").where("doc_id = 3000")._jdf.queryExecution().toString()


def test_written_paths_are_cleared(spark, tmp_path):
    from tidemark.llm import common

    df = common.stored(spark.range(3))
    assert df.count() == 3 and common.WRITTEN
    assert common.cleared(spark) > 0 and not common.WRITTEN


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-6, 7, (700, 5))
    vectors[100:160] = vectors[99]
    rows = [Row(vec_id=i, embedding=[float(x) / 64 for x in v], label=1, rank=9, score=9) for i, v in enumerate(vectors)]
    rows += [Row(vec_id=1000, embedding=None, label=1, rank=9, score=9), Row(vec_id=1020, embedding=[1.0, None, 0.0, 0.0, 0.0], label=1, rank=9, score=9), Row(vec_id=1040, embedding=[float("nan")] * 5, label=1, rank=9, score=9), Row(vec_id=1060, embedding=[float("inf")] * 5, label=1, rank=9, score=9)]
    # rows without an id, and rows that stand there twice, queries among them
    rows += [Row(vec_id=None, embedding=[1.0] * 5, label=1, rank=9, score=9), rows[7], rows[40], rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, score int")
    own = top_k.scaled(df)
    kept = [(r.vec_id, np.floor(np.array(r.embedding) * 64)) for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()]
    want = []
    for q, (name, x) in enumerate(kept):
        if name is not None and name % 20 == 0:
            order = sorted((i for i in range(len(kept)) if i != q), key=lambda i: (-(kept[i][1] @ x), kept[i][0] is None, kept[i][0] or 0))[:20]
            want += [(name, k + 1, kept[i][0], int(kept[i][1] @ x)) for k, i in enumerate(order)]
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3])
    asks = F.col("vec_id") % 20 == 0
    for sizes in ((top_k.CANDIDATES, top_k.QUERIES, top_k.LEAST_QUERIES), (90, 11, 1)):
        for name, n in zip(("CANDIDATES", "QUERIES", "LEAST_QUERIES"), sizes):
            monkeypatch.setattr(top_k, name, n)
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k.search(own, asks).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[0] == 40 for r in got) == 60 and any(r[2] is None for r in got)
    empty = own.limit(0)
    assert top_k.search(empty, asks).collect() == []
    assert top_k.search(own, F.lit(False)).collect() == []


def test_lists_stop_early_and_agree(monkeypatch):
    rng = np.random.default_rng(5)
    rows = np.floor(rng.standard_normal((4000, 3)) * 40)
    lists = top_k.Lists(np.arange(4000), rows)
    for q in (rows[5], np.zeros(3), np.array([7.0, 0, -3])):
        scores, ids = lists.search(q, 5, (np.zeros(0), np.zeros(0, np.int64)), 20)
        exact = rows @ q
        order = sorted((i for i in range(4000) if i != 5), key=lambda i: (-exact[i], i))[:20]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()
