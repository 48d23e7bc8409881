"""The training-data operators against plain code on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _segments, decontamination, licences, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_counts, topk, warc
from tessera.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, words int"


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 20, 120, 200]))) for _ in range(40)]
    near = texts[3] + " " + passage
    texts += [passage, near, near.replace(words[0], words[1]), near.upper(), "x " + passage + "\n" + passage, "a " * 300, "zz" * 900, "zz" * 700 + "é", "", None, "one", "one", "Hello  World\tfoo", "long " * 5000]
    texts += [" ".join([*w[:5], "changed", *w[6:]]) for w in (t.split() for t in texts[:8] if len(t.split()) > 60)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4 * (i % 3 > 0)}", i, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(3).cache()


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _removed(units, window):
    seen = Counter(hash(tuple(u[i : i + window])) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[hash(tuple(u[i : i + window]))] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(_segments, "HOT", hot)
    units = [WORD.findall(t or "") for t in texts]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, 35, with_text=True).collect()}
    for i, (u, gone) in enumerate(zip(units, _removed(units, 35), strict=True)):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(u), gone.sum(), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r["n_removed"] for r in got.values()) > 100


def test_substring_matches(spark, docs, texts):
    reference = spark.createDataFrame([(texts[40],)], "text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_matches(docs, reference).collect()}
    assert got[40]["n_removed"] == 60 and got[44]["n_removed"] == 120 and got[0]["n_removed"] == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(_segments, "HOT", hot)
    units = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
    for i, (u, gone) in enumerate(zip(units, _removed(units, 400), strict=True)):
        kept = np.frombuffer(u, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(u), gone.sum(), spans)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_column_index_is_a_transform():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 3, n) for n in (5, 1, 9, 9)]
    offsets = np.cumsum([0, *map(len, sequences)])
    symbols = np.concatenate(sequences)
    index = suffix_dedup.ColumnIndex(symbols, offsets)
    owner = np.repeat(np.arange(4), np.diff(offsets))
    suffixes = [symbols[a : offsets[owner[a] + 1]].tolist() for a in index.at]
    assert suffixes == sorted(suffixes) and len(suffixes) == len(symbols)
    assert [b for b in index.bwt] == [-1 if a == offsets[owner[a]] else symbols[a - 1] for a in index.at]
    for most in (2, 9):
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]
        assert index.common(most).tolist() == [min(x, most) for x in shared]


@pytest.mark.parametrize("window", [1, 3, 7, 40])
def test_common_prefixes_decide(window):
    rng = random.Random(window)
    for trial in range(120):
        alphabet = rng.choice(["ab ", "abc  ", "a", "xyzé \n", "abcdefgh "])
        contents = list({"".join(rng.choices(alphabet, k=rng.randint(window, 60 + window))).encode() for _ in range(rng.randint(1, 6))})
        contents = [c for c in contents if len(c) >= window]
        if rng.random() < 0.7:
            contents.append(contents[0][: window + 3] + b"zz" * 50 + contents[-1][-window - 2 :])
        weights = np.array([rng.choice([1, 1, 1, 2]) for _ in contents])
        seen = Counter()
        for c, w in zip(contents, weights, strict=True):
            for i in range(len(c) - window + 1):
                seen[c[i : i + window]] += int(w)
        want = [[seen[c[i : i + window]] > 1 for i in range(len(c) - window + 1)] for c in contents]
        assert [f.tolist() for f in suffix_dedup.repeated(contents, weights, window)] == want


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=8).tolist() for _ in range(300)] + [[1.0] * 8] * 30
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0]), (None, [1.0] * 8), (1000, [1e9] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(table, table["vec_id"] % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any() and len(v) == 8]
    for q, v in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(table.limit(0), table["vec_id"] % 100 == 0).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=3 + i % 2).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(table, table["vec_id"] % 5 == 0, 4).collect()))
    assert len(whole) == 24 * 4
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, topk.top_k(table, table["vec_id"] % 5 == 0, 4).collect())) == whole


def test_top_k_refuses_scores_that_wrap_around(spark):
    table = spark.createDataFrame([(0, [1e9] * 8), (1, [1e9] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of scores"):
        topk.top_k(table, table["vec_id"] == 0)


def test_mixing(docs, texts, empty):
    rows = mixing.mix(docs, block_words=16).collect()
    again = mixing.mix(docs, block_words=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 1
    assert mixing.mix(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, marks = [], []
    for i in range(400):
        text = " ".join(rng.choices(words, k=80))
        bad = i % 3 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        marks.append((i, int(not bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, y in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([p == y for p, y in held]) > 0.95 and len(got) == 402
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    html = ["<p>a</p>", "<p>é\r\n\r\nWARC/1.1</p>", None, "", "<p>a</p>", "x" * 200_000, "<p>a</p>"]
    pages = spark.createDataFrame([(7 - i, f"http://h/{i}" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path, compression=compression)
    got = {int(r["record_id"][10:-1]): r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(7 - j for j, other in enumerate(html) if (other or "") == (h or ""))
        r = got[7 - i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["record_type"] == ("response" if first == 7 - i else "revisit") and r["refers_to"] == (None if first == 7 - i else f"<urn:page:{first}>")
        assert r["target_uri"] == (f"http://h/{i}" if i else None)
        if first == 7 - i:
            assert bytes(r["payload"]) == data
    only = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert only.count() == 3 and only.where("payload is not null").count() == 0
    stored = f"file://{tmp_path}/pages"
    pages.write.parquet(stored)
    warc.archive(spark.read.parquet(stored), f"file://{tmp_path}/v", compression=compression)
    assert sorted(map(tuple, warc.read_warc(spark, f"file://{tmp_path}/v", payload=True).collect())) == sorted(map(tuple, got.values()))
    warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        row = {"record_type": "response", "record_id": f"<urn:page:{i}>", "date": "d", "target_uri": None, "payload_digest": "sha1:A", "refers_to": None, "payload": b"x" * i, "payload_bytes": i}
        (tmp_path / f"{i}.warc").write_bytes(warc.record(row) + warc.record(row | {"record_id": f"<urn:page:{60 + i}>", "record_type": "revisit", "refers_to": f"<urn:page:{i}>"}))
    records = warc.read_warc(spark, f"file://{tmp_path}", payload=True)
    assert records.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 60
    got = records.select(warc.page_of("record_id"), "payload_bytes", "payload", warc.page_of("refers_to")).collect()
    assert sorted((a, b, c and bytes(c), d) for a, b, c, d in got) == sorted([*((i, i, b"x" * i, None) for i in range(60)), *((60 + i, i, None, i) for i in range(60))])


def test_warc_digests_without_python(spark):
    hexes = ["0" * 39 + "1", "f" * 40, *(hashlib.sha1(bytes([i])).hexdigest() for i in range(50))]
    got = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", warc._base32(F.col("h")).alias("d")).collect()
    assert all(r["d"] == base64.b32encode(bytes.fromhex(r["h"])).decode() for r in got) and len(got) == 52


def test_token_counts(docs, texts, empty):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = token_counts.load_pieces()
    least = min(pieces.values())
    model = tokenizers.models.Unigram([("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256)), *pieces.items()], unk_id=0, byte_fallback=True)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, pieces).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert got[i] == (len(words), sum(len(model.tokenize("▁" + w)) for w in words))
    assert token_counts.token_counts(empty, pieces).count() == 0


def test_trie_and_long_words_agree():
    counter = token_counts.Counter(token_counts.load_pieces())
    rng = random.Random(3)
    words = ["".join(rng.choices(["a", "b", "the", "é", "漢", "😀", "\x00", "\ufffd", "%"], k=rng.randint(0, 50))) for _ in range(2000)]
    words = list(dict.fromkeys(words))
    assert counter.counts(words).tolist() == [counter.count_long(w) for w in words]
    assert counter.counts([]).tolist() == [] and counter.counts([""]).tolist() == [0]
    assert token_counts.Counter({}).counts(["a", "é"]).tolist() == [1, 2]
    assert token_counts.Counter({"ab": -1.0, "a": -0.5, "b": -0.5}).counts(["ab", "aab", "c"]).tolist() == [1, 2, 1]


@pytest.mark.parametrize("few, block", [(24, 2048), (0, 2)])
def test_near_dedup(docs, texts, empty, monkeypatch, few, block):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300 * block)
    words = [WORD.findall((t or "").translate(LOW)) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_licences(spark, empty):
    text = "Foo bar. Permission is hereby granted"
    rows = [(0, "A. Released under the MIT License.\nLicensed under CC BY-NC 4.0. B"), (1, None), (2, ""), (3, text), (4, "All rights reserved. All  rights, reserved!"), (5, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `a.b` string, flat int")
    got = {r["doc_id"]: (r["licences"], r["n_known"], r["n_unmatched"]) for r in licences.licence_scan(docs).collect()}
    assert got == {0: ("MIT,CC-BY-NC-4.0", 2, 0), 1: ("", 0, 0), 2: ("", 0, 0), 3: ("", 0, 0), 4: ("", 2, 2), 5: ("Apache-2.0", 3, 0)}
    assert licences.licence_scan(empty).count() == 0
    assert "Python" not in licences.licence_scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[40]), (20, "Hello, world foo!"), (3, None), (4, ""), (100, "one"), (9, " ".join(texts[2].split()[:15])), (9, "absent words here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode())
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, table).collect()}
    for i, t in enumerate(texts):
        words, ids = split(t), []
        hit = np.zeros(len(words), bool)
        for name, item in items:
            w = split(item)
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            at = [k for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in windows]
            for k in at:
                hit[k : k + n] = True
            ids += [str(name)] * bool(at)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), hit.sum(), len(ids), bool(hit.any()))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert decontamination.contamination(empty, table).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(docs, table.limit(0)).collect()} == {0}


def test_proximity(spark):
    rows = decontamination.keyed(spark.createDataFrame([(0, "x b y a z"), (1, "a x x x x x b")], "doc_id long, text string"), "doc_id", "text")
    part = decontamination.Items.parse([(5, "a b")])
    found = decontamination.proximity_matches(decontamination.build_index(rows, part.vocabulary), part, 4).collect()
    assert [(r["item_id"], r["first"], r["last"]) for r in found] == [(5, 1, 3)]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = Q.queries()[name](spark, sf_dir)
    result = db.execute(Q.oracle_sql()[name])
    order = [[c[0] for c in result.description].index(c) for c in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=key)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.count()
    for name, stage in P.STAGES[:-1]:
        before, docs = docs.count(), P.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= before
    assert docs.count() > 0.5 * total
    kept = {r["doc_id"] for r in docs.collect()}
    result = P.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in result} == kept and all(r["taken"] <= 2 * r["size"] for r in result)


def test_pipeline_removes_passages_of_over_50_words(spark, sf_dir):
    import corpus_pipeline as P

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(3000)]
    own = lambda n: " ".join(rng.choices(words, k=n))
    usual, short, brief = own(51), " ".join(rng.choices("abcdefghijklm", k=51)), own(40)
    assert 101 == len(short) < len(usual) < 400 and 101 < len(brief) < 400
    around = [(own(80), own(90)) for _ in range(6)]
    texts = [f"{a} {i}( {t} ){i} {b}" for i, ((a, b), t) in enumerate(zip(around, [usual, usual, short, short, brief, brief], strict=True))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    got = {r["doc_id"]: r["text"] for r in P.suffix_dedup(spark, P.written(docs, "docs"), sf_dir).collect()}
    assert got == {i: f"{a} {i}{'' if i < 4 else f'( {brief} )'}{i} {b}" for i, (a, b) in enumerate(around)}


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one."""


ISC = """Copyright (c) 2021, A. Person <a@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
BSD2 = """Copyright (c) 2003, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_wrapped_licences(spark):
    mark = lambda t, c: "\n".join((c + line).rstrip() for line in t.split("\n"))
    forms = [str, lambda t: mark(t, " * "), lambda t: mark(t, "# "), lambda t: mark(t, "// "), lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split()), lambda t: "Some words before\n" + t.replace("\n\n", "\n")]
    notices = {"MIT": MIT, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("version 3", "version 2"), "AGPL-3.0-or-later": GPL.replace("GNU General", "GNU Affero General"), "LGPL-2.1-or-later": LGPL, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD2, "MPL-2.0": MPL, "ISC": ISC, "Apache-2.0": APACHE}
    cases = [(form(t), name) for name, t in notices.items() for form in forms]
    cases.append(("Redistribution and use in source and binary forms, with or without\n\nmodification", ""))
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_whole_licences(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    names = {k: v for k, v in names.items() if (folder / k).exists()}
    if not names:
        pytest.skip("no licence texts on this machine")
    forms = [str, lambda t: "\n".join(("# " + line).rstrip() for line in t.split("\n")), lambda t: " ".join(t.split())]
    cases = [(form((folder / k).read_text()), v) for k, v in names.items() for form in forms]
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_one_long_text_leaves_the_fit_sample(spark):
    ids = spark.range(60).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    first = ids.first()[0]
    docs = spark.createDataFrame([(i, ("GOOD text %d " % i if i % 2 else "bad!! words %d " % i) * (4000 if i == first else 20)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.quality_scores(docs, labels, fit_bytes=30_000).collect()}) > 1
    assert quality.fitting([9, 2, 3, 2, 1], [0, 0, 1, 0, 0], 8) == [False, True, True, True, False]


def test_proximity_gives_every_minimal_stretch(spark):
    rng = random.Random(6)
    texts = ["x b y a z z z z a b", "a a b", *(" ".join(rng.choices("abcx", k=40)) for _ in range(3))]
    rows = decontamination.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text")
    part = decontamination.Items.parse([(5, "a b"), (6, "c a b")])
    found = decontamination.proximity_matches(decontamination.build_index(rows, part.vocabulary), part, 5).collect()
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        for item, terms in ((5, {"a", "b"}), (6, {"a", "b", "c"})):
            full = [(f, e) for f in range(len(w)) for e in range(f, min(f + 5, len(w))) if terms <= set(w[f : e + 1])]
            want += [(i, item, f, e) for f, e in full if not any(f <= g and h <= e and (g, h) != (f, e) for g, h in full)]
    ids = {r["_row"]: r["doc_id"] for r in rows.collect()}
    assert sorted((ids[r["_row"]], r["item_id"], r["first"], r["last"]) for r in found) == sorted(want)
    assert [(f, e) for i, item, f, e in want if (i, item) == (0, 5)] == [(1, 3), (8, 9)]
