"""The pipeline's stages against plain code, and inputs that may upset any operator."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import decontamination, licences, near_dedup, quality, substring_dedup, suffix_dedup, token_counts
from tessera.llm._store import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, `a b` int, `a.b` string, score double, spans string"


def _texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]
    own = lambda n: " ".join(rng.choices(words, k=n))
    passage, brief, leak = own(58), own(30), own(14)
    base = own(150)
    texts = [own(rng.choice([4, 60, 140])) for _ in range(30)]
    texts += [base, base, base.replace(" ", "  ", 3) + " end", " ".join(w if i % 40 else "new" for i, w in enumerate(base.split()))]
    texts += [f"{own(40)} {i}( {passage} ){i} {own(30)}" for i in range(3)] + [f"{own(30)} {brief} {own(20)}" for _ in range(2)]
    texts += [f"{own(20)} {leak} {own(20)}", leak.upper(), passage, "", None, "é" * 700, "é" * 700 + "x", "one", "one", "long " * 3000]
    texts += [t.upper().replace(" ", "!! ") for t in texts[:12]]
    return texts, leak


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts, leak = _texts()
    rows = [(i if i != 5 else None, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t) if t else None, "own", i, "x.y", 0.5, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i < len(texts) - 12)) for i in range(len(texts)) if texts[i]]
    spark.createDataFrame(marks, "doc_id long, quality int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    items = [(1, leak), (2, "short item"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _stage(spark, folder, name, docs):
    out = written(dict(P.STAGES)[name](spark, docs, folder), name)
    if name != "source_mix":
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all(r["_row"] == "own" and r["a.b"] == "x.y" and r["spans"] is None for r in out.collect())
    return out


def _by_row(df):
    return {r["a b"]: r["text"] for r in df.collect()}


def _covered(units, window):
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def test_stages_against_plain_code(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # Quality: the model's scores of each text by itself.
    model = quality.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    have = _by_row(docs)
    scores = dict(zip(have, model.scores([(t or "").encode() for t in have.values()], model.compressors() if model.good else ()), strict=True))
    first = _stage(spark, folder, "quality_classifier", docs)
    assert _by_row(first) == {i: t for i, t in have.items() if scores[i] >= P.ACCEPT} or not model.good

    # Near duplicates, on all documents: components of links at 0.75, the smallest id of each stays.
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["a b"]))
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    second = _stage(spark, folder, "near_dedup", docs)
    assert Counter(_by_row(second).values()) == Counter(r["text"] for i, r in enumerate(rows) if find(i) == i)

    # Repeated strings: covered by a repeated 101-byte string, in runs of 400 bytes or 51 whole words.
    have = _by_row(docs)
    units = [(t or "").encode() for t in have.values()]
    want = {}
    for (i, t), u, gone in zip(have.items(), units, _covered(units, 101), strict=True):
        kept, at = bytearray(), 0
        while at < len(u):
            end = at
            while end < len(u) and gone[end] == gone[at]:
                end += 1
            inner = u[at:end]
            whole = sum(1 for m in re.finditer(rb"[^\x20\x09-\x0D]+", u) if at <= m.start() and m.end() <= end)
            if not gone[at] or (len(inner) < 400 and whole < P.PASSAGE_WORDS):
                kept += inner
            at = end
        if kept or not u:
            want[i] = None if t is None else kept.decode("utf-8", "ignore")
    third = _stage(spark, folder, "suffix_dedup", docs)
    assert _by_row(third) == want and len(want) < len(have) and any(want[i] != have[i] for i in want)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] else r["n_chars"]) for r in third.collect())

    # Contamination: no window of ten words, or of a whole shorter item.
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode())
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    fourth = _stage(spark, folder, "decontaminate", docs)
    assert _by_row(fourth) == {i: t for i, t in have.items() if not hit(split(t))} and len(have) - fourth.count() == 2

    # The mix: whole and empty tables.
    mixed = _stage(spark, folder, "source_mix", docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in have.items()}
    assert len(mixed) == len(have) and sum(r["size"] for r in mixed) == sum(size.values())
    assert all(r["taken"] <= 2 * r["size"] for r in mixed)


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, _ in P.STAGES:
        docs = _stage(spark, folder, name, docs)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, P.run(spark, folder).collect()), key=key) == sorted(map(tuple, docs.collect()), key=key)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_tables(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert dict(P.STAGES)[name](spark, written(docs, "none"), folder).count() == 0


OPERATORS = {
    "op1": lambda d, f: substring_dedup.remove_repeats(d),
    "op4": lambda d, f: quality.quality_scores(d, f("labels")),
    "op6": lambda d, f: token_counts.token_counts(d, token_counts.load_pieces()),
    "op7": lambda d, f: near_dedup.near_duplicates(d).drop("_row"),
    "op8": lambda d, f: licences.licence_scan(d),
    "op9": lambda d, f: decontamination.contamination(d, f("benchmark")).drop("_row"),
    "op10": lambda d, f: suffix_dedup.remove_repeated_bytes(d),
}


@pytest.mark.parametrize("name", ["op1", "op7", "op9", "op10"])
def test_results_stay_when_partitions_change(spark, folder, name):
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    key = lambda r: tuple(map(str, r))
    results = []
    try:
        for before, after in ((2, 2), (2, 16), (16, 1)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
            spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << (27 if before < 9 else 12))
            lazy = OPERATORS[name](table("documents"), table)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", after)
            spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << (27 if after < 9 else 12))
            results.append(sorted(map(tuple, lazy.collect()), key=key))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] == results[2] and len(results[0]) == table("documents").count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_input(spark, folder, name):
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    assert OPERATORS[name](written(table("documents").limit(0), "none"), table).count() == 0


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """Tables of a few hundred rows take two files a core at most, however many partitions a shuffle has.

    Not so the links: their tasks compare texts, and keep the partitions.
    """
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij", k=40)) for _ in range(60)]
    texts += [" ".join(["new", *t.split()[1:]]) for t in texts[:40]] + texts[:10]
    files = {}

    def counted(df, name, *sizes):
        out = written(df, name, *sizes)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i if i < 60 else i - 60 if i < 100 else i - 100 for i in range(len(texts))}
    small = {"sets", "members", "pairs", "edges", "components", "active", "least"}
    assert small <= files.keys()
    assert max(files[name] for name in small) <= 2 * spark.sparkContext.defaultParallelism, files
