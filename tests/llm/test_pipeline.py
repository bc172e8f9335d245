"""The pipeline's stages, one after the other on written tables, against brute force."""

import collections
import math
import random
import re

import pytest

import corpus_pipeline
from tabq.llm import mixing
from test_operators import brute_links, brute_tiles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    vocab = [f"w{k}" for k in range(300)] + ["and", "the", "of"] * 40
    bench = [(k, " ".join(r.choice(vocab) for _ in range(30))) for k in range(4)]
    docs, marks = [], []
    for i in range(260):
        w = [r.choice(vocab) for _ in range(r.randrange(30, 90))]
        kind = r.random()
        good = kind > 0.15
        t = " ".join(w) if good else r.choice([" ".join(x + "$$$" for x in w), " ".join(w).upper() + "!!"])
        if kind > 0.9:
            t = t + " " + bench[i % 4][1]
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        marks.append((i, int(good), 0))
    for i in range(260, 330):  # near and exact copies
        b = docs[r.randrange(260)]
        w = b[1].split(" ")
        if r.random() < 0.6:
            w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w), "en", b[3], len(b[1])))
    docs.append((400, None, "en", None, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d, docs, dict((i, q) for i, q, _ in marks), bench


def test_stages(spark, tables, tmp_path):
    d, docs, good, bench = tables
    frame = spark.read.parquet(f"{d}/documents.parquet")
    text = {i: t for i, t, *_ in docs}
    before = set(text)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, d)
        columns = out.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [x.doc_id for x in out.collect()]
        if name != "sharding":
            assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            assert sum((i in set(ids)) == bool(q) for i, q in good.items()) >= 0.98 * len(good)
        elif name == "near_duplicates":
            found = brute_links([(i, text[i], None) for i in before], 5, 80, 100)
            assert set(ids) == {i for i, (_, c, _) in found.items() if c == i} and len(ids) < len(before)
        elif name == "decontamination":
            w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
            hit = {i for i in before if any(len(set(zip(*[w(b)[j:] for j in range(5)])) & set(zip(*[w(text[i])[j:] for j in range(5)]))) and brute_tiles(w(b), w(text[i])) >= 0.8 * len(w(b)) for _, b in bench)}
            assert hit and set(ids) == before - hit
        elif name == "mixing":
            size, taken = collections.Counter(), collections.Counter()
            source = {i: s for i, _, _, s, _ in docs}
            for i in before:
                size[source[i]] += len((text[i] or "").split())
            for i in ids:
                taken[source[i]] += len((text[i] or "").split())
            want = mixing.targets(dict(size))
            assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in size) and max(collections.Counter(ids).values()) <= 3
        else:
            assert columns[-1] == "shard" and all(0 <= x.shard < 40 for x in out.collect())
        frame, before = out, set(ids)
    ran = corpus_pipeline.run(spark, d).collect()
    assert sorted((x.doc_id, x.shard) for x in ran) == sorted((x.doc_id, x.shard) for x in frame.collect())
    assert math.isclose(len(ran), len(ids))


def odd_documents(spark, d, docs):
    """Repeated rows, rows without an id or text, and columns with the names that the stages use inside."""
    text = {i: t for i, t, *_ in docs}
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in docs[:120]]
    rows += [rows[0], rows[0], (None, text[1], "en", "s1", 1), (None, text[1], "en", "s1", 1), (None, None, None, None, None), (777, "", "en", "s0", 0), (778, None, "en", None, None), (779, "word " * 40_000, "en", "s2", 0)]
    wide = [(*r, "x", 1.5, 7, 8, 9, True) for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, set_key string, score double, mark long, _key long, shard_ long, d boolean"
    return rows, spark.createDataFrame(wide, names).repartition(3)


def test_stages_on_odd_rows_and_columns(spark, tables, tmp_path):
    d, docs, _, bench = tables
    rows, frame = odd_documents(spark, d, docs)
    columns, n = frame.columns, frame.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, d).write.parquet(f"{tmp_path}/odd{k}")
        out = spark.read.parquet(f"{tmp_path}/odd{k}")
        assert out.columns == (columns if name != "sharding" else [*columns, "shard"])
        got = collections.Counter((x.doc_id, x.text) for x in out.collect())
        before = collections.Counter((x.doc_id, x.text) for x in frame.collect())
        if name in ("quality", "decontamination"):  # by text alone: all of a kind stay, or none
            assert all(got[x] in (0, c) for x, c in before.items()) and set(got) <= set(before)
        elif name == "near_duplicates":  # one of repeated rows, but rows without words all stay
            assert all(c == 1 or not (x[1] or "").split() for x, c in got.items())
            assert all(got[x] == c for x, c in before.items() if not (x[1] or "").split() and x[0] is None)
        elif name == "mixing":
            assert max(got.values()) <= 3 * max(before.values()) and set(got) <= set(before)
        else:
            assert got == before
        frame = out


def test_stages_on_empty_tables(spark, tables, tmp_path):
    d, *_ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, d)
        assert out.count() == 0 and out.columns[:5] == none.columns
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{d}/documents.parquet")  # without labels or benchmark every document stays
    assert corpus_pipeline.quality_stage(spark, docs, empty).count() == docs.count() == corpus_pipeline.decontamination_stage(spark, docs, empty).count()
