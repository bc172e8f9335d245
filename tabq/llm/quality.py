"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Pairs of a good and a bad training document give
feature differences; logistic loss on them gives the weights. A score quantile of all labelled training documents, set by
the share of bad ones, is the threshold, and scores are squashed so that it lies at 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, held_out, lean, slices, table, words
from .sampling import labelled_ids, labelled_sample

MODULUS, REMAINDER = 3, 1
#: Bounds of the fit: training documents a class, pairs, steps.
PER_CLASS, PAIRS, L2 = 4000, 40_000, 1e-3
#: The threshold may lie so far from the quantile.
SLACK = 0.01
SEED = "quality-1"

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 usual stops, 6 symbols, 7 beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7
N_FEATURES = 31


def _bins(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    """The value clipped to the outer edges, and how far each bin is filled: a piecewise linear function's basis."""
    e = np.asarray(edges)
    return np.clip((x[:, None] - e[:-1]) / np.diff(e), 0, 1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers in 0..1 for each text (null: as empty)."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    counts = np.bincount(owner * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(float)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 7], 1)
    black = np.maximum(lengths - counts[:, 4], 1)
    lines = np.bincount(owner[raw == 10], minlength=n) + 1.0
    ends, ids, vocabulary = words(texts)
    n_words = np.diff(ends)
    some = np.maximum(n_words, 1)
    who = np.repeat(np.arange(n), n_words)
    width = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    mean_width = np.bincount(who, width, n) / some
    short = np.bincount(who[width <= 4], minlength=n) / some
    bare = ~pc.match_substring_regex(vocabulary, "[0-9a-z]|[^\\x00-\\x7f]").to_numpy(zero_copy_only=False).astype(bool)
    no_letters = np.bincount(who[bare[ids]], minlength=n) / some if len(ids) else np.zeros(n)
    pairs = np.unique(who * np.int64(max(1, len(vocabulary))) + ids)
    distinct = np.bincount(pairs // max(1, len(vocabulary)), minlength=n)
    same = (ids[1:] == ids[:-1]) & (who[1:] == who[:-1]) if len(ids) > 1 else np.zeros(0, bool)
    stutter = np.bincount(who[1:][same], minlength=n) / some if len(ids) > 1 else np.zeros(n)
    # word pairs that came before in the same text: repeated lines and sentences
    if len(ids) > 1:
        inside = who[1:] == who[:-1]
        two = np.stack([who[1:][inside], ids[:-1][inside] * np.int64(len(vocabulary)) + ids[1:][inside]])
        order = np.lexsort((two[1], two[0]))
        two = two[:, order]
        again = (two[0, 1:] == two[0, :-1]) & (two[1, 1:] == two[1, :-1])
        repeated = np.bincount(two[0, 1:][again], minlength=n) / some
    else:
        repeated = np.zeros(n)
    share = lambda k, of: counts[:, k] / of
    symbols = share(6, black)
    parts = [
        _bins(symbols, (0, 0.01, 0.05, 0.15, 0.4)),
        _bins(share(2, letters), (0, 0.05, 0.15, 0.5, 1)),
        _bins(no_letters, (0, 0.02, 0.1, 0.3)),
        _bins(mean_width, (0, 3.5, 5, 7, 12)),
        _bins(short, (0, 0.15, 0.35, 0.6)),
        _bins(distinct / some, (0, 0.2, 0.5, 0.8, 1)),
        _bins(stutter, (0, 0.02, 0.1, 0.5)),
        _bins(repeated, (0, 0.05, 0.2, 0.6)),
        _bins(share(3, black), (0, 0.02, 0.2))[:, :2],
        _bins(np.log1p(some / lines), (0, 3, 6))[:, :1],
    ]
    return np.concatenate(parts, axis=1)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("y"), pa.array(list(features(s.column("text"))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def bradley_terry(good: np.ndarray, bad: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights that rank `good` rows over `bad` ones: logistic loss on differences of PAIRS random pairs, by Newton steps with L2."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + L2 * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _strengths(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(features(s.column("text")) @ w)], ["doc_id", "s"])

    return run


def threshold(docs: DataFrame, y: DataFrame, train: Column, w: np.ndarray) -> float:
    """The quantile of all training rows' strengths at their share of bad ones, at the widest gap within SLACK of it.

    Texts are not shuffled, only strengths; the driver sees a row a partition. There are rows of both classes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull()).filter(train)
    scored = texts.mapInArrow(lean(_strengths(w)), "doc_id long, s double").join(y, "doc_id").select("s", "y")
    place = F.monotonically_increasing_id()  # of a sorted frame: the partition above bit 33, the row in it below
    ranked = checkpointed(scored.sort("s")).withColumn("place", place)
    ranked = ranked.select("s", "y", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    parts = sorted(ranked.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect())
    n = sum(r.n for r in parts)
    share = sum(r.good for r in parts) / n
    lo, hi = (min(n - 2, max(0, math.ceil(q * n) - 1)) for q in (max(0, 1 - share - SLACK), min(1, 1 - share + SLACK)))
    starts = docs.sparkSession.createDataFrame([(r.part, sum(p.n for p in parts[:k])) for k, r in enumerate(parts)], "part int, start long")
    near = ranked.join(F.broadcast(starts), "part").select("s", (F.col("start") + F.col("at")).alias("rank")).filter(F.col("rank").between(lo, hi + 1))
    after = near.select(F.col("s").alias("t"), (F.col("rank") - 1).alias("rank"))
    best = near.join(after, "rank").agg(F.max(F.struct((F.col("t") - F.col("s")).alias("gap"), (-F.col("rank")).alias("k"), ((F.col("s") + F.col("t")) / 2).alias("cut"))).alias("b")).first()
    return float(best.b.cut)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """weights and scale from a sample, threshold from all training rows; a labelled class that is missing gives a model that scores all alike."""
    train = F.coalesce(~held_out("doc_id", MODULUS, REMAINDER), F.lit(True))
    sample, _ = labelled_sample(docs, labels, "quality", train, per_class, SEED)
    rows = sample.mapInArrow(lean(_collected), "doc_id long, y int, x array<double>").collect()  # at most 2 * per_class rows of N_FEATURES numbers
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x, y = np.array([r.x for r in rows]).reshape(len(rows), N_FEATURES), np.array([r.y for r in rows])
    if not len(rows) or y.min() == y.max():
        return {"w": None, "cut": 0.0, "scale": 1.0, "flat": float(y[0]) if len(rows) else 1.0}
    w = bradley_terry(x[y == 1], x[y == 0])
    s = x @ w
    cut = threshold(docs, labelled_ids(labels, "quality", train), train, w)
    return {"w": w, "cut": cut, "scale": float(max(1e-6, np.median(np.abs(s - cut)) / 2)), "flat": 1.0}


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                if model["w"] is None:
                    p = np.full(s.num_rows, model["flat"])
                else:
                    z = (features(s.column("text")) @ model["w"] - model["cut"]) / model["scale"]
                    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([*[c for c, name in zip(s.columns, s.schema.names) if name != "text"], pa.array(p)], [*[x for x in s.schema.names if x != "text"], "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null texts score as empty ones. Only `doc_id` and `text` are read of the documents and only training labels of
    the labels; neither lang, source nor ids are inputs of a score. Equal texts score alike. An empty table gives no
    rows; with no training labels, or one class, every text gets that class's value.
    """
    model = fit(docs, labels)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lean(_scores(model)), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(model: dict, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, column):
                if model["w"] is None:
                    keep = np.full(s.num_rows, model["flat"] >= 0.5)
                else:
                    keep = features(s.column(column)) @ model["w"] >= model["cut"]
                yield s.filter(pa.array(keep))

    return run


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose score is 0.5 or more (see `quality_scores`).

    Null texts are judged as empty ones; equal texts and repeated rows stay or go alike, rows without an id too; no other
    column is read, whatever its name. With no training labels every row stays, with bad ones only none does. An empty
    table stays empty.
    """
    return docs.mapInArrow(lean(_kept(fit(docs, labels), "text")), docs.schema)


def op6_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
