"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of SEED_WORDS words are paired; each pair is tiled by running
Karp-Rabin: the longest matches of still unmarked words are marked first, then shorter ones down to the seed length.
The share of an item's words under tiles is its coverage, whatever the order of the tiles in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, lean, mixed, slices, stored, table

SEED_WORDS, COVERAGE = 5, 0.8
#: Benchmark text indexed and broadcast at once; a larger benchmark is taken in chunks, each against all documents.
CHUNK_BYTES = 32 << 20
SPLIT = r"[^\p{L}\p{N}]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = np.uint64(1)
    return np.cumprod(out, dtype=np.uint64)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-cased runs of letters and digits: offsets by text and the flat words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), SPLIT)
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        owner = np.repeat(np.arange(len(lengths)), lengths)[~empty]
        lengths = np.bincount(owner, minlength=len(lengths))
        flat = flat.filter(pa.array(~empty))
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), flat


class Rolling:
    """Karp-Rabin hashes of every window of a sequence, from prefix sums modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * _powers(self.n, _BASE)[: self.n], dtype=np.uint64)])
        self._inverse = _powers(self.n, _INVERSE)

    def windows(self, s: int) -> np.ndarray:
        return (self._sums[s:] - self._sums[: self.n - s + 1]) * self._inverse[: self.n - s + 1] if s <= self.n else np.empty(0, np.uint64)


    def equal_run(self, i: np.ndarray, other: "Rolling", j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those of `other` from j on, up to `most`: a binary search over hashes."""
        lo, hi = np.zeros(len(i), np.int64), most.copy()
        while (lo < hi).any():
            n = (lo + hi + 1) // 2
            same = (self._sums[i + n] - self._sums[i]) * self._inverse[i] == (other._sums[j + n] - other._sums[j]) * other._inverse[j]
            lo, hi = np.where(same, n, lo), np.where(same, hi, n - 1)
        return lo


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """Whether each window of length s has no marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[s:] == sums[: len(marked) - s + 1]


def _before(x: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The word before each place; -1 at the start and after a marked word."""
    out = np.full(len(x), -1, np.int64)
    out[1:] = np.where(marked[:-1], -1, x[:-1])
    return out


def _to_next_mark(marked: np.ndarray) -> np.ndarray:
    ends = np.append(np.flatnonzero(marked), len(marked))
    return ends[np.searchsorted(ends, np.arange(len(marked)))] - np.arange(len(marked))


def _starts(ia: np.ndarray, ha: np.ndarray, before_a: np.ndarray, ib: np.ndarray, hb: np.ndarray, before_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal windows that no equal word precedes, so that each match is met at its beginning only."""
    a, b = ia[np.argsort(ha[ia], kind="stable")], ib[np.argsort(hb[ib], kind="stable")]
    ua, sa, ca = np.unique(ha[a], return_index=True, return_counts=True)
    ub, sb, cb = np.unique(hb[b], return_index=True, return_counts=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    one = (ca[x] == 1) & (cb[y] == 1)
    i, j = a[sa[x[one]]], b[sb[y[one]]]
    keep = (before_a[i] != before_b[j]) | (before_a[i] == -1)
    left, right = [i[keep]], [j[keep]]
    for p, q in zip(x[~one], y[~one]):
        mine, theirs = a[sa[p] : sa[p] + ca[p]], b[sb[q] : sb[q] + cb[q]]
        for w in np.unique(before_a[mine]):
            i = mine[before_a[mine] == w]
            j = theirs if w == -1 else theirs[before_b[theirs] != w]
            left.append(np.repeat(i, len(j)))
            right.append(np.tile(j, len(i)))
    return np.concatenate(left), np.concatenate(right)


def tiles(a: np.ndarray, b: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the greedy tiles of at least `least` words; a is the shorter, tiled one."""
    a_rolling, b_rolling = Rolling(a), Rolling(b)
    a_marked, b_marked = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out, s = [], max(least, min(len(a), len(b)))
    while s >= least:
        ha, hb = a_rolling.windows(s), b_rolling.windows(s)
        ia = np.flatnonzero(_free(a_marked, s)) if len(ha) else np.empty(0, np.int64)
        ib = np.flatnonzero(_free(b_marked, s)) if len(hb) else np.empty(0, np.int64)
        if len(ia) and len(ib):
            i, j = _starts(ia, ha, _before(a, a_marked), ib, hb, _before(b, b_marked))
            n = a_rolling.equal_run(i, b_rolling, j, np.minimum(_to_next_mark(a_marked)[i], _to_next_mark(b_marked)[j]))
            longest = int(n.max(initial=0))
            if longest >= 2 * s:
                s = longest
                continue
            skipped, last = False, 0
            for k in np.lexsort((j, i, -n)):  # the longest first
                x, y, m = int(i[k]), int(j[k]), int(n[k])
                if skipped and m < last:
                    break  # what is left of an overlapped match may be longer
                last = m
                if a_marked[x : x + m].any() or b_marked[y : y + m].any():
                    skipped = True
                elif np.array_equal(a[x : x + m], b[y : y + m]):
                    a_marked[x : x + m] = True
                    b_marked[y : y + m] = True
                    out.append((x, y, m))
            if skipped:
                continue
            if a_marked.all():
                break
        s = s // 2 if s > 2 * least else least if s > least else 0
    return out


class Index:
    """Seeds of a chunk of benchmark items: every SEED_WORDS words, or a shorter item as a whole. Items without words are never found."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.item_ids = [i for i, _ in items]
        ends, flat = plain_words(pa.array([t for _, t in items], pa.string()))
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
        #: by seed length: sorted seeds and the items that have them
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, t in enumerate(self.texts):
            if len(t):
                n = min(SEED_WORDS, len(t))
                h = _seeds(t, n)
                found.setdefault(n, []).append((h, np.full(len(h), k)))
        for n, parts in found.items():
            seeds, owner = (np.concatenate(x) for x in zip(*parts))
            pairs = np.unique(np.stack([seeds, owner.astype(np.uint64)]), axis=1)
            self.seeds[n] = pairs[0], pairs[1].astype(np.int64)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a seed with a text given in this vocabulary (-1: not in it)."""
        run = np.concatenate([[0], np.cumsum(ids >= 0)])
        out = [np.empty(0, np.int64)]
        for n, (seeds, owner) in self.seeds.items():
            at = np.flatnonzero(run[n:] - run[:-n] == n) if len(ids) >= n else np.empty(0, np.int64)
            if len(at):
                h = np.unique(_hash_rows(np.stack([ids[at + k] for k in range(n)])))
                lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
                out += [owner[x:z] for x, z in zip(lo[hi > lo], hi[hi > lo])]
        return np.unique(np.concatenate(out))


def _hash_rows(columns: np.ndarray) -> np.ndarray:
    h = np.zeros(columns.shape[1], np.uint64)
    for c in columns:
        h = mixed(h * GOLDEN + c.astype(np.uint64) + np.uint64(1))
    return h


def _seeds(ids: np.ndarray, n: int) -> np.ndarray:
    return _hash_rows(np.stack([ids[k : len(ids) - n + 1 + k] for k in range(n)]))


def found_in(index: Index, texts: pa.Array) -> Iterator[list[tuple[int, float]]]:
    """For each text the (item number, coverage) of the items that share a seed with it."""
    ends, flat = plain_words(texts)
    coded = flat.dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    for a, b in zip(ends[:-1], ends[1:]):
        doc = ids[a:b]
        out = []
        for k in index.candidates(doc):
            item = index.texts[k]
            # words that the item lacks match nothing; each gets a number of its own below zero
            own = np.where(np.isin(doc, item), doc, -2 - np.arange(len(doc)))
            out.append((int(k), sum(n for _, _, n in tiles(item, own, min(SEED_WORDS, len(item)))) / len(item)))
        yield out


def benchmark_chunks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most about CHUNK_BYTES of benchmark text each; null texts are left out, equal ids and those without an id kept apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL")
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.t) > CHUNK_BYTES:
            yield Index(held)
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    if held:
        yield Index(held)


def _matches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for s in slices(b):
                found = list(found_in(ix, s.column("text")))
                rank = lambda x: (x[1], (i := ix.item_ids[x[0]]) is not None, -(i or 0))
                best = [max(f, key=rank, default=None) for f in found]
                over = [sorted({ix.item_ids[k] for k, c in f if c >= COVERAGE} - {None}) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c for c, name in zip(s.columns, s.schema.names) if name != "text"],
                        pa.array([bool(x) and x[1] >= COVERAGE for x in best], pa.bool_()),
                        pa.array([x[1] if x else 0.0 for x in best], pa.float64()),
                        pa.array([ix.item_ids[x[0]] if x else None for x in best], pa.int64()),
                        pa.array(over, pa.list_(pa.int64())),
                    ],
                    [*[x for x in s.schema.names if x != "text"], "contaminated", "coverage", "best_item", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, coverage, best_item, items for each row.

    A text is contaminated if COVERAGE or more of the words of a benchmark item lie under tiles; `items` lists those
    items, coverage and best_item are the largest (ties: the smallest item_id). Items of under SEED_WORDS words are sought
    as a whole; items without an id contaminate, but are not listed. Null and empty texts are clean, as are all texts when
    the benchmark is empty. A benchmark of several chunks gives the same rows. Repeated rows give repeated results. Other columns are not read; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sent = [sc.broadcast(index) for index in benchmark_chunks(benchmark)]
    if not sent:
        return rows.select("doc_id", F.lit(False).alias("contaminated"), F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("best_item"), F.array().cast("array<bigint>").alias("items"))
    if len(sent) > 1:
        # numbered once and written, so that each chunk sees the same numbers; ids may be null or repeated
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    parts = [rows.mapInArrow(lean(_matches(b)), f"{kinds}, contaminated boolean, coverage double, best_item long, items array<long>") for b in sent]
    out = parts[0]
    if len(sent) > 1:
        # a row of each chunk for each document row: the best of them, and all items
        for part in parts[1:]:
            out = out.unionByName(part)
        best = F.max(F.struct("coverage", (-F.col("best_item")).alias("item")))
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("contaminated").alias("contaminated"), best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.select("doc_id", "contaminated", F.col("b.coverage").alias("coverage"), (-F.col("b.item")).alias("best_item"), "items")
    return out.select("doc_id", "contaminated", "coverage", "best_item", "items")


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                yield s.filter(pa.array([not any(c >= COVERAGE for _, c in f) for f in found_in(index.value, s.column("text"))], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item (see `contamination`).

    Rows are judged by their own text: repeated rows, equal texts and rows without an id stay or go alike. Null and empty
    texts stay. An empty table, or an empty benchmark, changes nothing. No other column is read, whatever its name.
    """
    for index in benchmark_chunks(benchmark):
        docs = docs.mapInArrow(lean(_clean(docs.sparkSession.sparkContext.broadcast(index))), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
