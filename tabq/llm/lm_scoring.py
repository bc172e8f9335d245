"""Language-model scores from a log-frequency Bloom filter of quantised pair counts.

A word pair with count c is entered at levels 1 .. 1 + floor(log2 c); a count is read by probing level after level
until one is missing. The filter is made region by region from pre-aggregated counts of the whole training corpus,
so its size follows the corpus. What a worker holds at once is bounded: filter and word counts are cut into slices of
at most SLICE_MB. Texts are read once and scored in groups: the words and pairs of a group meet the slices one after
another, equal pairs are probed once, in the order of the filter, and nothing is shuffled. What is repeated for a slice
is loading it, once a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, checkpointed, hashed, held_out, lean, mixed, slices, table, words

MODULUS, REMAINDER = 7, 2
#: Hash functions and bits for each level of a pair: a false positive in about 250 probes.
PROBES, BITS = 8, 11.6
#: Most that is broadcast at once for word counts, and for the filter.
SLICE_MB = 160
#: Weight of the single-word model in a pair's probability, in counts.
PRIOR = 100.0
REGION_TOKENS, MIN_REGIONS = 1_000_000, 24
#: Bytes of text that are scored together where slices are loaded for each group, pairs that are probed together, and places for pairs met lately.
GROUP_BYTES, PROBED, KEPT = 8 << 20, 1 << 15, 1 << 20
_EMPTY = 255
END, START = mixed(np.array([0xE4D, 0x57A27], np.uint64))
#: The count that a level stands for.
_QUANTISED = np.concatenate([[0.0], 2.0 ** np.arange(255)])
_LOW, _HALF = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1)


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of all texts (words, then one end each): text number, vocabulary index, first of its text; and the vocabulary's hashes (the end's is last)."""
    ends, ids, vocabulary = words(texts)
    n = len(ends) - 1
    with_end = ends + np.arange(n + 1)
    token = np.full(with_end[-1], len(vocabulary), np.int64)
    body = np.ones(with_end[-1], bool)
    body[with_end[1:] - 1] = False
    token[body] = ids
    first = np.zeros(with_end[-1], bool)
    first[with_end[:-1]] = True
    return np.repeat(np.arange(n), np.diff(with_end)), token, first, np.concatenate([hashed(vocabulary), [END]])


def _pairs(token: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it (a start for the first of a text)."""
    h = hashes[token]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first] = START
    return mixed(mixed(before) * GOLDEN + h)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(keys) else counts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        for k in range(0, len(keys), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 500_000].view(np.int64)), pa.array(counts[k : k + 500_000])], ["h", "n"])

    for b in batches:
        for s in slices(b):
            _, token, _, hashes = _sequences(s.column("text"))
            n = np.bincount(token, minlength=len(hashes))
            held.append((hashes[n > 0], n[n > 0]))
            if sum(len(x) for x, _ in held) > 2_000_000:
                yield from out()
    if held:
        yield from out()


def _pair_blocks(regions: int):
    """Blocks of (region, low 48 bits of the hashes, counts over one) of each few million tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            region = _region(keys, regions)
            cuts = np.searchsorted(region, np.arange(regions + 1))
            rows = [(r, keys[a:b] & _LOW, counts[a:b]) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _, _ in rows], pa.int32()),
                    pa.array([(k >> np.uint64(16)).astype(np.uint32).tobytes() for _, k, _ in rows], pa.binary()),
                    pa.array([(k & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for _, k, _ in rows], pa.binary()),
                    pa.array([np.flatnonzero(n > 1).astype(np.uint32).tobytes() for _, _, n in rows], pa.binary()),
                    pa.array([n[n > 1].astype(np.uint32).tobytes() for _, _, n in rows], pa.binary()),
                ],
                ["region", "hi", "lo", "many", "times"],
            )

        for b in batches:
            for s in slices(b):
                _, token, first, hashes = _sequences(s.column("text"))
                held.append(_pairs(token, first, hashes))
                if sum(map(len, held)) > 3_000_000:
                    yield from out()
        if held:
            yield from out()

    return run


def _region(keys: np.ndarray, regions: int) -> np.ndarray:
    """The filter region of each hash; it rises with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(regions) >> np.uint64(32)).astype(np.int64)


def _bases(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of a level's probes."""
    a = mixed(keys + np.uint64(level * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    return a & _HALF, (a >> np.uint64(32)) | np.uint64(1)


def _region_filter(t: pa.Table) -> pa.Table:
    keys, counts = [], []
    for hi, lo, many, times in zip(*(t[c].to_pylist() for c in ("hi", "lo", "many", "times"))):
        k = (np.frombuffer(hi, np.uint32).astype(np.uint64) << np.uint64(16)) | np.frombuffer(lo, np.uint16)
        n = np.ones(len(k), np.int64)
        n[np.frombuffer(many, np.uint32)] = np.frombuffer(times, np.uint32)
        keys.append(k)
        counts.append(n)
    keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
    distinct, level = len(keys), np.floor(np.log2(counts)).astype(np.int64) + 1
    n_bits = min(1 << 31, int(level.sum() * BITS) // 8 * 8 + 64)
    bits = np.zeros(n_bits, bool)
    for q in range(1, int(level.max()) + 1):
        if q > 1:
            more = level >= q
            keys, level = keys[more], level[more]
        for k in range(0, len(keys), PROBED):
            a, b = (x.astype(np.uint32) for x in _bases(keys[k : k + PROBED], q))
            for _ in range(PROBES):
                bits[(a * np.uint64(n_bits) >> np.uint64(32)).view(np.int64)] = True
                a += b
    return pa.table({"region": t["region"][:1], "n": pa.array([distinct], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _packed_words(t: pa.Table) -> pa.Table:
    h, n = t["h"].to_numpy().view(np.uint64), t["n"].to_numpy()
    order = np.argsort(h)
    return pa.table({"part": t["part"][:1], "h": pa.array([h[order].tobytes()], pa.binary()), "n": pa.array([n[order].astype(np.uint32 if n.max() < 1 << 32 else np.uint64).tobytes()], pa.binary())})


class Model:
    """Broadcast slices of the filter and of the word counts, and the corpus totals."""

    def __init__(self, regions: int, filters: list, starts: list[int], counts: list, tokens: int, distinct: int, texts: int):
        #: `starts` has the first region of each slice of the filter
        self.regions, self.filters, self.starts, self.counts = regions, filters, starts, counts
        self.tokens, self.distinct, self.texts = tokens, distinct, texts


def _joined_words(rows: list) -> tuple[bytes, bytes, str]:
    """Sorted hashes and their counts of neighbouring parts."""
    wide = any(len(r.n) == len(r.h) for r in rows)
    n = b"".join(r.n if not wide or len(r.n) == len(r.h) else np.frombuffer(r.n, np.uint32).astype(np.uint64).tobytes() for r in rows)
    return b"".join(r.h for r in rows), n, "<u8" if wide else "<u4"


def _joined_regions(rows: list) -> tuple:
    """Regions, the bytes at which their bits begin, their bits' numbers, and the bits."""
    sizes = np.array([len(r.bits) for r in rows], np.int64)
    return np.array([r.region for r in rows], np.int64), np.cumsum(sizes) - sizes, sizes * 8, b"".join(r.bits for r in rows)


def train(texts: DataFrame) -> Model:
    """Counts over every text of the single string column `text`."""
    sc = texts.sparkSession.sparkContext
    counts = checkpointed(texts.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("n"))), F.lit(0)).alias("texts")).first()
    parts = max(8, int(total["distinct"]) // 500_000 + 1)
    # parts are ranges of the unsigned hash
    part = (F.shiftrightunsigned(F.col("h"), 40) * parts / F.lit(1 << 24)).cast("int")
    packed = counts.withColumn("part", part).groupBy("part").applyInArrow(_packed_words, "part int, h binary, n binary")
    regions = max(MIN_REGIONS, int(total["tokens"]) // REGION_TOKENS + 1)
    filters = texts.mapInArrow(_pair_blocks(regions), "region int, hi binary, lo binary, many binary, times binary").groupBy("region").applyInArrow(_region_filter, "region int, n long, bits binary")
    sent_words, sent_bits, starts = [], [], []
    for sent, df, size, join in ((sent_words, packed, lambda r: len(r.h) + len(r.n), _joined_words), (sent_bits, filters, lambda r: len(r.bits), _joined_regions)):
        # the driver puts together one slice at a time
        held, total_size = [], 0
        for r in checkpointed(df).orderBy(df.columns[0]).toLocalIterator():
            if held and total_size + size(r) > SLICE_MB << 20:
                sent.append(sc.broadcast(join(held)))
                held, total_size = [], 0
            if sent is sent_bits and not held:
                starts.append(r.region)
            held.append(r)
            total_size += size(r)
        sent.append(sc.broadcast(join(held)))
        del held
    return Model(regions, sent_bits, starts, sent_words, int(total["tokens"]), int(total["distinct"]), int(total["texts"]))


def _look_up(held: tuple, hashes: np.ndarray, into: np.ndarray) -> None:
    """Write the counts of the hashes, which are in order, that this slice has."""
    h, n, kind = held
    keys, values = np.frombuffer(h, np.uint64), np.frombuffer(n, kind)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        into[hit] = values[at[hit]]


def _probe(held: tuple, regions: int, pairs: np.ndarray, into: np.ndarray, most: np.ndarray | None = None) -> None:
    """Write the levels of the pairs in this slice's regions, none beyond `most`. Pairs in order make neighbours meet in one region."""
    there, starts, sizes, bits = held
    if not len(there):
        return
    blob = np.frombuffer(bits, np.uint8)
    place = np.full(regions, -1)
    place[there] = np.arange(len(there))
    for k in range(0, len(pairs), PROBED):
        at = place[_region(pairs[k : k + PROBED], regions)]
        i = np.flatnonzero(at >= 0)
        at = at[i]
        i += k
        _probe_some(blob, pairs[i] & _LOW, starts[at] * 8, sizes[at].astype(np.uint64), i, into, most)


def _probe_some(blob: np.ndarray, keys: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, into: np.ndarray, most: np.ndarray | None) -> None:
    level = 0
    most = most[i] if most is not None else None
    while len(i):
        level += 1
        a, b = (x.astype(np.uint32) for x in _bases(keys, level))
        alive = None
        for p in range(PROBES):
            # double hashing in 32 bits that wrap, scaled to the number of bits
            at = (a * size >> np.uint64(32)).view(np.int64) + start
            ok = (blob[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)
            alive = ok if alive is None else alive & ok
            a += b
            if p < PROBES - 1 and np.count_nonzero(alive) < 0.7 * len(i):
                i, keys, start, size, a, b = (x[alive] for x in (i, keys, start, size, a, b))
                most = most[alive] if most is not None else None
                alive = np.ones(len(i), bool)
        i, keys, start, size = (x[alive] for x in (i, keys, start, size))
        into[i] = level
        if most is not None:
            most = most[alive]
            more = most > level
            i, keys, start, size, most = (x[more] for x in (i, keys, start, size, most))


def _in_turn(sent: list) -> Iterator[tuple]:
    """The slices one after another; where there are several a worker holds one at a time, and reads it again from its executor's file."""
    for x in sent:
        yield x.value
        if len(sent) > 1 and getattr(x, "_path", None) is not None:
            x.__dict__.pop("_value", None)


def _counts(sent: list, hashes: np.ndarray) -> np.ndarray:
    order = np.argsort(hashes)
    ordered, found = hashes[order], np.zeros(len(hashes), np.int64)
    for held in _in_turn(sent):
        _look_up(held, ordered, found)
    out = np.empty_like(found)
    out[order] = found
    return out


def _seen(sent: list, regions: int, pairs: np.ndarray, most: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """The quantised counts of the pairs, at most `most`; equal pairs are probed once, and no further than `most` can show.

    `kept` has the levels of pairs met lately: in the place that a pair's low bits name its other bits, the last 8 of them replaced by the level.
    """
    out, ask = np.zeros(len(pairs), np.uint8), most > 0
    if kept is not None:
        there = kept[(pairs & np.uint64(KEPT - 1)).view(np.int64)]
        level = there.astype(np.uint8)
        hit = ((there ^ pairs) < 256) & (level != _EMPTY)
        out[hit] = level[hit]
        ask &= ~hit
    i = np.flatnonzero(ask)
    i = i[np.argsort(pairs[i])]
    keys = pairs[i]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(i) else i
    keys, times = keys[at], np.diff(at, append=len(i))
    level = np.zeros(len(at), np.uint8)
    if len(at):
        # the first level whose count is not below
        last = np.ceil(np.log2(np.maximum.reduceat(most[i], at))).astype(np.uint8) + np.uint8(1)
        for held in _in_turn(sent):
            _probe(held, regions, keys, level, last)
    if kept is not None:
        kept[(keys & np.uint64(KEPT - 1)).view(np.int64)] = keys & ~np.uint64(255) | level
    out[i] = np.repeat(level, times)
    return np.minimum(_QUANTISED[out], most)


def _scored(model: dict, counts: list, filters: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens, distinct, texts = model["tokens"], model["distinct"], model["texts"]
        kept = np.full(KEPT, _EMPTY, np.uint64)
        for b in batches:
            for s in slices(b, size=GROUP_BYTES if max(len(counts), len(filters)) > 1 else None):
                who, token, first, hashes = _sequences(s.column("text"))
                n = s.num_rows
                known = _counts(counts, hashes)
                single = (known + 1.0) / (n_tokens + distinct + 1.0)
                count = known[token]
                sums = [np.bincount(who, minlength=n), np.bincount(who[count > 0], minlength=n), np.bincount(who, np.log10(single)[token], n)]
                before = np.empty(len(token), np.int64)
                before[1:] = count[:-1]
                before[first] = texts
                # a pair can't be more frequent than its words; that also drops most false positives
                seen = _seen(filters, model["regions"], _pairs(token, first, hashes), np.minimum(count, before), kept)
                seen += PRIOR * single[token]
                seen /= before + PRIOR
                sums.append(np.bincount(who, np.log10(seen, out=seen), n))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return lean(run)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null texts count as empty: they have the end token alone, in training too. Rows without an id are training rows.
    Repeated rows count as often as they occur and score alike. With no training rows every token is unknown and the
    base gives each probability 1. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(rows.filter(~held_out("doc_id", MODULUS, REMAINDER)).select("text"))
    return apply_model(rows, model)


def apply_model(rows: DataFrame, model: Model) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]
    plain = {"regions": model.regions, "tokens": model.tokens, "distinct": model.distinct, "texts": model.texts}
    out = rows.mapInArrow(_scored(plain, model.counts, model.filters), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    out = out.withColumn("held_out", held_out("doc_id", MODULUS, REMAINDER)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
