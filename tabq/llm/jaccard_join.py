"""Exact n-gram Jaccard join in a metric space, giving components and link counts.

Equal shingle sets are one point. Nearly all pairs of texts share nothing and lie at distance 1, where single documents
as pivots separate nothing. So the pivots of the first level are unions of sets, and a pivot's region is all subsets of
its union: a set lies |x - P| / |x| from the region of pivot P, which is its Jaccard distance to the nearest member. Each
set's home is a region at distance 0, and by the triangle inequality every set that links with a home set lies within
the link distance of that region, so such boundary sets are replicated into it as guests. A home set meets all its
partners in its home region, which therefore counts its links in full.

Pivots and windows are found without comparing texts. In an order of all shingles (common ones last, then by hash), two
linked sets share one of their first |x| - ceil(t |x|) + 1 shingles, else either lacks too much of the other. The sets
that meet at such a shingle, and whose counts over hash bins leave room for a link, form a cluster: a pivot. A set's home
is the largest of its clusters, and it is a guest of the homes of those that it meets.

Regions are joined recursively. Inside a task, documents are pivots: Voronoi cells by Jaccard distance, windows of twice
the link distance, and cells again. A region too large for one task is first cut by document pivots of its own into
Voronoi cells and blocks of them; two blocks meet in a task of their own with the sets whose windows reach the other
cell, each set as its difference from a pivot. No pair is emitted, only roots of the sets that are linked in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, checkpointed, free_name, grams, hashed, lean, lean_group, mixed, slices, stored, table, words
from .components import components, local_roots

#: Sets that are compared one by one; document pivots of larger cells.
LEAF, MAX_PIVOTS = 24, 24
#: Sets of a region that one task joins; larger regions are cut into blocks of half as many, around so many pivots.
REGION_SETS, REGION_PIVOTS = 256, 6
#: Signatures of a bucket, rows of a part of the cluster search, shingles of a batch of regions: the work of one task.
BUCKET_SIGNATURES, PART_ROWS, BATCH_SHINGLES = 700_000, 60_000, 1_000_000
#: A counting sketch tells shingles that are in over HOT sets (or thrice the mean of its slots); they come last in the order.
SKETCH_SLOTS, SKETCH_PARTS, HOT = 1 << 22, 32, 48
#: Fewest hash bins of a set's profile, and most shingles a bin on average; pairs found in a task before they are folded into a forest.
BINS, PER_BIN, FOLD = 32, 12, 400_000
FILTER_SEGMENT, MAX_FILTER_BITS = 1 << 16, 1 << 28


class Rule:
    """Links: den * intersection >= num * union, for sets of n-word shingles."""

    def __init__(self, n: int = 4, num: int = 85, den: int = 100):
        self.n, self.num, self.den = n, num, den

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """First shingles of a set of which each linked set has one among its own; 0 for sets too small for an unequal partner."""
        most = (self.den - self.num) * (size + size * self.den // self.num) // (self.den + self.num)
        return np.where(most > 0, size - -(-self.num * size // self.den) + 1, 0)

    def linked(self, common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return (self.den * common >= self.num * (a + b - common)) & (common > 0)

    @property
    def reach(self) -> float:
        return 1 - self.num / self.den


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and the flat, sorted, distinct shingle hashes of each text; short texts have one, empty ones none."""
    ends, ids, vocabulary = words(texts)
    k = len(ends) - 1
    if not len(ids):
        return np.zeros(k + 1, np.int64), np.empty(0, np.uint64)
    h = hashed(vocabulary)[ids]
    size = np.diff(ends)
    who = np.repeat(np.arange(k), size)
    parts, owners = [], []
    if len(h) >= n:
        inside = who[n - 1 :] == who[: len(h) - n + 1]
        parts.append(grams(h, n)[inside])
        owners.append(who[: len(h) - n + 1][inside])
    for length in range(1, n):  # the whole sequence as one
        at = ends[:-1][size == length]
        if len(at):
            parts.append(grams(np.stack([h[at + j] for j in range(length)], 1).ravel(), length)[::length])
            owners.append(np.flatnonzero(size == length))
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    if k < 1 << 16:  # a fast sort by hash, then a stable one by text
        order = np.argsort(flat)
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=k))]).astype(np.int64), flat


def set_keys(ends: np.ndarray, flat: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]


def _node(keys: list[bytes]) -> np.ndarray:
    """Short numbers of sets."""
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def profiles(size: np.ndarray, flat: np.ndarray) -> list[bytes]:
    """Shingle counts of each set over hash bins, 255 at most; the sum of their differences bounds that of the sets from below.

    There are more bins, by powers of two, for a larger set: bins of a longer profile fall into those of a shorter one.
    """
    width = np.maximum(BINS, 1 << np.ceil(np.log2(np.maximum(size, 1) / PER_BIN)).clip(0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(width)])
    who = np.repeat(np.arange(len(size)), size)
    bins = (mixed(flat + np.uint64(5)) >> np.uint64(20)).astype(np.int64) & (width - 1)[who]
    counts = np.minimum(np.bincount(ends[who] + bins, minlength=int(ends[-1])), 255).astype(np.uint8).tobytes()
    return [counts[a:z] for a, z in zip(ends[:-1], ends[1:])]


class Profiles:
    """Profiles of the sets of a task, each as it is and folded to half its bins: linked sets are no further apart."""

    def __init__(self, rule: Rule, size: np.ndarray, packed: list[bytes]):
        self.rule, self.size = rule, size
        self.width = np.array([len(x) for x in packed], np.int64)
        #: by width: the place of each set among the rows, and the rows
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width):
            mine, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            rows = np.frombuffer(b"".join(packed[i] for i in mine), np.uint8).reshape(-1, w)
            folded = np.minimum(np.frombuffer(b"".join(packed[i] for i in twice), np.uint8).reshape(-1, 2, w).sum(1, dtype=np.uint16), 255).astype(np.uint8)
            place = np.full(len(size), -1)
            place[mine], place[twice] = np.arange(len(mine)), len(mine) + np.arange(len(twice))
            self.at[int(w)] = place, np.concatenate([rows, folded])

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and profiles of sets a and b leave room for a link."""
        most = (self.rule.den - self.rule.num) * (self.size[a] + self.size[b]) // (self.rule.den + self.rule.num)
        out = np.abs(self.size[a] - self.size[b]) <= most
        lo, hi = np.minimum(self.width[a], self.width[b]), np.maximum(self.width[a], self.width[b])
        for w in np.unique(lo[out]):
            place, rows = self.at[int(w)]
            i = np.flatnonzero(out & (lo == w) & (hi <= 2 * w))  # others are too unlike in size for two foldings, and stay
            step = max(1, (1 << 21) // int(w))
            for k in (i[x : x + step] for x in range(0, len(i), step)):
                x, y = rows[place[a[k]]], rows[place[b[k]]]
                out[k] = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64) <= most[k]
        return out


_DESCRIBED = "doc_id long, text_hash long, n_shingles long, set_key binary, node long, profile binary, part int, hits binary"


def _described(n: int):
    """Size, key and profile of each text's set; then, for the partition, how often each slot of the sketch is hit by its distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        hits = np.zeros(SKETCH_SLOTS, np.uint32)
        names = [c.split()[0] for c in _DESCRIBED.split(", ")]
        for b in batches:
            for s in slices(b):
                ends, flat = shingle_sets(s.column("text"), n)
                keys, size = set_keys(ends, flat), np.diff(ends)
                new = np.array([k not in seen and not seen.add(k) for k in keys], bool)
                hits += np.bincount(_sketch_slot(flat[np.repeat(new, size)]), minlength=SKETCH_SLOTS).astype(np.uint32)
                profile = profiles(size, flat)
                none = pa.nulls(len(size), pa.binary())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("text_hash"), pa.array(size), pa.array(keys, pa.binary()), pa.array(_node(keys)), pa.array(profile, pa.binary()), pa.nulls(len(size), pa.int32()), none], names)
        if seen:
            parts = [zlib.compress(np.minimum(x, 65_535).astype(np.uint16).tobytes(), 1) for x in hits.reshape(SKETCH_PARTS, -1)]
            long, data = pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary())
            yield pa.RecordBatch.from_arrays([long, long, long, data, long, data, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _sketch_slot(flat: np.ndarray) -> np.ndarray:
    return (mixed(flat + np.uint64(77)) & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64)


def _hot_part(t: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_SLOTS // SKETCH_PARTS, np.int64)
    for x in t["hits"].to_pylist():
        total += np.frombuffer(zlib.decompress(x), np.uint16)
    hot = total > max(HOT, 3 * total.mean())
    return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(hot).tobytes()], pa.binary())})


def _distinct_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Non-empty sets of a partition's texts, each once: sizes, flat hashes, keys."""
    seen: set[bytes] = set()
    for b in batches:
        for s in slices(b):
            ends, flat = shingle_sets(s.column("text"), n)
            keys, size = set_keys(ends, flat), np.diff(ends)
            use = np.zeros(len(keys), bool)
            for i, k in enumerate(keys):
                if size[i] and k not in seen:
                    seen.add(k)
                    use[i] = True
            if use.any():
                yield size[use], flat[np.repeat(use, size)], [k for k, u in zip(keys, use) if u]


# -- first level: pivots, homes and windows


def signatures(rule: Rule, size: np.ndarray, flat: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, shingle, whether it is common) for the first shingles of each set: common ones last, then by hash."""
    slot = _sketch_slot(flat)
    common = (hot[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    owner, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    before = np.concatenate([[0], np.cumsum(~common)])  # rare shingles up to each place
    rare = before[start + size] - before[start]
    place = np.arange(len(flat)) - start[owner]
    rank_rare = before[:-1] - before[start][owner]
    rank = np.where(common, rare[owner] + place - rank_rare, rank_rare)
    use = rank < rule.prefix(size)[owner]
    return owner[use], flat[use], common[use]


def _size_code(size: np.ndarray) -> np.ndarray:
    """Sizes in steps of half a percent, rounded down."""
    return np.floor(np.log(size) / np.log(1.005)).astype(np.uint16)


def _signature_blocks(rule: Rule, buckets: int, hot):
    """Blocks of shingles, sets and their sizes by bucket: a rare shingle's sets go to one bucket, a common one's to any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(hot.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            sig, node, code, often = (np.concatenate(x) for x in zip(*held))
            held.clear()
            spread = mixed(np.where(often, sig + node.view(np.uint64), sig) ^ GOLDEN) >> np.uint64(32)
            place = (spread * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) * 2 + often
            order = np.argsort(place, kind="stable")
            place, sig, node, code = place[order], sig[order], node[order], code[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])), len(place)) if len(place) else np.zeros(1, np.int64)
            pieces = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(place[a]) >> 1 for a, _ in pieces], pa.int32()), pa.array([bool(place[a] & 1) for a, _ in pieces], pa.bool_()), *[pa.array([x[a:z].tobytes() for a, z in pieces], pa.binary()) for x in (sig, node, code)]],
                ["bucket", "often", "sig", "node", "code"],
            )

        for size, flat, keys in _distinct_sets(batches, rule.n):
            who, sig, often = signatures(rule, size, flat, common)
            held.append((sig, _node(keys)[who], _size_code(size)[who], often))
            if sum(len(x[0]) for x in held) > 500_000:
                yield from out()
        if held:
            yield from out()

    return run


def _met(rule: Rule):
    """Per bucket: (shingle, set) where a rare shingle has another set of a like size, and of all common shingles."""
    apart = int(np.ceil(np.log(rule.den / rule.num) / np.log(1.005))) + 1

    def run(t: pa.Table) -> pa.Table:
        parts = []
        for often in (False, True):
            rows = t.filter(pc.equal(t["often"], often))
            sig, node, code = (np.frombuffer(b"".join(rows[c].to_pylist()), k) for c, k in (("sig", np.uint64), ("node", np.int64), ("code", np.uint16)))
            order = np.lexsort((node, code, sig))
            sig, node, code = sig[order], node[order], code[order].astype(np.int64)
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # a set of several partitions
            sig, node, code = sig[new], node[new], code[new]
            if not often and len(sig):
                like = (sig[1:] == sig[:-1]) & (code[1:] - code[:-1] <= apart)
                keep = np.append(like, False) | np.append(False, like)
                sig, node = sig[keep], node[keep]
            parts.append(pa.table({"sig": pa.array(sig.view(np.int64)), "node": pa.array(node), "often": pa.array(np.full(len(sig), often))}))
        return pa.concat_tables(parts)

    return run


def _clusters(rule: Rule):
    """Per part: (set, cluster, sets of the cluster) for the sets that meet at a shingle and may be linked, directly or through others there."""

    def run(t: pa.Table) -> pa.Table:
        sig, node, size = (t[c].to_numpy() for c in ("sig", "node", "size"))
        order = np.lexsort((node, sig))
        _, first, own = np.unique(node, return_index=True, return_inverse=True)
        profile = Profiles(rule, size[first], t["profile"].take(pa.array(first)).to_pylist())
        sig, node, own = sig[order], node[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
        count = np.diff(np.append(start, len(sig)))
        cell = np.repeat(np.arange(len(start), dtype=np.int32), count)
        forest: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            return local_roots(*(np.concatenate(x) for x in zip(*forest))) if forest else (np.empty(0, np.int64),) * 2

        def pairs(a: np.ndarray, b: np.ndarray) -> None:
            ok = profile.near(own[a], own[b])
            forest.append((a[ok], b[ok]))
            if sum(len(x) for x, _ in forest) > FOLD:  # only a forest is kept
                forest[:] = [folded()]

        few = count[cell] <= 16
        for d in range(1, int(min(16, count.max(initial=1)))):
            i = np.flatnonzero((cell[d:] == cell[:-d]) & few[d:])
            for k in range(0, len(i), 20_000):
                pairs(i[k : k + 20_000], i[k : k + 20_000] + d)
        for c in np.flatnonzero(count > 16):
            step = max(1, 20_000 // int(count[c]))
            for k in range(0, count[c] - 1, step):
                x, y = np.triu_indices(min(step, count[c] - k), 1, count[c] - k)
                pairs(start[c] + k + x, start[c] + k + y)
        at, root = folded()
        order = np.argsort(root, kind="stable")
        at, root = at[order], root[order]
        first = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])) if len(root) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(root)))
        # a cluster is named by its sets: those that meet at many shingles are one cluster
        key = mixed(np.add.reduceat(mixed(node[at].view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64) if len(at) else np.empty(0, np.int64)
        return pa.table({"node": pa.array(node[at]), "cluster": pa.array(np.repeat(key, n)), "n": pa.array(np.repeat(n, n).astype(np.int64))})

    return run


def regions(rule: Rule, met: DataFrame, reps: DataFrame) -> DataFrame:
    """(region, node, home) for the sets that may have a link: their home region, and those where they are guests."""
    cold = met.filter("NOT often").join(reps.select("node", F.col("n_shingles").alias("size"), "profile"), "node")
    parts = max(12, met.count() // PART_ROWS + 1)
    found = cold.withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(parts))).groupBy("part").applyInArrow(lean_group(_clusters(rule)), "node long, cluster long, n long")
    common = met.filter("often").select("node", F.col("sig").alias("cluster"))
    counted = common.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1")
    common = common.join(counted, "cluster").select("node", "cluster", "n")
    # a row a set: its clusters, each once, of which the largest is its home
    of_set = found.unionByName(common).groupBy("node").agg(F.collect_set(F.struct("n", "cluster")).alias("c"))
    of_set = of_set.select("node", F.array_max("c")["cluster"].alias("home"), F.transform("c", lambda x: x["cluster"]).alias("clusters"))
    of_set = checkpointed(of_set.join(reps.select("node", F.col("n_shingles").alias("size")), "node"))
    homes, rows = of_set.select("node", "home"), of_set.select("node", "home", "size", F.explode("clusters").alias("cluster"))
    # clusters with sets of several homes: each is a guest of the other homes
    there = rows.groupBy("cluster", F.col("home").alias("region")).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    several = there.groupBy("cluster").agg(F.collect_list(F.struct("region", "least", "most")).alias("homes")).filter(F.size("homes") > 1)
    fits = (F.col("h.least") * rule.num <= F.col("size") * rule.den) & (F.col("size") * rule.num <= F.col("h.most") * rule.den)
    guests = rows.join(several, "cluster").select("node", "home", "size", F.explode("homes").alias("h")).filter((F.col("home") != F.col("h.region")) & fits).select("node", "h.region")
    own = homes.select(F.col("home").alias("region"), "node", F.lit(True).alias("home"))
    return checkpointed(own.unionByName(guests.select("region", "node", F.lit(False).alias("home")).distinct()))


# -- the sets that take part


def _slots(nodes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(nodes.view(np.uint64) + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (11, 12, 13)]


def node_filter(nodes: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the long column `node`, at most MAX_FILTER_BITS large."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = np.unique(np.concatenate(_slots(b.column(0).to_numpy(zero_copy_only=False), bits)))
            seg, start = np.unique(pos // FILTER_SEGMENT, return_index=True)
            parts = np.split((pos % FILTER_SEGMENT).astype(np.uint16), start[1:]) if len(seg) else []
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["seg", "slots"])

    def merge(t: pa.Table) -> pa.Table:
        on = np.zeros(FILTER_SEGMENT, bool)
        for x in t["slots"].to_pylist():
            on[np.frombuffer(x, np.uint16)] = True
        return pa.table({"seg": t["seg"][:1], "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros((bits // FILTER_SEGMENT, FILTER_SEGMENT // 8), np.uint8)
    for r in nodes.select("node").mapInArrow(hits, "seg long, slots binary").groupBy("seg").applyInArrow(merge, "seg long, bits binary").collect():
        out[r.seg] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _fetched(rule: Rule, bits, n_bits: int):
    """The sets that the filter passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for size, flat, keys in _distinct_sets(batches, rule.n):
            node = _node(keys)
            ok = np.ones(len(keys), bool)
            for s in _slots(node, n_bits):
                ok &= (held[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            if ok.any():
                ends = np.concatenate([[0], np.cumsum(size[ok])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[np.repeat(ok, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, u in zip(keys, ok) if u], pa.binary()), shingles], ["set_key", "shingles"])

    return run


# -- joins inside a region


class Cells:
    """Sets of a task, with an index from shingle to sets, and the recursive join over them.

    A set may be given as its difference from a common pivot, with its true size: the difference of two sets is that of
    their differences. `home` marks the sets whose links are asked for.
    """

    def __init__(self, rule: Rule, sets: list[np.ndarray], size: np.ndarray | None = None, home: np.ndarray | None = None):
        self.rule = rule
        self.given = np.array([len(s) for s in sets], np.int64)
        self.size = self.given if size is None else size
        self.home = np.ones(len(sets), bool) if home is None else home
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.given)
        _, ids, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[ids] > 1  # a shingle of one set meets nothing
        ids, owner = ids[shared], owner[shared]
        _, ids = np.unique(ids, return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
        self.ids = ids  # by set
        self.n_ids = int(ids.max()) + 1 if len(ids) else 0
        self.owner = owner

    def common(self, x: int, members: np.ndarray, index) -> np.ndarray:
        """Shingles that x shares with each of the members, of which `indexed` made the index."""
        post, cuts = index
        ids = self.ids[self.starts[x] : self.starts[x + 1]]
        lengths = cuts[ids + 1] - cuts[ids]
        at = np.repeat(cuts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        both = np.bincount(post[at], minlength=len(members))
        apart = self.given[x] + self.given[members] - 2 * both
        c = (self.size[x] + self.size[members] - apart) // 2
        c[members == x] = self.size[x]  # shingles that no other set has are not indexed
        return c

    def indexed(self, members: np.ndarray):
        """Postings over the members only; positions are places in `members`."""
        place = np.full(len(self.size), -1)
        place[members] = np.arange(len(members))
        here = place[self.owner]
        use = here >= 0
        ids, here = self.ids[use], here[use]
        order = np.argsort(ids, kind="stable")
        return here[order], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.n_ids))])

    def join(self, home: np.ndarray, guests: np.ndarray, found) -> int:
        """Call found(x, ys) with all links of each home set among home and guests, which are joined elsewhere; the number of cells made."""
        members = np.concatenate([home, guests])
        index = self.indexed(members)
        if len(members) > LEAF and len(home) > 1:
            k = min(MAX_PIVOTS, int(len(home) ** 0.5))
            pivots = home[np.linspace(0, len(home) - 1, k).astype(int)]
            common = np.stack([self.common(int(p), members, index) for p in pivots], 1)
            distance = 1 - common / (self.size[members][:, None] + self.size[pivots][None, :] - common)
            nearest = distance.min(1)
            # a set that shares nothing with any pivot is as far from all: such sets are a cell of their own, the last
            cell = np.where(nearest[: len(home)] < 1, distance[: len(home)].argmin(1), k)
            # a partner of a home set of cell p lies within the cell's radius and the link distance of p, and no
            # farther from p than from its own nearest pivot by over twice the link distance
            reach = self.rule.reach + 1e-9
            radius = np.array([distance[: len(home)][cell == j, j].max(initial=-1.0) for j in range(k)])
            window = (distance <= nearest[:, None] + 2 * reach) & (distance <= radius[None, :] + reach)
            window = np.concatenate([window, (nearest >= 1 - reach)[:, None]], 1)
            window[np.arange(len(home)), cell] = True
            if window.sum() < 3 * len(members) and window.sum(0).max() < 0.8 * len(members):
                made = k + 1
                for j in range(k + 1):
                    own = np.flatnonzero(cell == j)
                    if len(own):
                        other = window[:, j].copy()
                        other[own] = False
                        made += self.join(home[own], members[other], found)
                return made
        for x in home:
            c = self.common(int(x), members, index)
            ys = members[self.rule.linked(c, self.size[x], self.size[members])]
            found(int(x), ys[ys != x])
        return 0


def _joined(rule: Rule, sets: list[np.ndarray], size: np.ndarray, home: np.ndarray, copies: np.ndarray, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(least place of each set's component here, documents linked to each home set). With blocks, only links across the two count."""
    cells = Cells(rule, sets, size, home)
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def found(x: int, ys: np.ndarray) -> None:
        if block is not None:
            ys = ys[block[ys] != block[x]]
        if len(ys):
            links[x] += copies[ys].sum()
            edges.append((np.full(len(ys), x), ys))
            if sum(len(a) for a, _ in edges) > FOLD:
                edges[:] = [local_roots(*(np.concatenate(e) for e in zip(*edges)))]

    cells.join(np.flatnonzero(home), np.flatnonzero(~home), found)
    if edges:
        at, least = local_roots(*(np.concatenate(e) for e in zip(*edges)))
        root[at] = least
    return root, links


_JOINED = "set_key binary, node long, root long, links long"


def _each(rule: Rule, by: str, whole: bool):
    """Joins each group of `by` in a batch of them: a whole region, or two blocks (or a block with itself) of a large one. A set counts once in a group."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        group = t[by].to_numpy()
        order = np.argsort(group, kind="stable")
        t, group = t.take(pa.array(order)), group[order]
        keys = t["set_key"].to_pylist()
        lists = t["shingles"].combine_chunks()
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        node, copies, size, block, other = (t[c].to_numpy() for c in ("node", "copies", "size", "block", "other"))
        home = t["home"].to_numpy().astype(bool)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        at, roots, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            use = np.array(sorted({keys[i]: i for i in range(z - 1, a - 1, -1)}.values()))
            here = home[use]
            if not here.any():
                continue
            sets = [flat[ends[i] : ends[i + 1]] for i in use]
            if whole and not here.all():
                # the window: guests within the link distance of the pivot's region
                pivot = np.unique(np.concatenate([s for s, h in zip(sets, here) if h]))
                there = np.array([h or rule.den * int(np.isin(s, pivot, assume_unique=True).sum()) >= rule.num * len(s) for s, h in zip(sets, here)])
                use, here, sets = use[there], here[there], [s for s, k in zip(sets, there) if k]
            across = not whole and block[a] != other[a]
            root, n = _joined(rule, sets, size[use], here, copies[use], block[use] if across else None)
            at.append(use)
            roots.append(node[use[root]])
            links.append(np.where(here, n, 0))
        rows = np.concatenate(at)
        return pa.table({"set_key": pa.array([keys[i] for i in rows], pa.binary()), "node": pa.array(node[rows]), "root": pa.array(np.concatenate(roots)), "links": pa.array(np.concatenate(links))})

    return run


def _distance(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 1 - both / (F.size(a) + F.size(b) - both)


def _large(rule: Rule, part: DataFrame) -> DataFrame:
    """Links in regions of over REGION_SETS sets: Voronoi cells of document pivots, their blocks, and pairs of blocks that windows join."""
    part = stored(part.dropDuplicates(["region", "set_key"]))
    salted = part.filter("home").withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(REGION_PIVOTS)))
    pivots = salted.groupBy("region", "salt").agg(F.min_by("shingles", "set_key").alias("p")).groupBy("region").agg(F.sort_array(F.collect_list("p")).alias("pivots"))
    d = part.join(pivots, "region").withColumn("d", F.transform("pivots", lambda p: _distance(F.col("shingles"), p)))
    d = d.withColumn("cell", F.array_position("d", F.array_min("d")).cast("int") - 1)
    d = d.withColumn("window", F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda k: F.get("d", k) <= F.array_min("d") + F.lit(2 * rule.reach + 1e-9)))
    # a set as its difference from the first pivot
    first = F.get("pivots", F.lit(0))
    d = d.withColumn("size", F.size("shingles").cast("long")).withColumn("shingles", F.concat(F.array_except("shingles", first), F.array_except(first, F.col("shingles"))))
    d = stored(d.drop("pivots", "d"))
    blocks = d.groupBy("region", "cell").agg(F.ceil(F.count("*") / F.lit(max(1, REGION_SETS // 2))).cast("int").alias("n"))
    per_region = blocks.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("blocks"))
    d = d.join(per_region, "region")
    place = lambda cell, k: cell * F.lit(1 << 24) + k
    own = F.pmod(F.xxhash64("set_key", F.lit("block")), F.try_element_at("blocks", F.col("cell"))).cast("int")
    d = d.withColumn("block", place(F.col("cell"), own).cast("long"))
    reached = F.flatten(F.transform(F.filter("window", lambda c: F.map_contains_key("blocks", c)), lambda c: F.transform(F.sequence(F.lit(0), F.element_at("blocks", c) - 1), lambda k: place(c, k).cast("long"))))
    d = d.select("region", "set_key", "node", "copies", "home", "size", "shingles", "block", F.explode(reached).alias("other"))
    pair = d.withColumn("pair", F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")))
    return pair.groupBy("pair").applyInArrow(lean_group(_each(rule, "pair", False)), _JOINED)


def _linked(rule: Rule, present: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """(set_key, node, root, links) of the sets that meet in a region: a linked set of the task, and links if it is a home set there."""
    spark = present.sparkSession
    n_nodes = members.count()
    bits = FILTER_SEGMENT
    while bits < min(MAX_FILTER_BITS, 24 * n_nodes):
        bits *= 2
    passed = spark.sparkContext.broadcast(node_filter(members, bits))
    sets = stored(present.mapInArrow(lean(_fetched(rule, passed, bits)), "set_key binary, shingles array<bigint>"))
    large = checkpointed(members.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > REGION_SETS))
    any_large = not large.isEmpty()
    rows = members.join(reps.select("node", "set_key", "copies", "n_shingles"), "node")
    small = sets.join(rows.join(large.select("region"), "region", "left_anti") if any_large else rows, "set_key")
    shingles = reps.join(members, "node").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    batches = max(12, int(shingles) // BATCH_SHINGLES + 1)
    small = small.select("set_key", "node", "copies", "home", F.col("n_shingles").alias("size"), "shingles", "region", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("other"))
    out = small.withColumn("batch", F.pmod(F.xxhash64("region"), F.lit(batches))).groupBy("batch").applyInArrow(lean_group(_each(rule, "region", True)), _JOINED)
    return out.unionByName(_large(rule, sets.join(rows.join(large.select("region"), "region", "left_semi"), "set_key"))) if any_large else out


def _solved(docs: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, n_links for each row."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("text_hash"))
    both = checkpointed(rows.mapInArrow(lean(_described(rule.n)), _DESCRIBED))
    described = both.filter("part IS NULL").select("doc_id", "text_hash", "n_shingles", "set_key")
    sketch = np.zeros((SKETCH_PARTS, SKETCH_SLOTS // SKETCH_PARTS // 8), np.uint8)
    for r in both.filter("part IS NOT NULL").select("part", "hits").groupBy("part").applyInArrow(_hot_part, "part int, bits binary").collect():  # SKETCH_PARTS rows
        sketch[r.part] = np.frombuffer(r.bits, np.uint8)
    hot = spark.sparkContext.broadcast(sketch.tobytes())
    named = both.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = checkpointed(named.groupBy("set_key", "node", "n_shingles", "profile").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total = reps.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s")).first().s
    buckets = max(12, int(total * rule.reach) // BUCKET_SIGNATURES + 1)
    present = rows.filter("doc_id IS NOT NULL").select("text")
    blocks = present.mapInArrow(lean(_signature_blocks(rule, buckets, hot)), "bucket int, often boolean, sig binary, node binary, code binary")
    met = checkpointed(blocks.groupBy("bucket").applyInArrow(lean_group(_met(rule)), "sig long, node long, often boolean"))
    members = regions(rule, met, reps)
    joined = checkpointed(_linked(rule, present, members, reps))
    links = joined.groupBy("set_key").agg(F.sum("links").alias("links"))
    roots = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = reps.select("set_key", "node", "rep", "copies").join(links, "set_key", "left").join(roots, "node", "left")
    known = checkpointed(known.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    least = known.filter("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    known = known.join(least, "root", "left").select("set_key", F.coalesce("least", "rep").alias("least"), "links")
    named_ = F.col("doc_id").isNotNull()
    out = described.join(known, "set_key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(named_, F.coalesce("least", "doc_id")).alias("component_id"), F.when(named_, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row.

    component_id is the smallest id reachable by links, n_links the number of other documents linked to this one (equal
    sets included). Null texts count as empty; empty sets link with nothing and keep their own id. Rows without an id
    get no component, and link nothing. Rows that repeat an id are each a document of that id. Other columns are
    not read; an empty table gives no rows.
    """
    return _solved(docs, key, text, rule or Rule()).drop("text_hash")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """The rows of `docs`, all columns, less near duplicates: of each component the row with the smallest id stays.

    Rows are judged by their own text: where an id occurs with several texts, each is a document. Of rows that repeat an
    id with the same text one stays, as of rows without an id that repeat a text; rows without an id are otherwise not
    compared, and those without words all stay. Null texts count as empty. An empty table gives no rows.
    """
    found = _solved(docs, key, text, rule or Rule()).select(F.xxhash64("doc_id", "text_hash").alias("key"), "doc_id", "component_id", "n_shingles")
    found = found.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("component_id") < F.col("doc_id"), F.lit(False))).alias("gone"), F.max(F.col("doc_id").isNull() & (F.col("n_shingles") == 0)).alias("blank"))
    marked = checkpointed(found.filter("gone OR n > 1 AND NOT blank").select("key", "gone"))
    bits = FILTER_SEGMENT
    while bits < min(MAX_FILTER_BITS, 24 * marked.count()):
        bits *= 2
    held = docs.sparkSession.sparkContext.broadcast(node_filter(marked.select(F.col("key").alias("node")), bits))

    @F.pandas_udf("boolean")
    def marked_maybe(keys):
        on, ok = np.frombuffer(held.value, np.uint8), np.ones(len(keys), bool)
        for s in _slots(keys.to_numpy(), bits):
            ok &= (on[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        return type(keys)(ok)

    # only rows that the filter marks are shuffled; the rest pass straight through
    own, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.withColumn(own, F.xxhash64(F.col(f"`{key}`").cast("long"), F.xxhash64(t)))
    suspects = rows.filter(marked_maybe(own)).join(marked.select(F.col("key").alias(own), F.col("gone").alias(gone)), own, "left")
    single = suspects.filter(F.col(gone).isNull())
    repeated = suspects.filter(~F.col(gone)).dropDuplicates([own])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(~marked_maybe(own)).select(*columns).unionByName(single.select(*columns)).unionByName(repeated.select(*columns))


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r(x, y) AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), k AS (
  SELECT x, min(y) AS least FROM r GROUP BY x
), d AS (
  SELECT x, count(*) AS links FROM l GROUP BY x
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(k.least, w.doc_id)) AS component_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.x = w.doc_id LEFT JOIN d ON d.x = w.doc_id
"""
