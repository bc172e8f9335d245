"""Mixing sources to target weights by a splitting tree of exact block quotas.

Each source's documents are dealt by hash into blocks. Whole passes over a source and a permuted prefix of its
blocks make up its target. A tree over the output shards halves the block counts again and again by multivariate
hypergeometric draws, which gives every shard an exact quota of blocks from each source; the shards then own disjoint
ranges of the permuted blocks. Inside its shard every draw has a rank: the order of a local shuffle by hash, numbered in
cells so that no task orders a whole shard. DataFrame functions only on the executors; the driver sees a row per source.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

WEIGHTS, MOST, BLOCK_WORDS, SHARDS, SEED = (5.0, 2.0, 1.0), 3.0, 65_536, 16, "mix-1"
#: Blocks of a source at most: a larger source has larger blocks, so that one task can order them.
MAX_BLOCKS = 100_000
#: Draws of a shard are ranked in cells of about so many; rows are gathered in cells of about so many words.
CELL_DRAWS, CELL_WORDS = 50_000, 4_000_000
#: Rows of the source table that may come to the driver for the tree.
MAX_SOURCES = 100_000
#: Rows (of under 100 bytes) that a broadcast side may have.
BROADCAST_ROWS = 200_000
#: Passes that fill a source's last block row by row.
FILL_ROUNDS = 4


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text (null: 0)."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.octet_length(F.translate(squeezed, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Source -> target. Sources by code point, null last, weigh `weights` repeating; capped ones hand their excess on by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {s: 0.0 for s in order}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not over:
            out.update({s: unit * weight[s] for s in free})
            break
        out.update({s: most * sizes[s] for s in over})
        left -= sum(out[s] for s in free if s in over)
        free = [s for s in free if s not in over]
    return out


def _hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement: inversion from the mode, exact up to rounding."""
    import math

    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = lambda k: math.exp(choose(good, k) + choose(bad, n - k) - choose(good + bad, n))
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    u, a, b = rng.random(), mode, mode + 1
    pa, pb = p(a), p(b) if b <= hi else 0.0
    while True:
        if a >= lo and (pa >= pb or b > hi):
            u -= pa
            if u <= 0:
                return a
            a -= 1
            pa = p(a) if a >= lo else 0.0
        elif b <= hi:
            u -= pb
            if u <= 0:
                return b
            b += 1
            pb = p(b) if b <= hi else 0.0
        else:
            return mode


def splitting_tree(counts: dict, shards: int, rng: random.Random) -> list[dict]:
    """Split block counts by source among `shards` shards of near equal block totals."""
    if shards == 1:
        return [counts]
    half = shards // 2
    total = sum(counts.values())
    draw = left_total = total * half // shards
    left, rest = {}, total
    for s, n in counts.items():
        left[s] = _hypergeometric(rng, n, rest - n, draw)
        rest, draw = rest - n, draw - left[s]
    assert sum(left.values()) == left_total
    right = {s: n - left[s] for s, n in counts.items()}
    return splitting_tree(left, half, rng) + splitting_tree(right, shards - half, rng)


def _mark(key: Column, text: Column, seed: str) -> Column:
    """A number of a row that its id and text decide."""
    return F.xxhash64(key.cast("string"), F.coalesce(text.cast("string"), F.lit("")), F.lit(seed))


def _block(mark: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(mark), n_blocks)


def plan(docs: DataFrame, key: str, text: str, source: str, shards: int, seed: str, weights=WEIGHTS, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows keyed for the mix, decisions by block, decisions by row of the blocks cut in two).

    The decisions are (source, block) -> times taken and shards; a source's last block is drawn by row.
    """
    spark = docs.sparkSession
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), k.alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(t.cast("string")).alias("size"), _mark(k, t, seed).alias("mark"))
    rows = checkpointed(rows)
    stats = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sizes = {r.source: int(r["size"]) for r in stats}
    goal = targets(sizes, weights, most)
    blocks_of = {s: min(MAX_BLOCKS, max(1, -(-n // BLOCK_WORDS))) for s, n in sizes.items()}
    passes = {s: int(min(most, goal[s] // n)) if n else 0 for s, n in sizes.items()}
    table_ = [(s, sizes[s], goal[s], blocks_of[s], passes[s], float(goal[s] - passes[s] * sizes[s])) for s in sizes]
    sources = F.broadcast(spark.createDataFrame(table_, "source string, source_size long, target double, n_blocks long, passes int, rest double"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    keyed = rows.join(sources, same(rows, sources)).drop(sources["source"])
    keyed = keyed.withColumn("block", _block(F.col("mark"), F.col("n_blocks")))
    # permuted blocks of each source: pre-aggregated, about BLOCK_WORDS words a row
    blocks = keyed.groupBy("source", "block", "passes", "rest", "n_blocks").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + "/permute")), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(permuted)).withColumn("at", F.row_number().over(permuted) - 1)
    whole = F.col("upto") <= F.col("rest")
    blocks = blocks.withColumn("extra", whole.cast("int")).withColumn("cut", ~whole & (F.col("upto") - F.col("words") < F.col("rest")))
    blocks = checkpointed(blocks.withColumn("need", F.when(F.col("cut"), F.col("rest") - F.col("upto") + F.col("words"))))
    # exact quotas of block draws by source, then the tree
    quota = blocks.groupBy("source").agg(F.sum(F.col("passes") + F.col("extra") + F.col("cut").cast("int")).alias("n")).collect()
    counts = {r.source: int(r.n) for r in sorted(quota, key=lambda r: (r.source is None, r.source or ""))}
    tree = splitting_tree(counts, shards, random.Random(seed))
    bounds = []
    for s in counts:
        upto, ends = 0, []
        for part in tree:
            upto += part[s]
            ends.append(upto)
        bounds.append((s, ends))
    ends = F.broadcast(spark.createDataFrame(bounds, "source string, ends array<long>"))
    draws = F.col("passes") + F.col("extra") + F.col("cut").cast("int")
    turn = Window.partitionBy("source").orderBy("at")
    blocks = blocks.withColumn("first", F.sum(draws).over(turn) - draws)
    blocks = blocks.join(ends, same(blocks, ends)).drop(ends["source"])
    shard_of = lambda i: F.size(F.filter("ends", lambda e: e <= F.col("first") + i)).cast("int")
    blocks = blocks.withColumn("shards", F.when(draws > 0, F.transform(F.sequence(F.lit(0), draws - 1), shard_of)).otherwise(F.array().cast("array<int>")))
    blocks = checkpointed(blocks.select("source", "block", "extra", "cut", "need", "shards"))
    # the block at a source's boundary is drawn by row: one block a source
    cut = blocks.filter("cut").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "need")
    inside = keyed.join(F.broadcast(cut), keyed["source"].eqNullSafe(cut["_s"]) & (keyed["block"] == cut["_b"]))
    order = Window.partitionBy("source").orderBy(F.xxhash64("mark", F.lit(seed + "/row")), "mark")
    pool = inside.groupBy("source", "mark", "need").agg(F.sum("size").alias("words")).withColumn("drawn", F.lit(0))
    for _ in range(FILL_ROUNDS):
        # rows in random order while they fit; what is still needed is filled from those that were passed over
        open_ = (F.col("drawn") == 0) & (F.col("words") <= F.col("need"))
        pool = pool.withColumn("_upto", F.sum(F.when(open_, F.col("words")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        pool = pool.withColumn("_take", open_ & (F.col("_upto") <= F.col("need")))
        got = F.sum(F.when(F.col("_take"), F.col("words")).otherwise(0)).over(Window.partitionBy("source"))
        pool = pool.withColumn("_got", got).withColumn("need", F.col("need") - F.col("_got")).withColumn("drawn", F.when(F.col("_take"), 1).otherwise(F.col("drawn")))
    return keyed, blocks, checkpointed(pool.filter("drawn = 1").select("source", "mark", "drawn"))


def _small(df: DataFrame) -> DataFrame:
    """A side to broadcast if it has BROADCAST_ROWS rows at most; else the join shuffles both sides on their keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _decided(keyed: DataFrame, blocks: DataFrame, inside: DataFrame) -> DataFrame:
    b = _small(blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "extra", "cut", "shards"))
    out = keyed.join(b, keyed["source"].eqNullSafe(b["_s"]) & (keyed["block"] == b["_b"]), "left")
    i = _small(inside.select(F.col("source").alias("_is"), F.col("mark").alias("_mark"), "drawn"))
    out = out.join(i, F.col("cut") & out["source"].eqNullSafe(i["_is"]) & (out["mark"] == i["_mark"]), "left")
    times = F.col("passes") + F.col("extra") + F.coalesce("drawn", F.lit(0))
    return out.withColumn("times", times.cast("int")).withColumn("shards", F.slice("shards", F.lit(1), F.col("times")))


def _turn(mark: Column, time: Column, seed: str) -> Column:
    """A draw's place in its shard's local shuffle: 0 to 2**62, at random."""
    return F.shiftrightunsigned(F.xxhash64(mark, time.cast("int"), F.lit(seed + "/local")), 2)


def _cell(turn: Column, cells: Column | int) -> Column:
    return F.floor(turn / F.lit(float(1 << 62)) * cells).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards, ranks (a shard and a rank in it for each time the row is taken) for each row.

    Null texts have size 0, the null source is a source of its own, last in order. Rows of size 0 are taken as often
    as their block and add no words. Equal rows (same id and text) are drawn together and rank next to each other. No row
    is taken over three times; a source without words takes none. The ranks of a shard are gapless from 0. Other columns
    are not read; an empty table gives no rows.
    """
    keyed, blocks, inside = plan(docs, key, text, source, shards, seed)
    rows = checkpointed(_decided(keyed, blocks, inside).select("row", "doc_id", "mark", "size", "source_size", "target", "times", "shards"))
    draws = rows.filter("times > 0").select("row", "mark", F.posexplode("shards").alias("time", "shard")).withColumn("turn", _turn(F.col("mark"), F.col("time"), seed))
    n_draws = rows.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    draws = draws.withColumn("cell", _cell(F.col("turn"), int(n_draws) // (shards * CELL_DRAWS) + 1))
    cells = draws.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    draws = draws.withColumn("at", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("turn", "mark", "row")) - 1).join(before, ["shard", "cell"])
    ranks = draws.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("time", (F.col("before") + F.col("at")).cast("long").alias("rank")))).alias("r"))
    out = rows.join(ranks.select("row", F.col("r.rank").alias("ranks")), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "shards", F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it: gathered by output shard, in the order of the shard's local shuffle.

    See `mix` for nulls, empty texts, ties and repeated rows; columns may have any names. An empty table gives no rows.
    """
    keyed, blocks, inside = plan(docs, key, text, source, shards, seed)
    mixed = _decided(keyed, blocks, inside)
    # what is decided by source, block and row is small; the texts are joined with it by broadcast where it is
    per_source = F.broadcast(keyed.select(F.col("source").alias("s"), F.col("n_blocks").alias("n"), F.col("passes").alias("p")).distinct())
    per_block = _small(blocks.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "extra", "cut", F.col("shards").alias("own")))
    per_row = _small(inside.select(F.col("source").alias("rs"), F.col("mark").alias("rm"), "drawn"))
    left = docs.select(F.struct("*").alias("d"), F.col(f"`{source}`").cast("string").alias("src"), _mark(F.col(f"`{key}`"), F.col(f"`{text}`"), seed).alias("mark"))
    left = left.join(per_source, left["src"].eqNullSafe(per_source["s"])).withColumn("block", _block(F.col("mark"), F.col("n")))
    left = left.join(per_block, left["src"].eqNullSafe(per_block["bs"]) & (left["block"] == per_block["bb"]), "left")
    left = left.join(per_row, F.col("cut") & left["src"].eqNullSafe(per_row["rs"]) & (left["mark"] == per_row["rm"]), "left")
    times = (F.col("p") + F.col("extra") + F.coalesce("drawn", F.lit(0))).cast("int")
    drawn = left.select("d", "mark", F.posexplode(F.slice("own", F.lit(1), times)).alias("time", "shard")).withColumn("turn", _turn(F.col("mark"), F.col("time"), seed))
    words = mixed.agg(F.coalesce(F.sum(F.col("size") * F.col("times")), F.lit(0))).first()[0]
    drawn = drawn.withColumn("cell", _cell(F.col("turn"), int(words) // (shards * CELL_WORDS) + 1))
    gathered = drawn.repartition(F.col("shard"), F.col("cell")).sortWithinPartitions("shard", "turn", "mark")
    return gathered.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


def op9_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
