"""Pieces shared by the training-data operators: table access, tokens, hashes, shared-folder checkpoints."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir  # noqa: F401

#: Texts are worked on in slices of about so many bytes, so that memory does not follow the batch size.
SLICE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder, in a folder for each value of `by`, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _given_back() -> None:
    """Return what is free in this process to the system: workers are used again, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function over batches that gives memory back at its end."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _given_back()

    return over


def lean_group(run):
    """The same for a function of a group's table."""

    def over(t: pa.Table) -> pa.Table:
        out = run(t)
        _given_back()
        return out

    return over


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id has remainder null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % modulus


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether a row is held out; rows without an id are not (they carry no label either)."""
    return F.coalesce(crc_remainder(doc_id, modulus) == remainder, F.lit(False))


def slices(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay near `size`, SLICE_BYTES if not given (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(sizes, dtype=np.int64), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + (size or SLICE_BYTES), "right")))
        yield batch.slice(start, stop - start)
        start, total = stop, int(ends[stop - 1])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: offsets by text, a vocabulary index for each word, the vocabulary."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:  # white space at either end leaves an empty piece
        real = ids != empty
        owner = np.repeat(np.arange(len(lengths)), lengths)[real]
        lengths, ids = np.bincount(owner, minlength=len(lengths)).astype(np.int64), ids[real]
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), ids, coded.dictionary


def _bytes_of(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    vocabulary = vocabulary.cast(pa.large_binary())
    _, offsets, data = vocabulary.buffers()
    ends = np.frombuffer(offsets, np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def hashed(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number for each byte at its place, scrambled with the length."""
    if not len(vocabulary):
        return np.empty(0, np.uint64)
    ends, data = _bytes_of(vocabulary)
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    size = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], size)
    number = _PLACES[(place & 63) << 8 | data]
    far = np.flatnonzero(place > 63)  # longer words: later rounds of the table are scaled
    if len(far):
        number[far] *= mixed((place[far] >> 6).astype(np.uint64))
    np.cumsum(number, dtype=np.uint64, out=(whole := np.zeros(len(data) + 1, np.uint64))[1:])
    sums = whole[ends[1:]] - whole[ends[:-1]]
    return mixed(sums + size.astype(np.uint64) * GOLDEN)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte at each of 64 places.
_PLACES = mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * GOLDEN)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n consecutive word hashes (windows may cross texts; the caller drops those)."""
    out = mixed(hashes[: len(hashes) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mixed(out * GOLDEN + hashes[k : len(hashes) - n + 1 + k])
    return out
