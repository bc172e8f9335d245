"""Cross-site boilerplate lines by distinct-site spread.

Every line's sites go into a HyperLogLog sketch by aggregation. Lines whose estimate is clearly over or under the
threshold are settled; those near it get an exact distinct count. Lines on enough sites are removed everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, free_name, slices, table

MIN_SITES, SKETCH_BITS = 10, 10
#: Lines whose estimate is within so many standard errors (and BAND sites at least) of the threshold are counted exactly.
ERRORS, BAND = 4.0, 2.0
#: Hashes of removed lines broadcast at once (8 bytes each); more are taken in chunks, each a narrow pass.
CHUNK_LINES = 4_000_000
BLANKS = b" \t\r"


def _hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (line, site) of a partition, in parts of bounded size; rows without a site and blank lines give none."""
    seen: set[tuple[int, int]] = set()

    def out():
        pairs = np.array(sorted(seen), np.int64).reshape(-1, 2)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["line", "site"])

    for b in batches:
        for s in slices(b):
            for text, site in zip(s.column("text").cast(pa.binary()).to_pylist(), s.column("site").cast(pa.binary()).to_pylist()):
                if text and site is not None:
                    h = _hash(site)
                    seen.update((_hash(x), h) for line in text.split(b"\n") if (x := line.strip(BLANKS)))
            if len(seen) > 500_000:
                yield out()
    if seen:
        yield out()


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One column `line`: hashes of the lines that lie on `min_sites` distinct sites or more."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{site}`").cast("string").alias("site"))
    pairs = checkpointed(rows.mapInArrow(_spread, "line long, site long"))
    sketches = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate"))
    band = max(BAND, ERRORS * 1.04 / math.sqrt(1 << SKETCH_BITS) * min_sites)
    sketches = checkpointed(sketches.filter(F.col("estimate") >= min_sites - band))
    sure = sketches.filter(F.col("estimate") > min_sites + band).select("line")
    near = sketches.filter(F.col("estimate") <= min_sites + band).select("line")
    exact = pairs.join(near, "line", "left_semi").groupBy("line", "site").count().groupBy("line").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line"))


def _chunks(lines: DataFrame) -> list:
    """Broadcasts of sorted hashes, CHUNK_LINES each at most."""
    sc, out, held = lines.sparkSession.sparkContext, [], []
    for r in checkpointed(lines).toLocalIterator():
        held.append(r.line)
        if len(held) >= CHUNK_LINES:
            out.append(sc.broadcast(np.sort(np.array(held, np.int64)).tobytes()))
            held = []
    return [*out, sc.broadcast(np.sort(np.array(held, np.int64)).tobytes())] if held or not out else out


def _strip(removed, text: str, first: bool, count: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = np.frombuffer(removed.value, np.int64)
        for b in batches:
            for s in slices(b, text):
                names, columns = list(s.schema.names), list(s.columns)
                k = names.index(text)
                kept, dropped = [], []
                before = [0] * s.num_rows if first else columns.pop(names.index(count)).to_pylist()
                for t in columns[k].cast(pa.binary()).to_pylist():
                    if t is None:
                        kept.append(None)
                        dropped.append(0)
                        continue
                    lines = t.split(b"\n")
                    h = np.array([_hash(x.strip(BLANKS)) for x in lines], np.int64)
                    hit = gone[np.minimum(np.searchsorted(gone, h), max(0, len(gone) - 1))] == h if len(gone) else np.zeros(len(h), bool)
                    for j in np.flatnonzero(hit):
                        hit[j] = bool(lines[j].strip(BLANKS))
                    kept.append(b"\n".join(x for x, y in zip(lines, hit) if not y) if hit.any() else t)
                    dropped.append(int(hit.sum()))
                columns[k] = pa.array(kept, pa.binary()).cast(pa.string())
                names = [x for x in names if x != count]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([a + z for a, z in zip(before, dropped)], pa.int64())], [*names, count])

    return run


def remove_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, count: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, without boilerplate lines; the last column has the number of lines removed.

    It is named `count`; without a name, _removed_lines with as many underscores behind it as make it a new name.

    Lines are compared without blanks at their ends; blank lines stay. Null texts stay null. Rows without a site add no
    site, but lose boilerplate lines too. A line repeated within one site counts that site once. Empty tables stay empty.
    """
    count = count or free_name(docs, "_removed_lines")
    if count.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column is named {count}; pass another name for the count")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{count}` long"
    for k, chunk in enumerate(_chunks(boilerplate(docs, text, site, min_sites))):
        docs = docs.mapInArrow(_strip(chunk, text, k == 0, count), schema)
    return docs


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_sha256 for each row; see remove_lines. Null texts have no lines and the digest of the empty text."""
    rows = docs.select("doc_id", "text", "source").withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    out = remove_lines(rows, min_sites=min_sites, count="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(bare) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bare IS NULL), '') AS clean
  FROM l LEFT JOIN b ON trim(line, ' ' || chr(9) || chr(13)) = bare GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(clean, '')) AS clean_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""
