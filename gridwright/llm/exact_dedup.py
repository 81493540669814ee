"""Exact deduplication by two-pass Bloom filtering."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, free_names, materialize, tables_dir, text_or_empty

#: Bits of a filter block (one cache line), bits set for a hash, blocks of a segment (one segment: 1 MiB of bits).
BLOCK_BITS, HASH_BITS, SEGMENT_BLOCKS = 512, 4, 16384
#: Filter bits for each row.
BITS_PER_ROW = 16
#: Blocks of the filter of seen hashes that are folded into one of the filter of repeated ones, which are few.
FOLD = 8
#: Bytes of the filter of repeated hashes that are broadcast at once; a larger filter is tested slice by slice.
BROADCAST_FILTER_BYTES = 32 << 20

_SEEN = pa.schema([("block", pa.int64()), ("bits", pa.int64()), ("twice", pa.bool_())])
_FILTER = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.int64()))])


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hash at most once a batch, with a mark if it was there twice: a hot text doesn't load its segment."""
    for b in batches:
        pairs = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
        if len(pairs):
            pairs, n = np.unique(pairs, axis=0, return_counts=True)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n > 1)], schema=_SEEN)


def _positions(block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.stack([block * BLOCK_BITS + ((bits >> (9 * k)) & (BLOCK_BITS - 1)) for k in range(HASH_BITS)], axis=1)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a segment after the other: a filter of hashes seen, and from it the filter of hashes seen again."""
    segment, once, again = None, None, None

    def blocks():
        folded = again.reshape(-1, FOLD, BLOCK_BITS).any(axis=1)
        hit = np.flatnonzero(folded.any(axis=1))
        words = np.packbits(folded[hit], axis=1, bitorder="little").view(np.int64)
        return pa.record_batch([pa.array(hit + segment * (SEGMENT_BLOCKS // FOLD)), pa.array(list(words), _FILTER.field("words").type)], schema=_FILTER)

    for b in batches:
        block, bits, twice = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for s in np.unique(block // SEGMENT_BLOCKS):
            if s != segment:
                if segment is not None:
                    yield blocks()
                segment, once, again = s, np.zeros(SEGMENT_BLOCKS * BLOCK_BITS, bool), np.zeros(SEGMENT_BLOCKS * BLOCK_BITS, bool)
            own = block // SEGMENT_BLOCKS == s
            mine, their, rows = block[own], bits[own], 1 + twice[own].astype(int)
            by = np.lexsort((their, mine))
            mine, their, rows = mine[by], their[by], rows[by]
            first = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (their[1:] != their[:-1])])
            n = np.add.reduceat(rows, first)
            at = _positions(mine[first] - s * SEGMENT_BLOCKS, their[first])
            again[at[(n > 1) | once[at].all(axis=1)].ravel()] = True
            once[at.ravel()] = True
    if segment is not None:
        yield blocks()


def _hashed(df: DataFrame, sha: str, segments: int, block: str, bits: str) -> DataFrame:
    return df.withColumns({block: F.pmod(F.xxhash64(sha), F.lit(segments * SEGMENT_BLOCKS)), bits: F.xxhash64(sha, F.lit(1))})


def repeated_filter(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(block, words): a Bloom filter of the values of ``hashes`` (text_sha256) that may be there twice, and the segments of the filter before.

    Values are dealt as two 64-bit hashes to segments of a filter of all hashes seen, where each is first reduced to one
    row of its batch. Texts are never shuffled.
    """
    segments = max(1, math.ceil(hashes.count() * BITS_PER_ROW / (SEGMENT_BLOCKS * BLOCK_BITS)))
    seen = _hashed(hashes, "text_sha256", segments, "block", "bits").select("block", "bits").mapInArrow(_once_per_batch, "block long, bits long, twice boolean")
    segment = F.floor(F.col("block") / SEGMENT_BLOCKS)
    return materialize(seen.repartition(segment).sortWithinPartitions("block").mapInArrow(_repeated, "block long, words array<long>")), segments


def tested(rows: DataFrame, repeated: DataFrame, segments: int, sha: str, suspect: str) -> DataFrame:
    """``rows`` with the boolean column ``suspect``: whether the filter knows the value of ``sha``. No row is shuffled.

    A filter of up to BROADCAST_FILTER_BYTES is broadcast. For a larger one the rows are written once, each task's sorted
    by block, and each slice of the filter reads, by the statistics of the files, only the pages of its own blocks.
    """
    block, bits, at, words = free_names(rows, 4, "filter")
    hashed = _hashed(rows, sha, segments, block, bits).withColumn(at, F.floor(F.col(block) / FOLD).cast("long"))
    has = [F.expr(f"(shiftright({words}[cast((shiftright({bits}, {9 * k}) & {BLOCK_BITS - 1}) div 64 as int)], cast((shiftright({bits}, {9 * k}) & 63) as int)) & 1) = 1") for k in range(HASH_BITS)]
    hit = F.coalesce(has[0] & has[1] & has[2] & has[3], F.lit(False)).alias(suspect)
    columns = [F.col(f"`{c}`") for c in rows.columns]

    def test(some: DataFrame, part: DataFrame) -> DataFrame:
        part = part.select(F.col("block").alias(at), F.col("words").alias(words))
        return some.join(F.broadcast(part), at, "left").select(*columns, hit)

    blocks = segments * (SEGMENT_BLOCKS // FOLD)
    slices = math.ceil(repeated.count() * (BLOCK_BITS // 8 + 16) / BROADCAST_FILTER_BYTES)
    if slices <= 1:
        return test(hashed, repeated)
    hashed, path = materialize(hashed.sortWithinPartitions(block)), f"{tables_dir(rows.sparkSession)}/{uuid.uuid4().hex}"
    for k in range(slices):
        low, high = blocks * k // slices, blocks * (k + 1) // slices
        own = hashed.where(F.col(block).between(low * FOLD, high * FOLD - 1))
        test(own, repeated.where(F.col("block").between(low, high - 1))).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*rows.schema, T.StructField(suspect, T.BooleanType())])).parquet(path)


def _digest() -> Column:
    return F.sha2(F.translate(text_or_empty(), ASCII_SPACE, ""), 256)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when they are the same after deleting ASCII white space. The longest original text
    (code points), then the smallest doc_id stays. A null text counts as empty, and all empty texts are
    equal. Rows that repeat a doc_id and its text count in group_size and share their decision; a null
    doc_id is like any other and comes last among ties. Other columns of ``docs`` are not read. An empty table gives no rows.

    Pass 1 leaves a filter of hashes seen twice. Pass 2 tests every row against it in place: only rows that may be
    repeated are shuffled and compared by their whole SHA-256; a false positive merely costs its shuffle.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long"), _digest().alias("text_sha256"), F.length(text_or_empty()).alias("n_code_points")))
    judged = materialize(tested(rows, *repeated_filter(rows.select("text_sha256")), "text_sha256", "suspect"))
    straight = judged.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = judged.where("suspect")
    best = F.min(F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), "doc_id")).getField("doc_id")
    groups = materialize(suspects.groupBy("text_sha256").agg(best.alias("keep_id"), F.count("*").alias("group_size")))
    compared = suspects.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return straight.unionByName(compared)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that :func:`exact_duplicates` keeps; columns as they are.

    Rows are told apart by their text, so one that merely shares a doc_id with a dropped one stays; of rows that repeat
    doc_id and text one stays, by the hash of its other columns. Only rows that may be repeated are shuffled, combined before.
    """
    repeated, segments = repeated_filter(docs.select(_digest().alias("text_sha256")))
    sha, suspect = free_names(docs, 2, "exact")
    judged = tested(docs.withColumn(sha, _digest()), repeated, segments, sha, suspect)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(-F.length(text_or_empty()), F.col("doc_id").isNull(), "doc_id", F.xxhash64(*columns))
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    best = judged.where(F.col(suspect)).groupBy(sha).agg(F.min_by(row, order).alias("best"))
    return judged.where(~F.col(suspect)).select(*columns).union(best.select(*[F.col(f"best.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
