"""Sharding by a minimax contiguous partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rank_within, text_or_empty

#: Cells of neighbouring texts, in the order of a text's hash, that the driver plans with at first, and into how many those
#: are cut in which a shard may end.
CELLS, FINER = 1 << 14, 1 << 9


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The smallest capacity with which ``sizes``, in order and uncut, fit into so many shards: binary search, greedy check."""

    def fits(capacity: int) -> bool:
        used, room = 1, capacity
        for x in sizes:
            if x > room:
                used, room = used + 1, capacity
                if used > shards:
                    return False
            room -= x
        return True

    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def contiguous_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each size under the smallest capacity.

    A shard is closed once it has its share of what is left, if the rest still fits into the remaining
    shards (which the greedy filling from behind tells), and at the capacity at the latest; so shards
    after a large one don't stay empty.
    """
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    need, room = [0] * (n + 1), 0  # shards that sizes[k:] need at least
    for k in range(n - 1, -1, -1):
        if sizes[k] > room or need[k + 1] == 0:
            need[k], room = need[k + 1] + 1, capacity - sizes[k]
        else:
            need[k], room = need[k + 1], room - sizes[k]
    out, shard, used, left = [], 0, 0, sum(sizes)
    for k, x in enumerate(sizes):
        after = shards - shard - 1
        share = (used + left) / (after + 1)
        if used and after and (used + x > capacity or (used + x / 2 >= share and need[k] <= after)):
            shard, used = shard + 1, 0
        out.append(shard)
        used += x
        left -= x
    return out


@dataclass(frozen=True)
class Piece:
    """Neighbouring texts: those with hashes from ``low`` to below ``high``."""

    low: int
    high: int
    bytes: int
    atomic: bool


def _cut(sized: DataFrame, pieces: Sequence[Piece], n: int) -> list[list[Piece]]:
    """Each piece cut into at most ``n`` of equal width, those without texts left out; one of a single text is atomic. One pass."""
    low, last = (np.array(x, np.int64) for x in ([p.low for p in pieces], [p.high - 1 for p in pieces]))
    steps = [max(1, (p.high - p.low) // n) for p in pieces]
    step = np.array(steps, np.uint64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            piece = np.searchsorted(low, h, side="right") - 1
            inside = (piece >= 0) & (h <= last[piece])
            h, size, piece = h[inside], size[inside], piece[inside]
            cell = np.minimum((h.view(np.uint64) - low[piece].view(np.uint64)) // step[piece], np.uint64(n - 1)).astype(np.int64)
            by = np.lexsort((h, cell, piece))
            h, size, piece, cell = h[by], size[by], piece[by], cell[by]
            if len(h):
                first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (cell[1:] != cell[:-1])])
                end = np.r_[first[1:], len(h)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (piece[first], cell[first], np.add.reduceat(size, first), h[first], h[end])], names=["piece", "cell", "bytes", "first", "last"])

    partial = sized.select("hash", "size").mapInArrow(sums, "piece long, cell long, bytes long, first long, last long")
    rows = partial.groupBy("piece", "cell").agg(F.sum("bytes").alias("bytes"), F.min("first").alias("first"), F.max("last").alias("last")).collect()  # at most n rows a piece
    out: list[list[Piece]] = [[] for _ in pieces]
    for r in sorted(rows, key=lambda r: (r.piece, r.cell)):
        start = pieces[r.piece].low + steps[r.piece] * r.cell
        out[r.piece].append(Piece(start, pieces[r.piece].high if r.cell == n - 1 else start + steps[r.piece], r.bytes, r["first"] == r["last"]))
    return out


def _ends(pieces: Sequence[Piece], capacity: int, shards: int) -> list[int]:
    """The pieces at which a greedy filling of ``shards`` and one more begins a shard."""
    out, room = [], capacity
    for k, p in enumerate(pieces):
        if p.bytes > room:
            out.append(k)
            room = capacity
            if len(out) > shards:
                break
        room -= p.bytes
    return out


def atomic_plan(sized: DataFrame, shards: int) -> list[Piece]:
    """Pieces of ``sized`` (hash, size) of which the smallest capacity is that over single texts.

    First equal cells of all hashes; then all pieces are cut finer at which a filling by the smallest capacity found, or
    by one byte less, begins a shard, until these are single texts: from there on a finer cut changes neither filling.
    """
    (pieces,) = _cut(sized, [Piece(-(1 << 63), 1 << 63, 0, False)], CELLS)
    while True:
        capacity = smallest_capacity([p.bytes for p in pieces], shards)
        coarse = {k for c in (capacity, capacity - 1) for k in _ends(pieces, c, shards)} | {k for k, p in enumerate(pieces) if p.bytes >= capacity}
        coarse = sorted(k for k in coarse if not pieces[k].atomic)
        if not coarse:
            return pieces
        finer = dict(zip(coarse, _cut(sized, [pieces[k] for k in coarse], FINER), strict=True))
        pieces = [q for k, p in enumerate(pieces) for q in finer.get(k, [p])]


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``; the law is ``bytes``.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Groups of equal texts, nulls and empty ones among them,
    are the atoms, in the order of their 64-bit hash (texts of one hash are one atom). The largest shard is as small as an
    uncut sequence of atoms allows; a group of copies larger than a share fills its shard alone. Slots number a shard's
    rows from 0 without gaps, in the order of hash, then doc_id (null last), at every size; of rows that repeat doc_id
    and text any order holds. An empty table gives no rows, and with fewer texts than shards some shards stay empty.
    Other columns are not read, very long texts only for their hashes.

    The driver plans with sums of at most CELLS pieces and FINER more for each place where a shard may end. Rows are
    range-partitioned, hot groups and repeated doc_ids too, and numbered where they lie.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_or_empty()
    sized = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    sized = materialize(sized)
    pieces = atomic_plan(sized, shards)
    cuts = contiguous_cuts([p.bytes for p in pieces], shards)
    starts = [(p.low, s) for k, (p, s) in enumerate(zip(pieces, cuts, strict=True)) if k and s != cuts[k - 1]]  # fewer than shards
    lows, numbers = np.array([x for x, _ in starts], np.int64), np.array([0, *(s for _, s in starts)], np.int32)
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("hash", pa.int64()), ("row", pa.int64()), ("shard", pa.int32())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(numbers[np.searchsorted(lows, b.column(3).to_numpy(), side="right")])], schema=schema)

    dealt = sized.mapInArrow(placed, "doc_id long, size long, text_crc32 long, hash long, row long, shard int")
    return rank_within(dealt, "shard", ["hash", "doc_id", "row"], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
