"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, documents, documents a sequence, first sequence, offset).

    Sequences of like content are one group, filled together; placing the documents of a length splits at
    most one group, so the plan has a few rows a length however many documents there are.
    """
    # groups by room left: [sequences, first sequence]
    groups: dict[int, list[list[int]]] = {}
    rooms: list[int] = []
    plan, sequences = [], 0

    def keep(room: int, n: int, first: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([n, first])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                n, first = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, full, first)
            if full < n:
                if left:
                    plan.append((length, rank, left, left, first + full, capacity - room))
                    keep(room - left * length, 1, first + full)
                    rank, left, full = rank + left, 0, full + 1
                keep(room, n - full, first + full)
    return plan


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what doesn't fill a sequence."""
    head = length % capacity
    return ([(0, head)] if head else []) + [(k, capacity) for k in range(head, length, capacity)]


#: Tokenizers of this worker process by file.
_loaded: dict = {}


def _encoder(vocabulary: str):
    if vocabulary not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _loaded[vocabulary]


def _ids(vocabulary: str, text: str) -> list[int]:
    """Token ids of a text; where tiktoken's pattern runs out of stack (runs of about a million blanks), those of the ``tokenizers`` file."""
    try:
        return _encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        file = vocabulary.rsplit(".", 1)[0] + ".json"
        if file not in _loaded:
            import public_tokenizers
            from tokenizers import Tokenizer

            _loaded[file] = Tokenizer.from_file(public_tokenizers.path(file))
        return _loaded[file].encode(text, add_special_tokens=False).ids


def _nth(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rank of each size among the equal ones of its task so far, from 0; ``counts`` is what the task has had."""
    by = np.argsort(sizes, kind="stable")
    ordered = sizes[by]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    runs = np.diff(np.r_[starts, len(ordered)])
    rank = np.empty(len(sizes), np.int64)
    rank[by] = np.arange(len(ordered)) - np.repeat(starts, runs) + counts[ordered]
    counts[ordered[starts]] += runs
    return rank


#: Characters of texts whose pieces a task holds before it hands them on, besides one longer text.
CHUNK_CHARS = 2 << 20


def _pieces(vocabulary: str, end_id: int, capacity: int, keep_ids: bool):
    """Batches of (doc_id, text) as pieces, numbered: columns c0 to c4 (c5), size and nth, as :func:`pack` keeps them."""
    schema = pa.schema([("c0", pa.int64()), ("c1", pa.int32()), ("c2", pa.int64()), ("c3", pa.int64()), ("c4", pa.int64()), *[("c5", pa.binary())] * keep_ids, ("size", pa.int64()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)

        def written(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * (len(schema) - 2)
            sizes = np.array(columns[3], np.int64)
            columns += [sizes, _nth(counts, sizes) if out else sizes]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        out: list[tuple] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                plain = text.as_py() or ""
                ids = np.array([*_ids(vocabulary, plain), end_id], "<u4")
                out += ((doc.as_py(), k, start, n, zlib.crc32(part := ids[start : start + n].tobytes()), *[part] * keep_ids) for k, (start, n) in enumerate(pieces_of(len(ids), capacity)))
                held += len(plain)
                if held >= CHUNK_CHARS or len(out) >= 5000:
                    yield written(out)
                    out, held = [], 0
        yield written(out)

    return run


def _numbered(capacity: int):
    """Batches with ``nth``, the rank of each row among those of its size in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column(b.schema.get_field_index("size"))
            whole = size.null_count == 0 and (not b.num_rows or (min(size.to_pylist()) >= 1 and max(size.to_pylist()) <= capacity))
            if not whole:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            nth = _nth(counts, size.to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth)], names=[*b.schema.names, "nth"])

    return run


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset, in as few sequences of ``capacity`` as best-fit decreasing finds.

    ``length`` is from 1 to ``capacity``; rows outside raise. Any other columns stay, whatever their names, but sequence_id
    and offset are replaced. Documents find their slots by their rank within their length, which may follow any order of the rows: they
    are numbered where they lie while they are written, once, and never shuffled, however hot a length is. Only counts are added up:
    of lengths in the driver, at most ``capacity`` of them; of lengths by task for the rank at which each task begins, which
    are joined by their measured size.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    sized = pieces.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{length}`").cast("long").alias("size"))
    return _placed(sized.mapInArrow(_numbered(capacity), sized.withColumn("nth", F.lit(0).cast("long")).schema), columns, capacity)


def _placed(numbered: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """Rows (c0, c1, .. for ``columns``, size, nth) as they are numbered by their tasks, with their slots."""
    rows = materialize(numbered.withColumn("task", F.spark_partition_id()))
    held = materialize(rows.groupBy("task", "size").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in held.groupBy("size").agg(F.sum("n")).collect()}
    plan = plan_best_fit(counts, capacity)
    slots = F.broadcast(numbered.sparkSession.createDataFrame([(x[0], x[1], x[1] + x[2], *x[3:]) for x in plan], "size long, low long, high long, each long, first long, at long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(held.select("task", "size", before.alias("before")), ["task", "size"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = ranked.join(slots, "size").where("rank >= low and rank < high").withColumn("k", F.col("rank") - F.col("low"))
    sequence, offset = F.col("first") + F.expr("k div each"), F.col("at") + F.col("k") % F.col("each") * F.col("size")
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each row of ``docs``.

    A document is its token ids and then ``end_id``; null and empty texts are ``end_id`` alone. Only documents
    longer than ``capacity`` are cut, into full pieces after a first one that may be shorter. Rows that repeat a
    doc_id are packed once each, null doc_ids too. An empty table gives no rows. Texts are encoded whole. Other columns are not read. With ``keep_ids`` a
    piece's ids come too, as little-endian 32-bit integers.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    form = "c0 long, c1 int, c2 long, c3 long, c4 long" + ", c5 binary" * keep_ids + ", size long, nth long"
    return _placed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, end_id, capacity, keep_ids), form), columns, capacity)
