"""The prefix trie of all conversations, built family by family and merged."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Conversations of a family, and the most turns that a member takes from its base, less one.
FAMILY, HEADS = 100, 6
_NOTHING = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()


def _child(parent: bytes, role: bytes, text: bytes) -> bytes:
    """128 bits that stand for a sequence of turns: those of the sequence before, and the last turn."""
    h = hashlib.blake2b(parent, digest_size=16)
    h.update(len(role).to_bytes(8, "little"))
    h.update(role)
    h.update(text)
    return h.digest()


_FAMILY = [("base", "long"), ("at", "long"), ("up", "long"), ("node_a", "long"), ("node_b", "long"), ("over_a", "long"), ("over_b", "long"), ("depth", "long"), ("first", "long"), ("n", "long"), ("size", "long"), ("ends", "string")]
_FAMILY_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in _FAMILY])


class _Family:
    """The trie of one family: a node for each different prefix of its rebuilt conversations, parents before children."""

    def __init__(self, base: int):
        self.base, self.heads = base, []
        self.place = {_ROOT: 0}
        self.nodes: list[list] = [[-1, _ROOT, 0, None, 0, 0]]  # parent's place, key, depth, smallest member, members, code points
        self.ends: dict[int, list[int]] = {}

    def begin(self, conv: int, take: int) -> None:
        self.conv, self.take, self.own, self.now = conv, take, 0, 0
        self._count()
        if conv != self.base:
            for role, text in self.heads[:take]:
                self._step(role, text)

    def _count(self) -> None:
        node = self.nodes[self.now]
        node[3] = self.conv if node[3] is None else min(node[3], self.conv)
        node[4] += 1

    def _step(self, role: str, text: str) -> None:
        key = _child(self.nodes[self.now][1], role.encode(), text.encode())
        place = self.place.get(key)
        if place is None:
            place = self.place[key] = len(self.nodes)
            self.nodes.append([self.now, key, self.nodes[self.now][2] + 1, None, 0, len(text)])
        self.now = place
        self._count()

    def add(self, role: str, text: str) -> None:
        self.own += 1
        if self.conv == self.base:
            if len(self.heads) < HEADS - 1:
                self.heads.append((role, text))
            self._step(role, text)
        elif self.own > self.take:
            self._step(role, text)

    def end(self) -> None:
        self.ends.setdefault(self.now, []).append(self.conv)

    def batches(self, most: int = 20000) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.nodes), most):
            part = self.nodes[k : k + most]
            keys = np.frombuffer(b"".join(x[1] for x in part), "<i8").reshape(-1, 2)
            over = np.frombuffer(b"".join(self.nodes[x[0]][1] if x[0] >= 0 else bytes(16) for x in part), "<i8").reshape(-1, 2)
            ends = [",".join(map(str, sorted(self.ends.get(k + j, ())))) for j in range(len(part))]
            plain = [[self.base] * len(part), range(k, k + len(part)), [x[0] for x in part], keys[:, 0], keys[:, 1], over[:, 0], over[:, 1], *([x[j] for x in part] for j in (2, 3, 4, 5)), ends]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(plain, _FAMILY_SCHEMA, strict=True)], schema=_FAMILY_SCHEMA)


def family_nodes(conversations: DataFrame) -> DataFrame:
    """A row for each node of each family's trie: its place and its parent's, its key and its parent's, depth, smallest member, members, code points, members that end there.

    Conversations are brought together by the id of their base, ``conv_id - conv_id % 100``, whose first turns come first, so that a
    task reads rows as a stream and holds one family's nodes, not its texts.
    """
    id_ = F.col("conv_id").cast("long")
    base = id_ - id_ % FAMILY
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where(id_.isNotNull()).select(base.alias("base"), id_.alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.crc32(id_.cast("string")) % HEADS).alias("take"))
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, conv = None, None
        for b in batches:
            for base, id_, role, text, take in zip(*(b.column(c).to_pylist() for c in ("base", "conv_id", "role", "text", "take")), strict=True):
                if family is None or base != family.base or id_ != conv:
                    if family is not None:
                        family.end()
                        if base != family.base:
                            yield from family.batches()
                            family = None
                    family = family or _Family(base)
                    conv = id_
                    family.begin(id_, take)
                family.add(role, text)
        if family is not None:
            family.end()
            yield from family.batches()

    return rows.repartition("base").sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FAMILY))


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """Sums of ``saved`` and ``leaf`` over the subtree of each node within its family: (node_a, node_b, saved, leaf)."""
    schema = pa.schema([(n, pa.int64()) for n in ("node_a", "node_b", "saved", "leaf")])

    def sums(part: list[np.ndarray]) -> pa.RecordBatch:
        _, at, up, a, b, saved, leaf = part
        up, saved, leaf = up.tolist(), saved.tolist(), leaf.tolist()
        for k in range(len(at) - 1, 0, -1):  # children after their parents, so backwards each is complete when it is added
            saved[up[k]] += saved[k]
            leaf[up[k]] += leaf[k]
        return pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, saved, leaf)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = [0, *(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part = [c[i:j] for c in columns]
                if held and held[0][0][0] != part[0][0]:
                    yield sums([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                held.append(part)
        if held:
            yield sums([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = rows.select("base", "at", "up", "node_a", "node_b", "saved", "leaf").repartition("base").sortWithinPartitions("base", "at")
    return dealt.mapInArrow(run, "node_a long, node_b long, saved long, leaf long")


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of all ids that end at a node: families hold ranges of ids that don't overlap, so theirs follow each other in a stream."""
    schema = pa.schema([("node_a", pa.int64()), ("node_b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("node_a", "node_b", "ends")), strict=True):
                if (a, b) != now:
                    if digest is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        if digest is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((*now, digest.hexdigest()), schema, strict=True)], schema=schema)

    dealt = ends.where("ends <> ''").select("node_a", "node_b", "base", "ends").repartition("node_a", "node_b").sortWithinPartitions("node_a", "node_b", "base")
    return dealt.mapInArrow(run, "node_a long, node_b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each different beginning of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the node's key (node_a, node_b) with its parent's (over_a, over_b).

    Conversation c is rebuilt from the first h turns of its family's base, h being the crc32 of its id modulo 6, and its own turns after
    its first h. Turns are ordered with nulls first, those of one turn by role and text; null roles and texts are empty, empty texts are
    turns too. Rows without a conv_id belong to no conversation. An empty table has no nodes. Conversations that are equal, or whose rows
    are repeated, count each. Other columns, whatever their names, are not read. Very long texts are read whole.

    Texts are shuffled once, by family; then only families' nodes are. A task holds the nodes of one family. A node that many families
    share has a row for each, which are combined before they are shuffled; joins are of kept tables, whose hot keys adaptive execution cuts.
    """
    key, over = ["node_a", "node_b"], ["over_a", "over_b"]
    family = materialize(family_nodes(conversations))
    merged = materialize(family.groupBy(*key).agg(F.min("first").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), *[F.min(c).alias(c) for c in over]))
    children = merged.where("depth > 0").groupBy(*over).agg(F.count("*").alias("n_children")).select(F.col("over_a").alias("node_a"), F.col("over_b").alias("node_b"), "n_children")
    parents = merged.select(F.col("node_a").alias("over_a"), F.col("node_b").alias("over_b"), F.col("conv_id").alias("parent_conv_id"))
    known = materialize(merged.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # each node is counted once, in the family of its smallest member
    own = (F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base")).cast("long")
    weighed = family.join(known.select(*key, "conv_id", "n_children"), key).withColumns({"saved": (F.col("n") - own) * F.col("size"), "leaf": own * (F.col("n_children") == 0).cast("long")})
    sums = materialize(_subtree_sums(weighed).groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")))
    out = known.join(sums, key).join(_digests(family), key, "left").join(parents, over, "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"), *key, *over)
