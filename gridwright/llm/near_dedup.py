"""MinHash near-deduplication with an LSH forest.

1. Each text becomes its set of word shingles and a MinHash signature; equal sets are one class.
2. Forest: a class has a place in several sorted orders of signatures. Entries that share the first components of an
   order (a region) are candidates. Small regions are compared whole. Large ones are range-partitioned in their order, go
   deeper component by component, and at every depth neighbours by longest common prefix and leaders are compared.
3. Clusters of candidates: links are confirmed on full sets, in small clusters of all pairs, in large ones in sliding
   blocks and against the best linked members.
4. What steps 2 and 3 leave out in large regions and clusters is found exactly: their classes are joined by a prefix filter
   (linked sets share one of their first shingles in any fixed order; frequent ones come last). Pairs whose bitmaps rule a
   link out are passed over, classes of one component are not compared again, all other pairs are confirmed on full sets.

So two linked sets are missed only if no order puts them into one region, or their estimate is off by ESTIMATE_SLACK: of
links just at 85 percent less than one in a million each. No region, cluster or list of partners has a cap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, materialize

#: Orders (trees), signature components of each, components that a region shares at least.
TREES, DEPTH, BASE_DEPTH = 16, 8, 3
#: Entries of a region that are compared whole; neighbours on each side and leaders in larger ones, before the exact join.
REGION, NEIGHBOURS, LEADERS = 64, 12, 8
#: Estimated similarity (128 components of 8 bits) from which a pair is a candidate, below the threshold.
ESTIMATE_SLACK = 0.15
#: Members of a cluster compared whole; orders of sliding blocks, their half length and the best linked members (hubs) that
#: the others of a larger one meet before the exact join.
WHOLE, BLOCK_ORDERS, HALF_BLOCK, HUBS, HUB_BLOCK, SALTS = 64, 2, 64, 8, 256, 16
#: Entries that one task compares in regions, about.
TASK_ENTRIES = 20_000
#: Classes whose shingles are counted for the order of the prefix filter; the count from which a shingle is frequent, and
#: how many frequent ones are told apart. The order decides the work, not the result.
COUNTED_CLASSES, FREQUENT, MOST_FREQUENT = 10_000, 16, 500_000
#: Classes with a shingle in their prefix that are compared with each other at once; more are cut into bands and blocks, dealt in pairs.
POSTING = 2048
#: Bits of a set's bitmap, in which each shingle turns one over.
BITMAP = 1024

_M = TREES * DEPTH
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, _M, dtype=np.uint64)
_POLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text, A-Z in lower case."""
    got = text.lower().split() if text else []
    if not got:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, got), np.uint64, len(got))
    n = max(1, len(w) - words + 1)
    h = np.full(n, min(len(w), words), np.uint64)
    for k in range(min(words, len(w))):
        h = _mix(h + w[k : k + n] * _POLY[k % len(_POLY)])
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    out = np.full(_M, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 512):
        out = np.minimum(out, ((h[k : k + 512, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return (x.as_py() for x in column)


def _signed(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary()), ("text_md5", pa.string())])

    def run(batches):
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, b.num_rows, 500)):
                n, h1, h2, sig, of = [], [], [], [], []
                for t in _texts(part, "text"):
                    of.append(None if t is None else hashlib.md5(t).hexdigest())
                    h = shingle_hashes(t, words)
                    whole = xxhash.xxh3_128_digest(h.tobytes())
                    a, c = np.frombuffer(whole, np.int64)
                    n.append(len(h)), h1.append(int(a)), h2.append(int(c)), sig.append(signature(h).tobytes() if len(h) else None)
                yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(of, pa.string())], schema=schema)

    return run


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        child = list(self.up)
        found = pd.DataFrame({"src": np.array(child, np.int64), "dst": np.array([self.find(x) for x in child], np.int64)})
        return found[found.src != found.dst]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together, from sorted batches; a run's rows are those of one task."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        cut = np.flatnonzero((b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(b)), cut):
            p = b.iloc[part]
            if held and tuple(held[-1][keys].iloc[-1]) != tuple(p[keys].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(p)
    if held:
        yield pd.concat(held)


def _forest(least: float):
    """Spanning edges of the candidates among entries (tree, p0.., rep, sketch) sorted in their order."""

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.stack([(x == b).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
        return (same / _M - 1 / 256) / (1 - 1 / 256) >= least

    def whole(u: _Union, rep: np.ndarray, sk: np.ndarray) -> None:
        for x, y in zip(*np.nonzero(np.triu(pairs(sk, sk), 1)), strict=True):
            u.join(int(rep[x]), int(rep[y]))

    def region(u: _Union, order: np.ndarray, rep: np.ndarray, sk: np.ndarray, depth: int) -> None:
        if len(rep) <= REGION:
            return whole(u, rep, sk)
        for k in range(1, NEIGHBOURS + 1):
            same = (sk[k:] == sk[:-k]).mean(axis=1)
            for x in np.flatnonzero((same - 1 / 256) / (1 - 1 / 256) >= least):
                u.join(int(rep[x]), int(rep[x + k]))
        rest = np.arange(len(rep))
        for _ in range(LEADERS):
            if len(rest) < 2:
                break
            near = pairs(sk[rest[:1]], sk[rest])[0]
            for x in rest[near]:
                u.join(int(rep[rest[0]]), int(rep[x]))
            near[0] = True
            rest = rest[~near]
        if depth < DEPTH:
            cut = np.flatnonzero(order[1:, depth] != order[:-1, depth]) + 1
            if len(cut) == 0:
                return region_deeper(u, order, rep, sk, depth)
            for part in np.split(np.arange(len(rep)), cut):
                if len(part) > 1:
                    region(u, order[part], rep[part], sk[part], depth + 1)
        return None

    def region_deeper(u, order, rep, sk, depth):
        while depth < DEPTH and (order[:, depth] == order[0, depth]).all():
            depth += 1
        if depth < DEPTH:
            cut = np.flatnonzero(order[1:, depth] != order[:-1, depth]) + 1
            for part in np.split(np.arange(len(rep)), cut):
                if len(part) > 1:
                    region(u, order[part], rep[part], sk[part], depth + 1)

    def run(batches):
        u = _Union()
        for r in _runs(batches, ["tree", "region"]):
            if len(r) > 1:
                order = np.stack([np.frombuffer(x, ">u4") for x in r["place"]])
                region(u, order, r["rep"].to_numpy(), np.stack([np.frombuffer(x, np.uint8) for x in r["sketch"]]), BASE_DEPTH)
            if len(u.up) > 200_000:  # bounded: later tasks join what is cut here
                yield u.edges()
                u = _Union()
        yield u.edges()

    return run


def _links(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets are linked with which of the others (or each other): exact, by products of membership matrices."""
    rest = sets if others is None else others
    every = sets + ([] if others is None else others)
    n = np.array([len(x) for x in every])
    values, at = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), n)
    by = np.argsort(at, kind="stable")
    at, row = at[by], row[by]
    common = np.zeros((len(sets), len(rest)), np.float64)
    for lo in range(0, len(values), 1 << 14):
        a, b = np.searchsorted(at, [lo, lo + (1 << 14)])
        m = np.zeros((len(every), min(1 << 14, len(values) - lo)), np.float32)
        m[row[a:b], at[a:b] - lo] = 1
        common += m[: len(sets)] @ m[len(every) - len(rest) :].T
    size, other = n[: len(sets)], n[len(every) - len(rest) :]
    return 100 * common >= percent * (size[:, None] + other[None] - common)


def _found(u: _Union, degree: dict[int, int], rep: np.ndarray, others: np.ndarray, hit: np.ndarray) -> None:
    for x, y in zip(*np.nonzero(hit), strict=True):
        p, q = int(rep[x]), int(others[y])
        if p != q:
            u.join(p, q)
            degree[p] = degree.get(p, 0) + 1
            degree[q] = degree.get(q, 0) + 1


def _out(u: _Union, degree: dict[int, int]) -> pd.DataFrame:
    edges = u.edges().assign(degree=0)
    return pd.concat([edges, pd.DataFrame({"src": np.array(list(degree), np.int64), "dst": np.array(list(degree), np.int64), "degree": np.array(list(degree.values()), np.int64)})])


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in frame["hashes"]]


def _sliding(percent: int):
    """Links among rows (place.., cluster, rep, hashes) of a cluster in their order, each half block with itself and the one before."""

    def run(batches):
        for r in _runs(batches, ["tree", "cluster"]):
            u, degree, before = _Union(), {}, None
            for k in range(0, len(r), HALF_BLOCK):
                own = r.iloc[k : k + HALF_BLOCK]
                rep, sets = own["rep"].to_numpy(), _sets(own)
                _found(u, degree, rep, rep, np.triu(_links(sets, None, percent), 1))
                if before is not None:
                    _found(u, degree, rep, before[0], _links(sets, before[1], percent))
                before = rep, sets
            yield _out(u, degree)

    return run


def _with_hubs(percent: int):
    def run(batches):
        for r in _runs(batches, ["cluster", "block"]):
            hub = r["hub"].to_numpy(bool)
            if hub.any() and not hub.all():
                u: _Union = _Union()
                _found(u, {}, r["rep"].to_numpy()[~hub], r["rep"].to_numpy()[hub], _links(_sets(r[~hub]), _sets(r[hub]), percent))
                yield u.edges().assign(degree=0)

    return run


def _own_sets(words: int):
    """(row's other columns, hashes) of rows (h1, h2, .., text) whose text is of the class of that digest."""

    def run(batches):
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, b.num_rows, 500)):
                sets = [shingle_hashes(t, words) for t in _texts(part, "text")]
                h1, h2 = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield part, [(k, h) for k, h in enumerate(sets) if tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)) == (h1[k], h2[k])]

    return run


def bitmap(h: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles by their low bits: those of two sets differ in at most as many bits as the sets in shingles."""
    return np.packbits(np.bincount((h & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP).astype(np.uint8) & 1)


def _class_sets(words: int):
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary()), ("bitmap", pa.binary())])

    def run(batches):
        for part, own in _own_sets(words)(batches):
            reps = part.column(2).take(pa.array([k for k, _ in own], pa.int64()))
            yield pa.record_batch([reps, pa.array([h.tobytes() for _, h in own], pa.binary()), pa.array([bitmap(h).tobytes() for _, h in own], pa.binary())], schema=schema)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n): how often a shingle is in the sets of this task, about a million shingles at a time; what is there once isn't frequent and is left out."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

    for b in batches:
        for hashes in b.column(0):
            held.append(np.frombuffer(hashes.as_buffer(), np.int64))
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    yield flush()


def _prefixes(percent: int, frequent: np.ndarray, rank: np.ndarray):
    """(token, rep, component, n, at) of rows (rep, component, hashes): the shingles of a class up to the place where a link must have met one, and their places.

    A link has at least percent / 100 * n shingles in common, so its first common one is among the others and one more.
    """
    names = ["token", "rep", "component", "n", "at"]

    def run(batches):
        for part in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out = [np.empty((5, 0), np.int64)]
            for rep, component, hashes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                h = np.frombuffer(hashes, np.uint64)
                size = len(h) + percent * len(h) // -100 + 1
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    common = frequent[place] == h
                    first = h[~common][:size]
                    if len(first) < size:
                        late = h[common][np.argsort(rank[place[common]], kind="stable")]
                        first = np.concatenate([first, late[: size - len(first)]])
                else:
                    first = h[:size]
                same = np.ones(len(first), np.int64)
                out.append(np.stack([first.view(np.int64), same * rep, same * component, same * len(h), np.arange(len(first))]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=names)

    return run


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of sorted batches as rows of an array, never cut within a value of the first."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = np.stack([c.to_numpy() for c in b.columns]).astype(np.int64)
        now = now if held is None else np.concatenate([held, now], axis=1)
        cut = np.flatnonzero(now[0] != now[0, -1])
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield now[:, :cut]
        held = now[:, cut:]
    if held is not None:
        yield held


def _possible(x: np.ndarray, y: np.ndarray, percent: int, own: bool) -> np.ndarray:
    """Pairs of columns (token, rep, component, n, at) of two components that may be links, if the shingle is their first common one."""
    need = -(percent * (x[3][:, None] + y[3]) // -(100 + percent))
    hit = (np.minimum((x[3] - x[4])[:, None], y[3] - y[4]) >= need) & (x[2][:, None] != y[2])
    i, j = np.nonzero(np.triu(hit, 1) if own else hit)
    return np.unique(np.stack([np.minimum(x[1][i], y[1][j]), np.maximum(x[1][i], y[1][j])]), axis=1)


def _pair_rows(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _postings(percent: int):
    """Pairs (a, b) that may be links from prefixes in the order of their shingles, whose lists are of at most POSTING rows."""

    def run(batches):
        for group in _sorted_groups(batches):
            first = np.flatnonzero(np.r_[True, group[0, 1:] != group[0, :-1]])
            end = np.r_[first[1:], group.shape[1]]
            mixed = np.minimum.reduceat(group[2], first) != np.maximum.reduceat(group[2], first)
            found, held = [np.empty((2, 0), np.int64)], 0
            for lo, hi in zip(first[mixed], end[mixed], strict=True):
                found.append(_possible(group[:, lo:hi], group[:, lo:hi], percent, True))
                held += found[-1].shape[1]
                if held > 1_000_000:
                    yield _pair_rows(np.unique(np.concatenate(found, axis=1), axis=1))
                    found, held = [np.empty((2, 0), np.int64)], 0
            yield _pair_rows(np.unique(np.concatenate(found, axis=1), axis=1))

    return run


def _dealt_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, rep, component, n, at) of long lists as (block, rep, component, n, at, side), so that all pairs that may be links meet in a block.

    A list is cut by size into bands, of which linked sets share one or have neighbouring ones, and into wide rows, whose place
    leaves room for a partner as large as they are, and narrow ones, which can only be linked with smaller sets and so never with
    each other. What is cut is dealt into blocks of about POSTING rows by a hash, and each block that may hold partners of a row gets
    a copy of it. Side 0 meets side 1, side 2 itself. No task sees a list: copies are made where the rows lie.
    """
    band = F.floor(F.ln("n") / (np.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.col("n")
    rows = rows.select("*", band.alias("band"), ((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")).alias("wide"))
    blocks = lambda test: F.ceil(F.count_if(test) / POSTING).cast("int")
    held = rows.groupBy("token", "band").agg(F.struct(blocks(F.col("wide")).alias("wide"), blocks(~F.col("wide")).alias("narrow")).alias("blocks"))
    held = materialize(held.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("held")))  # an entry for each band of sizes
    band, at = F.col("band"), lambda d: F.try_element_at("held", F.col("band") + d)
    there = lambda d, kind: F.coalesce(at(d)[kind], F.lit(0))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("wide"), at(0)["wide"]).otherwise(at(0)["narrow"])).cast("int")

    def meets(n, kind: int, lower: bool):
        """A copy for each of the ``n`` blocks on the other side; kinds tell apart what meets in a band and its neighbour."""
        each = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        low = band if lower or kind < 2 else band - 1
        name = lambda x, y: F.xxhash64("token", low, F.lit(kind), x, y).alias("block")
        if not kind:
            side = lambda o: F.when(own == o, 2).when(own < o, 0).otherwise(1)
            return F.transform(each, lambda o: F.struct(name(F.least(own, o), F.greatest(own, o)), side(o).alias("side")))
        return F.transform(each, lambda o: F.struct(name(own, o) if lower else name(o, own), F.lit(0 if lower else 1).alias("side")))

    wide = F.concat(meets(there(0, "wide"), 0, True), meets(there(0, "narrow"), 1, True), meets(there(1, "wide"), 2, True), meets(there(1, "narrow"), 3, True), meets(there(-1, "wide"), 2, False))
    narrow = F.concat(meets(there(0, "wide"), 1, False), meets(there(-1, "wide"), 3, False))
    dealt = rows.join(held, "token").select("rep", "component", "n", "at", F.explode(F.when(F.col("wide"), wide).otherwise(narrow)).alias("to"))
    return dealt.select("to.block", "rep", "component", "n", "at", F.col("to.side").cast("long").alias("side"))


def _block_pairs(percent: int):
    """Pairs (a, b) that may be links from rows (block, rep, component, n, at, side) sorted by block."""

    def run(batches):
        for group in _sorted_groups(batches):
            for part in np.split(group, np.flatnonzero(group[0, 1:] != group[0, :-1]) + 1, axis=1):
                x, y, own = (part[:, part[5] == side] for side in (0, 1, 2))
                yield _pair_rows(_possible(x, y, percent, False))
                yield _pair_rows(_possible(own, own, percent, True))

    return run


def _confirmed(percent: int):
    """Links among rows (a, b, first's hashes, second's hashes)."""

    def run(batches):
        for b in batches:
            src, dst = b.column(0).to_numpy(), b.column(1).to_numpy()
            hit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * common >= percent * (len(x) + len(y) - common))
            hit = np.array(hit, bool)
            yield pa.RecordBatch.from_arrays([pa.array(src[hit]), pa.array(dst[hit])], names=["src", "dst"])

    return run


def _may_link(percent: int):
    """Pairs (a, b) of rows (a, b, n and bitmap of each) that the bitmaps don't rule out: common <= (n + n - bits that differ) / 2."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (b.column(4), b.column(5)))
            common = (n - np.bitwise_count(x ^ y).sum(axis=1)) // 2
            yield b.select([0, 1]).filter(pa.array((100 + percent) * common >= percent * n))

    return run


def _other_links(sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """All links (src, dst) between classes of ``sets`` (rep, hashes, bitmap) of different components of ``linked``, by a prefix filter."""
    named = materialize(sets.select("rep", "hashes").join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "hashes"))
    every = max(1, named.count() // COUNTED_CLASSES)
    counted = named.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("hashes").mapInArrow(_shingles, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    frequent, rank = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by = np.argsort(frequent)
    prefixes = materialize(named.mapInArrow(_prefixes(percent, frequent[by], rank[by]), "token long, rep long, component long, n long, at long"))
    met = prefixes.groupBy("token").agg(F.count("*").alias("rows"), (F.min("component") < F.max("component")).alias("mixed"))
    long = materialize(met.where(F.col("rows") > POSTING).select("token", "mixed"))
    short = prefixes.join(long, "token", "left_anti").repartition("token").sortWithinPartitions("token").mapInArrow(_postings(percent), "a long, b long")
    blocks = _dealt_lists(prefixes.join(long.where("mixed"), "token", "left_semi"), percent).repartition("block").sortWithinPartitions("block")
    pairs = short.unionByName(blocks.mapInArrow(_block_pairs(percent), "a long, b long")).distinct()
    small = materialize(sets.select("rep", (F.octet_length("hashes") / 8).cast("long").alias("n"), "bitmap"))
    of = lambda t, key, *names: t.select(F.col("rep").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in names])
    pairs = pairs.join(of(small, "a", "n", "bitmap"), "a").join(of(small, "b", "n", "bitmap"), "b")
    pairs = materialize(pairs.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(_may_link(percent), "a long, b long"))
    both = pairs.join(of(named, "a", "hashes"), "a").join(of(named, "b", "hashes"), "b")
    return materialize(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirmed(percent), "src long, dst long"))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reached over links. A text of fewer than ``words`` words is one shingle; null, empty and blank
    texts have none and are linked with nothing. Rows with equal sets are one class, and rows that repeat a doc_id
    stay rows, linked each by its own text. A null doc_id is linked with nothing. Very long texts are read whole. Other columns are not read.
    """
    return _judged(docs, percent, words).drop("text_md5")


def _judged(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """:func:`near_duplicates`, with the MD5 of the row's text, by which rows that share a doc_id are told apart."""
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be from 1 to 100 and words positive")
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signed(words), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, text_md5 string"))
    classes = materialize(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("h1", "h2", F.col("m.doc_id").alias("owner"), "m.sig", F.monotonically_increasing_id().alias("rep")))

    # the forest, whose vertices are classes, numbered as they were written
    signed = classes.select("rep", "sig")
    place = [F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)]
    entries = signed.select("rep", F.posexplode(F.array(*[F.xxhash64(F.substring(p, 1, 4 * BASE_DEPTH)) for p in place])).alias("tree", "region"))
    shared = materialize(entries.groupBy("tree", "region").agg(F.count("*").alias("n")).where("n > 1").select("tree", "region", (F.col("n") > REGION).alias("large")))
    kept = materialize(entries.join(shared, ["tree", "region"]).groupBy("rep").agg(F.collect_list(F.struct("tree", "region", "large")).alias("places")))
    placed = kept.join(signed, "rep").select("rep", "sig", F.explode("places").alias("p")).select("rep", F.col("p.tree").alias("tree"), F.col("p.region").alias("region"), F.col("p.large").alias("large"), "sig")
    placed = materialize(placed.mapInPandas(_placed, "tree int, region long, large boolean, place binary, rep long, sketch binary"))
    order, compare = ["tree", "region", "place", "rep"], _forest(percent / 100 - ESTIMATE_SLACK)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // TASK_ENTRIES)
    near = [dealt.sortWithinPartitions(*order).mapInPandas(compare, "src long, dst long") for dealt in (placed.where("not large").repartition(parts, "tree", "region"), placed.where("large").repartitionByRange(*order))]
    clusters = components(near[0].unionByName(near[1]))

    # full sets of all that have to be compared; what is in a large region or cluster goes to the exact join later
    crowded = kept.where(F.exists("places", lambda p: p["large"])).select("rep", F.lit(True).alias("crowded"))
    sized = clusters.withColumnRenamed("component", "cluster")
    members = sized.join(sized.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").select(F.col("id").alias("rep"), "cluster", "n")
    asked = materialize(members.join(crowded, "rep", "full").join(classes.select("h1", "h2", "owner", "rep"), "rep").select("h1", "h2", "owner", "rep", "cluster", "n", (F.col("crowded").isNotNull() | (F.col("n") > WHOLE)).alias("exact")))
    text = docs.select(F.col("doc_id").cast("long").alias("owner"), "text").join(asked.select("h1", "h2", "owner", "rep").hint("merge"), "owner").select("h1", "h2", "rep", "text")  # a shuffle at every size
    full = materialize(text.mapInArrow(_class_sets(words), "rep long, hashes binary, bitmap binary").distinct())
    sets = full.join(asked.select("rep", "cluster", "n", "exact"), "rep")

    # confirming links on full sets
    found = "src long, dst long, degree long"
    small = sets.where(F.col("n") <= WHOLE).select(F.lit(0).alias("tree"), "cluster", "rep", "hashes")
    whole = small.repartition("cluster").sortWithinPartitions("cluster", "rep").mapInPandas(_sliding(percent), found)
    large = materialize(sets.where(F.col("n") > WHOLE).select("cluster", "rep", "hashes", "n"))
    orders = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), place[t].alias("place")) for t in range(BLOCK_ORDERS)])).alias("p")
    blocks = large.join(signed, "rep").select("cluster", "rep", "hashes", orders).select("p.tree", "cluster", "p.place", "rep", "hashes")
    blocks = blocks.repartitionByRange("tree", "cluster", "place", "rep").sortWithinPartitions("tree", "cluster", "place", "rep").drop("place").mapInPandas(_sliding(percent), found)
    links = materialize(whole.unionByName(blocks))

    degrees = links.where("degree > 0").groupBy(F.col("src").alias("rep")).agg(F.sum("degree").alias("degree"))
    ranked = large.select("cluster", "rep", "n").join(degrees, "rep").select("cluster", "n", F.struct((-F.col("degree")).alias("less"), "rep").alias("best"), F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"))
    first = F.slice(F.array_sort(F.collect_list("best")), 1, HUBS).alias("best")
    hubs = ranked.withColumn("k", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy("best"))).where(F.col("k") <= HUBS)  # at most SALTS x HUBS a cluster
    hubs = hubs.groupBy("cluster", "n").agg(first).select("cluster", "n", F.explode("best").alias("b")).select("cluster", "n", "b.rep")
    n_blocks = F.ceil(F.col("n") / HUB_BLOCK).cast("int")
    hubs = hubs.join(large.select("rep", "hashes"), "rep").select("cluster", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.lit(True).alias("hub"), "rep", "hashes")
    rest = large.select("cluster", F.pmod(F.xxhash64("rep"), n_blocks).cast("int").alias("block"), F.lit(False).alias("hub"), "rep", "hashes")
    by_hub = rest.unionByName(hubs).repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInPandas(_with_hubs(percent), found)

    linked = materialize(components(links.where("degree = 0").select("src", "dst").unionByName(by_hub.select("src", "dst"))))
    others = _other_links(full.join(asked.where("exact").select("rep"), "rep", "left_semi"), linked, percent)
    linked = components(linked.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(others))
    linked = materialize(linked)
    least = linked.join(classes.select(F.col("rep").alias("id"), "owner"), "id").groupBy("component").agg(F.min("owner").alias("least"))
    owned = linked.join(least, "component").select(F.col("id").alias("rep"), "least")
    named = materialize(classes.join(owned, "rep", "left").select("h1", "h2", F.coalesce("least", "owner").alias("component")))
    alone = F.col("n_shingles") == 0
    out = rows.where(~alone & F.col("doc_id").isNotNull()).join(named, ["h1", "h2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "text_md5")
    out = out.unionByName(rows.where(alone | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_md5"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An entry's place in its order (big-endian, so that binary order is the order) and its sketch of a byte a component."""
    for b in batches:
        sig = np.stack([np.frombuffer(x, np.uint32) for x in b["sig"]]) if len(b) else np.zeros((0, _M), np.uint32)
        place = [sig[k, DEPTH * t : DEPTH * (t + 1)].astype(">u4").tobytes() for k, t in enumerate(b["tree"])]
        yield pd.DataFrame({"tree": b["tree"], "region": b["region"], "large": b["large"], "place": place, "rep": b["rep"], "sketch": [x.tobytes() for x in (sig & 255).astype(np.uint8)]})


def drop_near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id; columns as they are.

    A row goes by its doc_id and text together, so a row that merely shares a doc_id with a dropped one stays. Rows that
    repeat the doc_id that stays, and rows with a null doc_id, stay all.
    """
    taken = {c.lower() for c in docs.columns}
    mark = next(f"md5_{k}" for k in range(len(taken) + 1) if f"md5_{k}" not in taken)
    dropped = _judged(docs, percent, words).where("not kept and doc_id is not null").select(F.col("doc_id").alias("dropped"), F.col("text_md5").alias("dropped_md5")).distinct()
    marked, dropped = docs.withColumn(mark, F.md5("text")), materialize(dropped)
    same = (marked["doc_id"] == dropped["dropped"]) & (marked[mark] == dropped["dropped_md5"])
    return marked.join(dropped, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
