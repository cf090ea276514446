"""Most similar vectors for every vector (problem 4), by shifted space-filling curves.

Every usable vector is scaled to unit length and projected at random onto a few
dimensions, once for each curve and with another shift each time. The place of
the projection on a Hilbert curve is its key. Spark range-partitions and sorts
the rows of each curve by key; vectors that are alike lie close together on at
least one curve. Each row meets the rows in a window behind it; a sketch of
random hyperplane signs, which travels with the row, drops the pairs that cannot
reach the wanted similarity. What the windows of all curves find is merged, and
the exact cosine ranks it.

The shuffle carries a key, an id and a 32-byte sketch a row and curve, never the
vectors; these are joined only to the pairs that are left.

That finds near vectors. Far "tenth nearest" ones lie close on no curve, so
``all_nearest``, which gives every vector its neighbours whatever their
similarity, takes the order of one curve only to cut the vectors into blocks and
compares every block with every other. Nothing is missed; the work grows with
the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.shared import written
from quillstone.sources.blocks import read_blocks, write_blocks

CURVES = 10
PROJECTED = 10
KEY_BITS = 60
WINDOW = 64
SKETCH_WORDS = 4
#: Standard deviations that a sketch distance may exceed its mean at the wanted similarity.
SKETCH_SLACK = 4.5
#: Vectors of a block that is compared as a whole.
BLOCK = 2048
#: Similarity that single precision may be off.
ROUNDING = 4e-6


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points whose coordinates have ``bits`` bits each (Skilling's transform)."""
    axes = [coords[:, i].astype(np.uint32) for i in range(coords.shape[1])]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(n):
            up = (axes[i] >> np.uint32(level)) & np.uint32(1)
            swap = np.where(up == 1, np.uint32(0), (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(up == 1, low, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[n - 1] >> np.uint32(level)) & np.uint32(1) == 1, turn ^ np.uint32((1 << level) - 1), turn)
    key = np.zeros(len(coords), np.uint64)
    for b in range(bits - 1, -1, -1):
        for x in axes:
            key = (key << np.uint64(1)) | ((x ^ turn) >> np.uint32(b) & np.uint32(1)).astype(np.uint64)
    return key.astype(np.int64)


@lru_cache(64)
def bases(length: int, curves: int, projected: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Projections and shifts of each curve, and the hyperplanes of the sketch, the same in every task."""
    rng = np.random.default_rng(7919 + length)
    found = []
    for _ in range(curves):
        q = np.linalg.qr(rng.normal(size=(length, length)))[0][:, :projected]
        found.append((q, rng.uniform(0, 0.25, size=q.shape[1])))
    return found, rng.normal(size=(length, 64 * SKETCH_WORDS))


def usable(values: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of the usable rows, for each length that occurs."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = values.offsets.to_numpy()[:-1]
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.nonzero(lengths == n)[0]
        x = flat[starts[rows][:, None] + np.arange(n)]
        with np.errstate(all="ignore"):
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield rows[good], x[good]


def curve_rows(vectors: DataFrame, curves: int, projected: int) -> DataFrame:
    """A row (curve, grp, place, id, s0..) for each vector and curve. vectors: id, grp, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, x in usable(batch.column(2)):
                length = x.shape[1]
                lines, planes = bases(length, curves, projected)
                signs = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                kept = [pa.array(np.ascontiguousarray(signs[:, w])) for w in range(SKETCH_WORDS)]
                for c, (base, shift) in enumerate(lines):
                    bits = KEY_BITS // base.shape[1] if base.shape[1] > 3 else 16
                    # The logistic curve makes the coordinates about evenly filled; shifts move all cell borders.
                    even = 1 / (1 + np.exp(-1.702 * math.sqrt(length) * (x @ base)))
                    cells = np.minimum((even + shift) / 1.25 * (1 << bits), (1 << bits) - 1)
                    place = hilbert_keys(cells.astype(np.uint32), bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), c, np.int32)), pa.array(grp[rows]), pa.array(place), pa.array(ids[rows]), *kept],
                        ["curve", "grp", "place", "id", *(f"s{w}" for w in range(SKETCH_WORDS))],
                    )

    sketch = ", ".join(f"s{w} long" for w in range(SKETCH_WORDS))
    return vectors.mapInArrow(run, f"curve int, grp long, place long, id long, {sketch}")


def window_pairs(ordered: DataFrame, window: int, most: int, heads: int) -> DataFrame:
    """Directed pairs (src, dst) of rows at most ``window`` apart whose sketches differ in at most ``most`` bits.

    Equal vectors have equal places and sketches. Of such a run only the first
    ``heads`` rows take part in windows; each further row gets these as its
    candidates, so that a run of any length makes pairs in proportion to its rows.
    """

    def pairs(t: dict[str, np.ndarray], fresh: int) -> Iterator[pa.RecordBatch]:
        n = len(t["id"])
        sketch = np.stack([t[f"s{w}"] for w in range(SKETCH_WORDS)], axis=1).view(np.uint64)
        same = np.zeros(n, bool)
        for c in ("curve", "grp", "place"):
            same[1:] = (t[c][1:] == t[c][:-1]) & (same[1:] if c != "curve" else True)
        same[1:] &= (sketch[1:] == sketch[:-1]).all(axis=1)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        later = np.arange(n) - first >= heads
        src, dst = [], []
        extra = np.nonzero(later & (np.arange(n) >= fresh))[0]
        for h in range(heads if len(extra) else 0):
            src.append(t["id"][extra])
            dst.append(t["id"][first[extra] + h])
        keep = np.nonzero(~later)[0]
        grp, curve, ids, sk, new = t["grp"][keep], t["curve"][keep], t["id"][keep], sketch[keep], keep >= fresh
        for off in range(1, min(window, len(keep) - 1) + 1):
            near = (grp[off:] == grp[:-off]) & (curve[off:] == curve[:-off]) & new[off:]
            near &= np.bitwise_count(sk[off:] ^ sk[:-off]).sum(axis=1, dtype=np.int32) <= most
            if near.any():
                a, b = ids[off:][near], ids[:-off][near]
                src += [a, b]
                dst += [b, a]
        if src:
            s, d = np.concatenate(src), np.concatenate(dst)
            s, d = s[s != d], d[s != d]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "grp", "place", "id", *(f"s{w}" for w in range(SKETCH_WORDS))]
        carry: dict[str, np.ndarray] | None = None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            fresh = 0
            if carry is not None:
                fresh = len(carry["id"])
                t = {c: np.concatenate([carry[c], t[c]]) for c in names}
            yield from pairs(t, fresh)
            carry = {c: t[c][-(window + heads) :] for c in names}

    return ordered.mapInArrow(run, "src long, dst long")


def cosine(a: str, b: str) -> F.Column:
    """Exact cosine of two arrays, in double precision."""

    def total(x: F.Column) -> F.Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = [F.sqrt(total(F.transform(c, lambda x: x.cast("double") * x.cast("double")))) for c in (a, b)]
    return dot / (norms[0] * norms[1])


def nearest(
    df: DataFrame,
    k: int = 10,
    min_similarity: float = 0.95,
    key: str = "chunk_key",
    vector: str = "embedding",
    group: str = "embedding_model",
    curves: int = CURVES,
    projected: int = PROJECTED,
    window: int = WINDOW,
) -> DataFrame:
    """(src, dst, similarity, rank): for each vector its ``k`` most similar others of at least ``min_similarity``.

    Only vectors of one ``group`` value and one length are compared. Null, empty,
    all-zero and not finite vectors, vectors with a null element and rows with a
    null key or group have no neighbours and are none. Equal similarities rank by
    the smaller key. Repeated rows of a key count once; of different vectors
    under one key, any one counts. Extra columns are ignored. An empty table
    gives an empty table. The search is approximate: what it finds is exact, but
    a neighbour that is near on no curve is missed; so is one across the border
    of two sort partitions of a curve, unless another curve has it.
    """
    vectors = df.select(F.col(key).cast("long").alias("id"), F.col(group).alias("model"), F.col(vector).alias("vec"))
    vectors = vectors.where("id is not null and model is not null and size(vec) > 0")
    own = F.xxhash64("model", F.size("vec")).alias("grp")  # vectors of other lengths take no place in a window
    # written once: the partitioning by range reads the keys twice
    rows = written(curve_rows(vectors.select("id", own, F.col("vec").cast("array<double>").alias("vec")), curves, projected), "curves")
    order = ["curve", "grp", "place", "id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    bits = 64 * SKETCH_WORDS
    p = math.acos(min_similarity) / math.pi
    most = math.floor(bits * p + SKETCH_SLACK * math.sqrt(bits * p * (1 - p)) + 1)
    pairs = window_pairs(ordered, window, most, k + 1).distinct()
    once = vectors.dropDuplicates(["id"])
    left = once.select(F.col("id").alias("src"), F.col("model").alias("m1"), F.col("vec").alias("v1"))
    right = once.select(F.col("id").alias("dst"), F.col("model").alias("m2"), F.col("vec").alias("v2"))
    scored = pairs.join(left, "src").join(right, "dst").where("m1 = m2 and size(v1) = size(v2)")
    scored = scored.select("src", "dst", cosine("v1", "v2").alias("similarity")).where(F.col("similarity") >= min_similarity - 1e-9)
    best = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def blocks(ordered: DataFrame) -> DataFrame:
    """(block, grp, length, ids, units): runs of at most ``BLOCK`` rows of a group and length, with unit vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(kind: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(kind)))
            for a in range(0, len(ids), BLOCK):
                part = ids[a : a + BLOCK]
                # a key stands in one block only, so that its first one names the block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[0])]), pa.array([kind[0]]), pa.array([kind[1]], pa.int32()), pa.array([part.tobytes()]), pa.array([x[a : a + BLOCK].tobytes()])],
                    ["block", "grp", "length", "ids", "units"],
                )

        for batch in batches:
            ids, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, x in usable(batch.column(2)):
                for g in np.unique(grp[rows]):
                    kind, on = (int(g), x.shape[1]), grp[rows] == g
                    held.setdefault(kind, []).append((ids[rows[on]], x[on]))
                    if sum(len(i) for i, _ in held[kind]) >= BLOCK:
                        yield from packed(kind)
        for kind in list(held):
            yield from packed(kind)

    return ordered.mapInArrow(run, "block long, grp long, length int, ids binary, units binary")


class Best:
    """The ``k`` most similar rows of all blocks for each row of one block, exactly."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.single = ids, x, k, x.astype(np.float32)
        self.bound = np.full(len(ids), -np.inf, np.float32)
        self.at, self.dst, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, theirs: np.ndarray, y: np.ndarray, single: np.ndarray) -> None:
        k, x = self.k, self.x
        s = self.single @ single.T
        if theirs[0] == self.ids[0]:
            np.fill_diagonal(s, -np.inf)
        if len(theirs) >= k and (fresh := np.isneginf(self.bound)).any():
            self.bound[fresh] = np.partition(s[fresh], len(theirs) - k, axis=1)[:, len(theirs) - k] - ROUNDING
        close = s >= self.bound[:, None]
        if theirs[0] == self.ids[0]:
            np.fill_diagonal(close, False)
        many = np.count_nonzero(close, axis=1)
        i, j = np.nonzero(close & (many <= 4 * k)[:, None])
        found = [(i, theirs[j], (x[i] * y[j]).sum(axis=1))]
        for r in np.nonzero(many > 4 * k)[0]:  # a run of equal vectors: only the k best are kept, row by row
            j = np.nonzero(close[r])[0]
            exact = (x[r] * y[j]).sum(axis=1)
            top = np.lexsort((theirs[j], -exact))[:k]
            found.append((np.full(len(top), r), theirs[j[top]], exact[top]))
        at, dst, sim = (np.concatenate(c) for c in zip((self.at, self.dst, self.sim), *found))
        order = np.lexsort((dst, -sim, at))
        at, dst, sim = at[order], dst[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        self.at, self.dst, self.sim = (c[place < k] for c in (at, dst, sim))
        last = place == k - 1
        self.bound[at[last]] = sim[last] - ROUNDING

    def rows(self) -> pa.RecordBatch:
        rank = np.arange(len(self.at)) - np.searchsorted(self.at, self.at, "left") + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.at]), pa.array(self.dst), pa.array(self.sim), pa.array(rank, pa.int32())], ["src", "dst", "similarity", "rank"])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """Group and length, ids and unit vectors of each block."""
    for grp, length, ids, units in zip(*(batch.column(c) for c in ("grp", "length", "ids", "units"))):
        yield (grp.as_py(), length.as_py()), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(units.as_buffer(), np.float64).reshape(-1, length.as_py())


def all_nearest(df: DataFrame, k: int = 10, key: str = "chunk_key", vector: str = "embedding", group: str = "embedding_model") -> DataFrame:
    """(src, dst, similarity, rank): for each usable vector its ``k`` most similar others, however far they are.

    What is usable and compared, and how equal similarities rank, is as for
    ``nearest``. The search is exact: a vector has fewer than ``k`` rows only if
    its group and length hold no more others. Each task reads all blocks from the
    shared folder, one after the other.
    """
    vectors = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(group)).alias("grp"), F.col(vector).cast("array<double>").alias("vec"), F.col(group).alias("model"))
    once = vectors.where("id is not null and model is not null and size(vec) > 0").drop("model").dropDuplicates(["id"])
    # the order of a curve puts like vectors into a block, so that the bounds are high from its first comparison on
    place = curve_rows(once, 1, PROJECTED).select("id", "grp", "place")
    ordered = once.join(place, ["id", "grp"]).repartitionByRange("grp", "place", "id").sortWithinPartitions("grp", "place", "id")
    folder = write_blocks(blocks(ordered.select("id", "grp", "vec")), "blocks")
    cut = df.sparkSession.read.schema("block long, grp long, length int, ids binary, units binary").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [(kind, Best(ids, x, k)) for kind, ids, x in unpacked(batch)]
            kinds = {kind for kind, _ in mine}
            for _, part in read_blocks(folder, 4):
                for kind, theirs, y in unpacked(part):
                    if kind in kinds:
                        single = y.astype(np.float32)
                        for own, best in mine:
                            if own == kind:
                                best.meet(theirs, y, single)
            for _, best in mine:
                yield best.rows()

    return cut.repartition("block").mapInArrow(run, "src long, dst long, similarity double, rank int")


def nearest_pairs(df: DataFrame, **options) -> DataFrame:
    """(chunk_key_a, chunk_key_b): the distinct pairs of ``nearest``, the smaller key first."""
    found = nearest(df, **options)
    return found.select(F.least("src", "dst").alias("chunk_key_a"), F.greatest("src", "dst").alias("chunk_key_b")).distinct()
