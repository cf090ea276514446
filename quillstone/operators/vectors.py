"""Term vectors, exact nearest-vector search, re-ranking by a small network, and principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.arrow import arrow
from quillstone.plans.shared import written
from quillstone.sources.blocks import read_blocks, write_blocks

#: Query vectors that a task compares at once, and rows of the collection that it holds meanwhile.
BLOCK, HELD = 2048, 65536


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def usable(c: Column) -> Column:
    """Whether a vector has values, all of them finite and not all zero."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def terms(df: DataFrame, tokens: str, most: int = 256) -> DataFrame:
    """(term, df, idf): the most frequent terms of a corpus, ties by name, with smoothed inverse frequencies.

    Terms are words of two or more letters in lower case. All rows are counted,
    repeated ones as often as they come; null and empty rows count for the frequencies' base.
    """
    # two small aggregations over terms alone rather than one over each row's terms; what is no term is dropped once it is counted
    fit = F.col("term").rlike("^[a-z_][a-z0-9_]+$")
    spelled = df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    totals = spelled.groupBy(F.lower("w").alias("term")).agg(F.sum("n").alias("total")).where(fit)
    kept = totals.orderBy(F.desc("total"), "term").limit(most)
    holders = df.select(F.explode(F.array_distinct(F.transform(tokens, F.lower))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(fit)
    n = df.agg(F.count("*").alias("n"))
    found = kept.join(holders, "term").crossJoin(F.broadcast(n))  # one row
    return found.select("term", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def term_vectors(df: DataFrame, key: str, tokens: str, most: int = 256) -> DataFrame:
    """(key, term, weight): damped term frequency times inverse document frequency, at unit length for each row.

    The vocabulary is fitted on the whole corpus; rows without any of its terms give none.
    """
    vocabulary = terms(df, tokens, most)  # at most ``most`` rows
    words = df.select(F.col(key).alias("key"), F.explode(tokens).alias("w")).where(F.col("w").rlike("^[A-Za-z_][A-Za-z0-9_]+$")).select("key", F.lower("w").alias("term"))
    per = words.join(F.broadcast(vocabulary.select("term", "idf")), "term").groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    raw = per.withColumn("w", (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return raw.select(F.col("key").alias(key), "term", (F.col("w") / length).alias("weight"))


def term_embedding(vocabulary: list[tuple[str, float]]):
    """A function from an array of tokens to its vector over a vocabulary of (term, inverse frequency), of bounded size; an empty vector for none of its terms."""
    place = {t: i for i, (t, _) in enumerate(vocabulary)}
    idf = np.array([x for _, x in vocabulary])

    @arrow("array<float>")
    def embed(tokens: pd.Series) -> pd.Series:
        def one(words: np.ndarray | None) -> np.ndarray:
            known = [place[w] for w in (x.lower() for x in (words if words is not None else ()) if x) if w in place]
            if not known:
                return np.zeros(0, np.float32)
            tf = np.bincount(known, minlength=len(idf)).astype(float)
            w = np.where(tf > 0, np.log(np.maximum(tf, 1)) + 1, 0) * idf
            return (w / np.sqrt((w * w).sum())).astype(np.float32)

        return tokens.map(one)

    return embed


def search(collection: DataFrame, queries: DataFrame, k: int = 3, key: str = "id", vector: str = "vec", query: str = "qid", group: str | list[str] | None = None, least: float | None = None) -> DataFrame:
    """(qid, id, distance, rank): for each query its k nearest rows by cosine distance, exactly, ties by the smaller id.

    Queries are written to the shared folder; each task reads them in blocks of
    ``BLOCK`` for every ``HELD`` rows of its own, and keeps the k best of its rows for
    each query, so that rows times k at most are shuffled. With ``group`` only rows
    that are equal to the query in these columns count. Vectors of another length
    than the query's, and unusable ones, are never found; unusable queries find nothing.
    """
    group = [group] if isinstance(group, str) else group
    own = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group]) if group else F.lit("")
    asked = queries.where(usable(F.col(vector))).select(F.col(query).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("vec"), own.alias("grp"))
    rows = collection.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), own.alias("grp"))
    found = rows.mapInArrow(_best(write_blocks(asked, "queries"), k), "qid long, id long, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("distance") <= 1 - least)


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, unit vectors and groups of a batch (id, vec, grp), for each length that occurs."""
    ids, vec, groups = batch.column(0).to_numpy(), batch.column(1), np.array(batch.column(2).to_pylist(), object)
    sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()[:-1]
    for n in np.unique(sizes):
        at = np.nonzero(sizes == n)[0]
        x = flat[starts[at][:, None] + np.arange(n)]
        yield ids[at], x / np.linalg.norm(x, axis=1, keepdims=True), groups[at]


def _best(folder: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by block and length: queries, and the distances and ids of the best so far

        def meet(held: list[pa.RecordBatch]) -> None:
            mine: dict[int, list] = {}
            for batch in held:
                for part in _units(batch):
                    mine.setdefault(part[1].shape[1], []).append(part)
            merged = {n: tuple(np.concatenate(c) for c in zip(*parts)) for n, parts in mine.items()}
            for block, (_, queries) in enumerate(read_blocks(folder, BLOCK)):
                for qids, m, qg in _units(queries):
                    n = m.shape[1]
                    if n not in merged:
                        continue
                    ids, x, groups = merged[n]
                    for a in range(0, len(ids), 2048):
                        d = 1 - m @ x[a : a + 2048].T
                        d[qg[:, None] != groups[a : a + 2048][None, :]] = np.inf
                        own = np.broadcast_to(ids[a : a + 2048], d.shape)
                        if (block, n) in kept:
                            d, own = np.concatenate([kept[block, n][1], d], axis=1), np.concatenate([kept[block, n][2], own], axis=1)
                        order = np.lexsort((own, d), axis=1)[:, :k]
                        kept[block, n] = qids, np.take_along_axis(d, order, 1), np.take_along_axis(own, order, 1)

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= HELD:
                meet(held)
                held, count = [], 0
        if held:
            meet(held)
        for qids, d, own in kept.values():
            fine = np.isfinite(d.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, d.shape[1])[fine]), pa.array(own.ravel()[fine]), pa.array(d.ravel()[fine])], ["qid", "id", "distance"])

    return run


# --- re-ranking by a small network ----------------------------------------------------------------------------
HIDDEN = (256, 128, 64)
#: Tasks that add up the gradients of all others.
SUMS = 16


def new_network(inputs: int, seed: int = 7) -> list[np.ndarray]:
    """Weights and offsets of a network of ``inputs``, 256, 128, 64 and one unit."""
    rng, sizes = np.random.default_rng(seed), (inputs, *HIDDEN, 1)
    return [x for a, b in zip(sizes, sizes[1:]) for x in (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a))]


def network_scores(net: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The values of all layers, the input first and the score last."""
    layers = [x]
    for k in range(0, len(net), 2):
        z = layers[-1] @ net[k] + net[k + 1]
        layers.append(np.maximum(z, 0) if k + 2 < len(net) else z)
    return layers


def _matrix(batch: pa.RecordBatch, columns: tuple[int, int], inputs: int) -> np.ndarray:
    parts = [np.array(batch.column(c).to_pylist(), dtype=np.float64).reshape(batch.num_rows, inputs // 2) for c in columns]
    return np.concatenate(parts, axis=1)


def scores(pairs: DataFrame, net: list[np.ndarray]) -> DataFrame:
    """(qid, id, distance, score): the network's score of each pair of query and row vectors (columns qvec and vec)."""
    inputs = net[0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = network_scores(net, _matrix(b, (3, 4), inputs))[-1][:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s)], ["qid", "id", "distance", "score"])

    half = inputs // 2
    fit = pairs.where((F.size("qvec") == half) & (F.size("vec") == half))
    return fit.select("qid", "id", "distance", "qvec", "vec").mapInArrow(run, "qid long, id long, distance double, score double")


def rerank(scored: DataFrame, most: int = 3) -> DataFrame:
    """The best rows of each query by score; equal scores keep the order of distance and id."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "distance", "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def train(examples: DataFrame, inputs: int, steps: int = 8, rate: float = 0.001, seed: int = 7) -> tuple[list[np.ndarray], list[float]]:
    """A network fitted to rewards (columns qvec, vec, reward) by Adam on the mean squared error, and the error before each step.

    Each step sends the weights to the tasks and adds up the gradients of all
    examples, first in each task and then in ``SUMS`` tasks; what comes back to the
    driver is that many gradients at most, of the network's size, however many
    examples and tasks there are. The examples are computed once and written to the shared folder. Without
    examples the network stays new.
    """
    net = new_network(inputs, seed)
    m, v, errors = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], []
    half = inputs // 2
    known = examples.where((F.size("qvec") == half) & (F.size("vec") == half) & F.col("reward").isNotNull()).select("qvec", "vec", F.col("reward").cast("double").alias("reward"))
    rows = written(known, "examples")
    for step in range(1, steps + 1):
        parts = rows.mapInArrow(_gradients(net, inputs), "n long, error double, gradient binary").where("n > 0").repartition(SUMS).mapInArrow(_summed, "n long, error double, gradient binary").collect()
        parts.sort(key=lambda p: bytes(p.gradient))  # one order of the sum, whatever the tasks'
        n = sum(p.n for p in parts)
        if not n:
            break
        errors.append(sum(p.error for p in parts) / n)
        total = np.sum([np.frombuffer(p.gradient) for p in parts if p.n], axis=0) / n
        at = 0
        for k, w in enumerate(net):
            g = total[at : at + w.size].reshape(w.shape)
            at += w.size
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net[k] = w - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net, errors


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, error, total = 0, 0.0, None
    for b in batches:
        for k, e, g in zip(*(c.to_pylist() for c in b.columns)):
            n, error = n + k, error + e
            total = np.frombuffer(g).copy() if total is None else total + np.frombuffer(g)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([error]), pa.array([total.tobytes()], pa.binary())], ["n", "error", "gradient"])


def save_network(spark: SparkSession, net: list[np.ndarray], path: str) -> None:
    """Writes a network as a table of its layers, in place of what is there."""
    rows = [(k, list(w.shape), [float(x) for x in w.ravel()]) for k, w in enumerate(net)]
    spark.createDataFrame(rows, "layer int, shape array<int>, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> list[np.ndarray]:
    """A network as it was saved; of a fixed, small number of layers."""
    return [np.array(r.weights).reshape(r.shape) for r in spark.read.parquet(path).orderBy("layer").collect()]


def _gradients(net: list[np.ndarray], inputs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, error = [np.zeros_like(w) for w in net], 0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            layers = network_scores(net, _matrix(b, (0, 1), inputs))
            delta = 2 * (layers[-1] - b.column(2).to_numpy()[:, None])
            n, error = n + b.num_rows, error + float((delta**2).sum() / 4)
            for k in range(len(net) - 2, -1, -2):
                total[k] += layers[k // 2].T @ delta
                total[k + 1] += delta.sum(axis=0)
                if k:
                    delta = (delta @ net[k].T) * (layers[k // 2] > 0)
        flat = np.concatenate([w.ravel() for w in total])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([error]), pa.array([flat.tobytes()], pa.binary())], ["n", "error", "gradient"])

    return run


def principal_axes(df: DataFrame, key: str, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, x, y) on the two main axes of all usable vectors of the first length, and the share of variance of each.

    The sign of an axis is such that the loading of the greatest size is positive.
    """
    rows = df.where(usable(F.col(vector))).select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    model = PCA(k=k, inputCol="features", outputCol="axes").fit(rows.withColumn("features", array_to_vector("v")))
    loads = model.pc.toArray()
    signs = [float(np.sign(loads[np.abs(loads[:, j]).argmax(), j])) for j in range(k)]
    placed = model.transform(rows.withColumn("features", array_to_vector("v"))).withColumn("a", vector_to_array("axes"))
    return placed.select(key, *[(F.col("a")[j] * signs[j]).alias(n) for j, n in zip(range(k), "xyzw")]), [float(x) for x in model.explainedVariance]
