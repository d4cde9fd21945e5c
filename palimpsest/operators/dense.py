"""Similarity search and quantisation of float vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sign_bits(a: Column, threshold: float = 0.0) -> Column:
    """Packed BIGINT limbs with a bit for every value above the threshold; the length must be a multiple of 64."""
    part = lambda j: F.slice(a, (j * 64 + 1).cast("int"), 64)
    limb = lambda j: F.aggregate(part(j), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > threshold, 1).otherwise(0).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), (F.size(a) / 64).cast("int") - 1), limb)


def quantise(a: Column, low: Column, high: Column) -> Column:
    """Bytes 0 to 255 between the ends; a vector without spread gives zeros."""
    span = high - low
    return F.transform(a, lambda x: F.when(span > 0, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") - low) / span)) * 255)).otherwise(0).cast("int"))


def dequantise(q: Column, low: Column, high: Column) -> Column:
    return F.transform(q, lambda x: low + x / 255.0 * (high - low))


def nearest_in_blocks(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, query_rows: int = 2_000, base_rows: int = 8_000) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows of greatest cosine similarity to each query, exactly.

    Queries and base are dealt to blocks of about so many rows, and every pair of blocks is one matrix product in a task of
    its own, so a task's memory doesn't grow with the tables. Zero and null vectors match
    nothing; a row isn't its own neighbour; equal similarities are ordered by key.
    """
    kind = base.schema[key].dataType.simpleString()
    usable = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, vector)
    q, b = usable(queries), usable(base)
    nq, nb = (max(1, -(-df.count() // rows)) for df, rows in ((q, query_rows), (b, base_rows)))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", deal(nq)).withColumn("bb", everywhere(nb))
    b = b.withColumn("bb", deal(nb)).withColumn("qb", everywhere(nq))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query": x[key][:0], key: y[key][:0], "similarity": np.zeros(0)})
        if not len(x) or not len(y):
            return out
        y = y.sort_values(key, kind="stable")  # ties go to the smaller key
        a, c = (np.array(p[vector].tolist(), np.float64) for p in (x, y))
        a, c = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (a, c))
        qk, bk = x[key].to_numpy(), y[key].to_numpy()
        for i in range(0, len(a), 512):
            s = a[i : i + 512] @ c.T
            s[qk[i : i + 512, None] == bk[None, :]] = -np.inf
            s[~a[i : i + 512].any(1)] = -np.inf
            s[:, ~c.any(1)] = -np.inf
            n = min(k, s.shape[1])
            edge = -np.partition(-s, n - 1, 1)[:, n - 1]
            row, col = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row)
            best = np.arange(len(row)) - first < k
            row, col = row[best], col[best]
            out = pd.concat([out, pd.DataFrame({"query": qk[i + row], key: bk[col], "similarity": s[row, col]})])
        return out

    pairs = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(product, f"query {kind}, {key} {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


# --- holographic algebra of float vectors ---------------------------------------------------------------------------


def _convolver(inverse: bool):
    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        rows = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) == len(y) > 0]
        for width in {len(a.iloc[i]) for i in rows}:
            some = [i for i in rows if len(a.iloc[i]) == width]
            x, y = (np.fft.rfft(np.stack([np.asarray(v.iloc[i], np.float64) for i in some])) for v in (a, b))
            made = np.fft.irfft(x * (np.conj(y) if inverse else y), width)
            if inverse:
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
            for i, v in zip(some, made):
                out[i] = v.tolist()
        return pd.Series(out)

    return run


def bound(a: Column, b: Column) -> Column:
    """Circular convolution of two vectors; null where either is null or empty or their lengths differ."""
    return _convolver(False)(a, b)


def unbound(a: Column, b: Column) -> Column:
    """What ``a`` holds beside ``b``: convolution with the involution of ``b``, at length 1."""
    return _convolver(True)(a, b)


def superposed(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, vector): element-wise sums of each group, of vectors of one length; pre-aggregated by place."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))  # as many as a vector is long
    return sums.groupBy(*keys).agg(F.transform(ordered, lambda p: p["_x"]).alias(vector))


def rolled(a: Column, shift: int) -> Column:
    """The vector turned by ``shift`` places to the right."""
    n = F.size(a)
    k = F.pmod(F.lit(shift), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))).otherwise(a)


def quantised_distance(a: Column, b: Column) -> Column:
    """Squared distance of two vectors of bytes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


# --- product quantisation -------------------------------------------------------------------------------------------

#: Vectors the codebooks are fitted on.
PQ_SAMPLE = 20_000


def train_codebooks(vectors: DataFrame, vector: str, parts: int, centroids: int = 16, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """(parts, centroids, width) codebooks by k-means per part, on a sample of at most ``PQ_SAMPLE`` vectors.

    Only the fit is bounded; every vector is encoded. Empty clusters keep their centre.
    """
    usable = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    rows = usable.count()
    picked = usable if rows <= PQ_SAMPLE else usable.sample(PQ_SAMPLE / rows, seed)
    x = np.array([r.v for r in picked.limit(PQ_SAMPLE).collect()], np.float64)
    rng, width = np.random.default_rng(seed), x.shape[1] // parts
    books = np.empty((parts, centroids, width))
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        c = part[rng.choice(len(part), centroids, replace=len(part) < centroids)]
        for _ in range(rounds):
            near = _nearest_centre(part, c)
            for k in np.unique(near):
                c[k] = part[near == k].mean(0)
        books[p] = c
    return books


def _nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def pq_encode(vectors: DataFrame, key: str, vector: str, books: np.ndarray) -> DataFrame:
    """(key, codes): the nearest centre of each part; null vectors and those of another length give null."""
    kind, parts, width = vectors.schema[key].dataType.simpleString(), books.shape[0], books.shape[2]

    def run(batches):
        for b in batches:
            fits = b[vector].map(lambda v: v is not None and len(v) == parts * width).to_numpy(bool)
            codes = [None] * len(b)
            if fits.any():
                x = np.stack(b[vector][fits].to_numpy()).astype(np.float64)
                made = np.stack([_nearest_centre(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], 1)
                for i, c in zip(np.flatnonzero(fits), made):
                    codes[i] = c.tolist()
            yield pd.DataFrame({key: b[key], "codes": codes})

    return vectors.select(key, vector).mapInPandas(run, f"{key} {kind}, codes array<int>")


def pq_distances(encoded: DataFrame, query: list[float], books: np.ndarray) -> DataFrame:
    """Encoded rows with their squared distance to a query, summed from a table of the query's distances to all centres."""
    parts, width = books.shape[0], books.shape[2]
    q = np.array(query, np.float64).reshape(parts, width)
    table = ((books - q[:, None, :]) ** 2).sum(2)
    flat = F.array(*[F.lit(float(x)) for x in table.ravel()])
    at = lambda p, c: F.element_at(flat, p * table.shape[1] + c + 1)
    terms = F.transform("codes", lambda c, p: at(p, c))
    return encoded.withColumn("distance", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def k_medoids(vectors: DataFrame, key: str, vector: str, k: int, rounds: int = 10, block_rows: int = 2_000, seed: int = 42) -> DataFrame:
    """(key, medoid, distance): every vector at the nearest of ``k`` medoids (Euclidean, ties to the smaller key).

    Each round takes the row of least total distance to the members of its cluster, over all rows: every pair of blocks of
    about ``block_rows`` rows is one task, so the work grows with the square of the rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    medoids = usable.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k).collect()
    if not medoids:
        return usable.select(key, F.col(key).alias("medoid"), F.lit(0.0).alias("distance"))
    medoids.sort(key=lambda r: r[0])
    blocks = max(1, -(-usable.count() // block_rows))
    deal = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], 1)
        j = away.argmin(1)
        return j, away[np.arange(len(x)), j]

    def improved(now: list) -> list:
        centres = np.array([r[1] for r in now], np.float64)

        def costs(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"j": np.zeros(0, np.int32), key: x[key][:0], "cost": np.zeros(0)})]
            if len(x) and len(y):
                a, b = (np.array(p[vector].tolist(), np.float64) for p in (x, y))
                ja, jb = nearest(a, centres)[0], nearest(b, centres)[0]
                for j in np.unique(ja):
                    p, q = a[ja == j], b[jb == j]
                    d = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1) - 2 * p @ q.T, 0))
                    out.append(pd.DataFrame({"j": np.int32(j), key: x[key][ja == j], "cost": d.sum(1)}))
            return pd.concat(out[1:] or out)

        q = usable.withColumn("qb", deal).withColumn("bb", everywhere)
        b = usable.withColumn("bb", deal).withColumn("qb", everywhere)
        parts = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(costs, f"j int, {key} {kind}, cost double")
        total = parts.groupBy("j", key).agg(F.round(F.sum("cost"), 6).alias("cost"))
        best = total.groupBy("j").agg(F.min(F.struct("cost", key)).getField(key).alias(key))
        found = {r["j"]: r[key] for r in best.collect()}  # at most k
        rows = {r[0]: r for r in usable.where(F.col(key).isin(*found.values())).collect()}
        return sorted((rows[found[j]] if j in found else r for j, r in enumerate(now)), key=lambda r: r[0])

    for _ in range(rounds):
        better = improved(medoids)
        if [r[0] for r in better] == [r[0] for r in medoids]:
            break
        medoids = better
    names, centres = [r[0] for r in medoids], np.array([r[1] for r in medoids], np.float64)

    def assign(batches):
        for b in batches:
            if len(b):
                j, away = nearest(np.stack(b[vector].to_numpy()).astype(np.float64), centres)
                yield pd.DataFrame({key: b[key], "medoid": [names[i] for i in j], "distance": away})

    return usable.mapInPandas(assign, f"{key} {kind}, medoid {kind}, distance double")
