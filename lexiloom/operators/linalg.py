"""Matrices as rows i, j, v: products, Gramians, normalisation, singular values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.store import kept

BLOCK_ROWS, BLOCK_COLUMNS = 1_000, 4_096  # of a block of A A', about, and of the columns that are multiplied at once
MOST_COLUMNS = 4_096  # of a Gramian that is decomposed in one place


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    return df.select(F.col(row).cast("int").alias("i"), F.posexplode(values).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B: an equi join on the inner index, then sums; absent cells are 0."""
    left, right = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gram_columns(a: DataFrame) -> DataFrame:
    """A'A. Rows are gathered first, so that the join on i never leaves the row: each makes its own products, which are
    summed before they are exchanged. Fits as long as a single row does."""
    rows = a.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
    pairs = rows.select(F.explode("r").alias("p"), "r").select(F.col("p.j").alias("i"), F.col("p.v").alias("x"), F.explode("r").alias("q"))
    return pairs.select("i", F.col("q.j").alias("j"), (F.col("x") * F.col("q.v")).alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_rows(a: DataFrame) -> DataFrame:
    """A A': as many cells as pairs of rows. Rows are gathered in blocks of some 1,000 by a hash, and each pair of blocks is
    one product of arrays, which gives its mirrored cells, too: memory is that of two blocks and their product. As by
    multiply, cells without a common column are absent, and those of nulls alone are null."""
    a = kept(a, "rows")
    n = max(1, -(-a.select("i").distinct().count() // BLOCK_ROWS))
    kind = a.schema["i"].dataType.simpleString()

    def packed(table: pa.Table) -> pa.Table:
        v = table["v"]
        cells = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("i", "j")] + [v.fill_null(0.0).to_numpy().tobytes(), v.is_valid().to_numpy().astype(np.int8).tobytes()]
        return pa.table({"block": table["block"].slice(0, 1)} | {c: pa.array([x], pa.binary()) for c, x in zip("ijvk", cells, strict=True)})

    cells = a.select(F.pmod(F.hash("i"), F.lit(n)).alias("block"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    blocks = kept(cells.where("i is not null and j is not null").groupBy("block").applyInArrow(packed, "block int, i binary, j binary, v binary, k binary"), "blocks")

    def product(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda r: r["side"])
        i, v = _product(*(_opened(r) for r in (sides[0], sides[-1])))
        both = sides[0]["block"] != sides[-1]["block"]
        i, j = (np.concatenate([x, y]) if both else x for x, y in (i, i[::-1]))
        v = pa.concat_arrays([v, v]) if both else v
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "v": v})

    def side(number: int) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.col("block")) if number else F.sequence(F.col("block"), F.lit(n - 1)))
        both = blocks.select("*", at.alias("other")).withColumn("side", F.lit(number))
        pair = (F.col("other"), F.col("block")) if number else (F.col("block"), F.col("other"))
        return both.select(pair[0].alias("left"), pair[1].alias("right"), "block", "side", "i", "j", "v", "k")

    # A number of tasks that isn't cut down: little is read for what is made.
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (n + 1) // 8)
    pairs = side(0).union(side(1).where("left <> right")).repartition(tasks, "left", "right")
    return pairs.groupBy("left", "right").applyInArrow(product, "i long, j long, v double").select(*(F.col(c).cast(kind).alias(c) for c in "ij"), "v")


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], kind) for c, kind in zip("ijvk", (np.int64, np.int64, np.float64, np.int8), strict=True))


def _product(left: tuple, right: tuple) -> tuple[list[np.ndarray], pa.Array]:
    """(i of the left, i of the right) and v of the cells of X Y', where a row of each has a column in common."""
    (own, x), (other, y) = (np.unique(s[0], return_inverse=True) for s in (left, right))
    columns, at = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    shape = len(own), len(other)
    v, common, known = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for a in range(0, len(columns), BLOCK_COLUMNS):
        m, dense = min(BLOCK_COLUMNS, len(columns) - a), []
        for rows, n, c, (_, _, value, valid) in ((x, len(own), at[: len(x)], left), (y, len(other), at[len(x) :], right)):
            here = np.flatnonzero((c >= a) & (c < a + m))
            flat, three = rows[here] * m + c[here] - a, []
            for weight in (value[here], None, valid[here]):
                three.append(np.bincount(flat, weights=weight, minlength=n * m).reshape(n, m).astype(np.float64))
            dense.append(three)
        (vx, px, kx), (vy, py, ky) = dense
        common += px @ py.T
        known += kx @ ky.T
        if np.isfinite(vx).all() and np.isfinite(vy).all():
            v += vx @ vy.T
        else:  # an absent cell must not meet an infinite one
            for r in range(len(own)):
                with np.errstate(invalid="ignore"):
                    v[r] += np.where((kx[r] > 0) & (ky > 0), vx[r] * vy, 0.0).sum(axis=1)
    r, c = np.nonzero(common > 0)
    return [own[r], other[c]], pa.array(v[r, c], mask=known[r, c] == 0)


def normalise_rows(a: DataFrame) -> DataFrame:
    """v over its row's sum of squares (the sum itself, not its root)."""
    return a.withColumn("v", F.col("v") / F.sum(F.col("v") * F.col("v")).over(W.partitionBy("i")))


def rows_to_one(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.col("v") / F.sum("v").over(W.partitionBy("i")))


def swap_columns(a: DataFrame, p: int, q: int) -> DataFrame:
    return a.withColumn("j", F.when(F.col("j") == p, q).when(F.col("j") == q, p).otherwise(F.col("j")))


def swap_diagonal(a: DataFrame, p: int, q: int) -> DataFrame:
    """Exchanges two cells of the diagonal."""
    at = F.when(F.col("i") == p, q).when(F.col("i") == q, p).otherwise(F.col("i"))
    on = F.col("i") == F.col("j")
    return a.select(F.when(on, at).otherwise(F.col("i")).alias("i"), F.when(on, at).otherwise(F.col("j")).alias("j"), "v")


def flip_column(a: DataFrame, p: int) -> DataFrame:
    return a.withColumn("v", F.when(F.col("j") == p, -F.col("v")).otherwise(F.col("v")))


def largest_off_diagonal(a: DataFrame) -> DataFrame:
    """i, j of the off-diagonal cell of the largest absolute value, the first of equal ones."""
    return a.where("i <> j").agg(F.min_by(F.struct("i", "j"), F.struct(-F.abs("v"), "i", "j")).alias("c")).select("c.i", "c.j")


def eigen(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors as columns."""
    values, vectors = np.linalg.eigh(symmetric)
    return values[::-1].copy(), vectors[:, ::-1].copy()


def small(a: DataFrame, n: int, m: int) -> np.ndarray:
    """A matrix of checked size, on the driver."""
    if n * m > MOST_COLUMNS**2:
        raise ValueError(f"{n} x {m} cells are too many for one place")
    out = np.zeros((n, m))
    for i, j, v in a.toPandas().itertuples(index=False):
        out[int(i), int(j)] = v
    return out


def svd(a: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U (as i, j, v), the singular values, V of A = U S V': A'A is summed by Spark and decomposed in one place, and
    U = A V / S is computed by Spark, so that the signs agree. Values below tolerance of the largest are left out."""
    spark = a.sparkSession
    m = (a.agg(F.max("j")).first()[0] or 0) + 1
    if m > MOST_COLUMNS:
        raise ValueError(f"{m} columns are too many to decompose in one place")
    values, v = eigen(small(gram_columns(a), m, m))
    sigma = np.sqrt(np.maximum(values, 0))
    kept = int((sigma > tolerance * max(sigma[0], 1e-300)).sum())
    sigma, v = sigma[:kept], v[:, :kept]
    cells = [(i, j, float(v[i, j] / sigma[j])) for i in range(m) for j in range(kept)]
    return multiply(a, spark.createDataFrame(cells, "i int, j int, v double")), sigma, v


def eigen_pairs(symmetric: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Eigenvalues (k, value), largest first, and eigenvectors as columns (i, j, v) of a symmetric n x n matrix."""
    if n < 2:
        raise ValueError("two rows at least")
    values, vectors = eigen(small(symmetric, n, n))
    spark = symmetric.sparkSession
    cells = [(i, j, float(vectors[i, j])) for i in range(n) for j in range(n)]
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k int, value double"), spark.createDataFrame(cells, "i int, j int, v double")


def eigenvalues_agree(a: DataFrame, n: int, m: int, most: float = 1e-6) -> DataFrame:
    """k, agree: whether the k-th eigenvalues of A A' and A' A are the same, for the min(n, m) they have in common."""
    left, right = (eigen(small(g, d, d))[0] for g, d in ((gram_rows(a), n), (gram_columns(a), m)))
    pairs = [(k, bool(abs(x - y) <= most * max(1.0, abs(x)))) for k, (x, y) in enumerate(zip(left, right, strict=False))]
    return a.sparkSession.createDataFrame(pairs, "k int, agree boolean")


def lines(a: DataFrame) -> DataFrame:
    """i, line: each row's numbers in order, with six digits."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: F.format_string("%.6f", c["v"]))
    return a.groupBy("i").agg(F.array_join(cells, " ").alias("line"))


def singular_values(a: DataFrame) -> DataFrame:
    """k (from 0) and sigma, largest first."""
    _, sigma, _ = svd(a)
    return a.sparkSession.createDataFrame([(k, float(s)) for k, s in enumerate(sigma)], "k int, sigma double")


def reconstruction_error(a: DataFrame) -> DataFrame:
    """errors: cells of U S V' that differ from A by more than 1e-6; cells."""
    u, sigma, v = svd(a)
    back = [(j, i, float(sigma[j] * v[i, j])) for i in range(v.shape[0]) for j in range(len(sigma))]
    again = multiply(u, a.sparkSession.createDataFrame(back, "i int, j int, v double"))
    both = a.join(again.withColumnRenamed("v", "w"), ["i", "j"], "full")
    off = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > 1e-6
    return both.agg(F.sum(off.cast("long")).alias("errors"), F.count("*").alias("cells"))
