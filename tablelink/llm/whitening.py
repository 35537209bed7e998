"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never brought together. A pass over them adds up the Gram matrix
of A R^-1, where R holds the factors found so far; its Cholesky factor is composed with
R. The first pass adds a shift to the diagonal, so that the factor exists however badly
conditioned the rows are; later passes bring the rows to orthonormal columns. Then
A'A = R'R, and the singular values and right vectors of the small R are those of A,
without the loss of digits that squaring A once would cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import given_back, shared_object, stored

_FAR = float(1 << 62)


def whole_vector(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * x) + shift of each component, as double, as long; null for a vector
    that is null or has a null or non-finite component."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long") + shift)
    return F.when(vector.isNotNull() & ~bad, made)


def _matrix(vectors: pd.Series, width: int, fill: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up at the right."""
    out = np.full((len(vectors), width), fill, dtype=np.int64)
    for at, vector in enumerate(vectors):
        out[at, : len(vector)] = vector
    return out


def _sums(rows: DataFrame, width: int, fill: int) -> np.ndarray:
    """Sum of each dimension, exact. Every task adds up its rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += _matrix(batch["x"], width, fill).sum(axis=0)
        yield pd.DataFrame({"dimension": np.arange(width), "total": total})

    added = rows.select("x").mapInPandas(given_back(add), "dimension int, total long")
    out = np.zeros(width, dtype=np.int64)
    for row in added.groupBy("dimension").agg(F.sum("total").alias("total")).collect():
        out[row["dimension"]] = row["total"]
    return out


def _gram(rows: DataFrame, made: Callable[[pd.Series], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of the outer product of `made` with itself.

    Every task adds up a matrix of its own and gives it away row by row; the rows of the
    matrices are added up by their number, as they come in. The driver gets one matrix.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            values = made(batch["x"])
            total += values.T @ values
        yield pd.DataFrame({"number": np.arange(width), "line": [line.tobytes() for line in total]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, line in zip(batch["number"].tolist(), batch["line"]):
                lines[number] = lines.get(number, 0) + np.frombuffer(line)
        yield pd.DataFrame({"number": list(lines), "line": [line.tobytes() for line in lines.values()]})

    kind = "number long, line binary"
    added = rows.select("x").mapInPandas(given_back(partial), kind).repartition("number").mapInPandas(given_back(add), kind)
    out = np.zeros((width, width))
    for row in added.collect():
        out[row["number"]] = np.frombuffer(row["line"])
    return out


def triangular_factor(
    gram_of: Callable[[np.ndarray], np.ndarray], width: int, n_rows: int, passes: int = 5
) -> np.ndarray:
    """R with R'R = A'A, by shifted CholeskyQR.

    gram_of  the Gram matrix of the rows A S, given S
    passes   at most this many; fewer once the columns are orthonormal

    Directions in which the rows do not differ, beyond rounding, leave after the shifted
    pass; R has a row less for each.
    """
    tiny = np.finfo(float).eps
    factor, solved = np.eye(width), np.eye(width)
    for at in range(passes):
        gram = gram_of(solved)
        size = float(np.trace(gram))
        if size == 0.0:
            return np.zeros((0, width))
        if at and np.abs(gram - np.eye(len(gram))).max() < 64 * tiny * width:
            break
        shift = 11 * (n_rows * width + width * (width + 1)) * tiny * size if at == 0 else 0.0
        values, vectors = np.linalg.eigh(gram)
        real = values > (1e3 * width * tiny * values[-1] if at else -np.inf)
        if real.all():
            step = np.linalg.cholesky(gram + min(shift, size / width) * np.eye(len(gram))).T
        else:
            step = np.sqrt(values[real])[:, None] * vectors[:, real].T
        if at == passes - 1:
            return step @ factor
        factor = step @ factor
        # A S keeps its rows' order of magnitude: S is solved step by step, not from R.
        if real.all():
            solved = np.linalg.solve(step.T, solved.T).T
        else:
            solved = solved @ (vectors[:, real] / np.sqrt(values[real]))
    return np.linalg.cholesky(gram).T @ factor


class Whitening:
    """What was fitted: `n` rows, their `sums`, `components` (one per row, falling) and
    their eigenvalues, and the sum of all eigenvalues."""

    def __init__(self, n: int, sums: np.ndarray, factor: np.ndarray, most: int, fill: int):
        self.n, self.sums, self.fill = n, sums, fill
        _, sizes, vectors = np.linalg.svd(factor, full_matrices=False)
        values = sizes**2 / max(n, 1)
        self.trace = float(values.sum())
        rounding = len(sums) * np.finfo(float).eps * max(n, 1) ** 0.5
        real = int((sizes > sizes.max(initial=0.0) * rounding).sum()) if self.trace else 0
        used = min(most, real)
        self.values, self.components = values[:used], vectors[:used]

    def centred(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """x - sums / n from whole numbers, and n * x - sums where it fits."""
        x = _matrix(vectors, len(self.sums), self.fill)
        whole = self.sums // max(self.n, 1)
        rest = self.sums - whole * max(self.n, 1)
        return (x - whole).astype(float) - rest / max(self.n, 1), x

    def whitened(self, vectors: pd.Series) -> np.ndarray:
        return self.centred(vectors)[0] @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, vectors: pd.Series) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)^2; None beyond 64 bits."""
        near, x = self.centred(vectors)
        about = ((near * self.n) ** 2).sum(axis=1)
        if len(about) and about.max() < _FAR and np.abs(x).max(initial=0) * float(self.n) < _FAR:
            return ((x * self.n - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((a * self.n - s) ** 2 for a, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def fit(rows: DataFrame, most: int = 16, fill: int = 0) -> tuple[Whitening, DataFrame]:
    """Fit the whitening of the different vectors `x` (arrays of whole numbers) of a
    table; also gives the stored list of those.

    most  components kept, of those that differ from 0 by more than rounding
    fill  what shorter vectors are filled up with
    """
    different = stored(rows.select("x").distinct())
    found = different.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = found["n"], found["width"] or 0
    if not n or not width:
        return Whitening(n, np.zeros(width, np.int64), np.zeros((width, width)), 0, fill), different
    sums = _sums(different, width, fill)
    blank = Whitening(n, sums, np.zeros((width, width)), 0, fill)

    def gram_of(solved: np.ndarray) -> np.ndarray:
        shared = shared_object(rows.sparkSession, (blank, solved))

        def made(vectors: pd.Series) -> np.ndarray:
            centre, solve = shared()
            return centre.centred(vectors)[0] @ solve

        return _gram(different, made, solved.shape[1])

    return Whitening(n, sums, triangular_factor(gram_of, width, n), most, fill), different


def identity_error(fitted: Whitening, different: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the
    identity; None without components."""
    k = len(fitted.values)
    if not k:
        return None
    shared = shared_object(different.sparkSession, fitted)

    def made(vectors: pd.Series) -> np.ndarray:
        return np.column_stack((shared().whitened(vectors), np.ones(len(vectors))))

    gram = _gram(different, made, k + 1) / fitted.n
    mean = gram[k, :k]
    return float(np.abs(gram[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    rows: DataFrame,
    vector: str = "embedding",
    scale: int = 64,
    shift: int = 1_000_000,
    components: int = 16,
    into: str = "whitening",
) -> DataFrame:
    """Rows with a finite vector, with the column `into`: n long (different vectors),
    deviation long (sum of (n x - S)^2, S the sums of the different x), whitened and
    explained (array of double, per component), identity_error double.

    x is floor(scale * component) + shift, centred before anything is multiplied.
    Null vectors and those with a null or non-finite component drop out. Shorter vectors
    are filled up with 0 before scaling. Components of no variance are left out, so the
    arrays may be shorter than `components`, and are empty for vectors that are all
    alike; identity_error is null then. A deviation beyond 64 bits is null. Repeated
    rows stay, count once in the fit, and get the same numbers; an empty table stays
    empty. Null ids and further columns pass through, a column called `into` is
    replaced.
    """
    x = whole_vector(F.col(vector), scale, shift)
    good = rows.drop(into).withColumn(into, x).where(F.col(into).isNotNull())
    fitted, different = fit(good.select(F.col(into).alias("x")), components, shift)
    error = identity_error(fitted, different)
    shared = shared_object(rows.sparkSession, fitted)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(vectors: pd.Series) -> pd.DataFrame:
        model = shared()
        deviations = pd.Series(model.deviations(vectors), dtype="Int64")
        return pd.DataFrame({"deviation": deviations, "whitened": list(model.whitened(vectors))})

    explained = [float(value / fitted.trace) for value in fitted.values]
    made = good.withColumn(into, F.struct(F.lit(fitted.n).cast("long").alias("n"), project(into).alias("_made")))
    return made.withColumn(
        into,
        F.struct(
            F.col(into)["n"].alias("n"),
            F.col(into)["_made"]["deviation"].alias("deviation"),
            F.col(into)["_made"]["whitened"].alias("whitened"),
            F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        ),
    )
