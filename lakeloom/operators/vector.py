"""Vector search: exact top-k by cosine, L2 or dot product, and an inverted-file index with exact re-ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.errors import QueryError
from lakeloom.operators.relational import quoted

METRICS = ("cosine", "l2", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distance(vector: Column, query, metric: str = "cosine") -> Column:
    """Distance of an array column to a query (numbers, or another array column); null where lengths differ.

    Cosine of a zero vector is distance 1; ``l2`` is squared; ``dot`` is negated.
    """
    if metric not in METRICS:
        raise QueryError("INVALID_FILTER", f"no metric {metric!r}")
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    q = F.transform(q, lambda x: x.cast("double"))
    if metric == "l2":
        out = _sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    else:
        dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
        if metric == "dot":
            out = -dot
        else:
            norm = F.sqrt(_sum(F.transform(v, lambda x: x * x))) * F.sqrt(_sum(F.transform(q, lambda x: x * x)))
            out = F.when(norm > 0, 1.0 - dot / norm).otherwise(1.0)
    return F.when(F.size(vector) == F.size(q), out)


def nearest(df: DataFrame, column: str, query, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The ``k`` rows nearest to the query with ``_distance`` and ``_score`` (higher is nearer); ties by the other columns."""
    if k < 1:
        raise QueryError("INVALID_FILTER", "k is at least 1")
    d = F.col("_distance")
    score = {"cosine": 1.0 - d, "l2": 1.0 / (1.0 + d), "dot": -d}[metric]
    ranked = df.withColumn("_distance", distance(quoted(column), query, metric)).where("_distance IS NOT NULL")
    ties = [quoted(f.name) for f in df.schema.fields if f.name != column and f.dataType.typeName() in ("long", "integer", "string")]
    return ranked.withColumn("_score", score).orderBy(d, *ties).limit(k)


NEAR = "left_id long, right_id long, distance double"


def _vectors(column) -> list:
    """``(rows, matrix)`` for each length of the vectors of an Arrow column; nulls in a vector are NaN, null vectors go."""
    import numpy as np

    lengths = np.asarray(column.value_lengths().fill_null(-1))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.maximum(lengths, 0))
    out = []
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        out.append((rows, values.reshape(-1, n) if n and len(values) == n * len(rows) else values[(ends[rows] - n)[:, None] + np.arange(n)]))
    return out


def _total(products):
    """Sums of rows, number after number as the SQL adds, so that a pair has one distance wherever it is met."""
    import numpy as np

    out = np.zeros(len(products))
    for j in range(products.shape[1]):
        out += products[:, j]
    return out


def _measured(q, x, squares, metric: str):
    """Distances of the rows of ``q`` to those of ``x`` beside them, whose squared lengths are ``squares``."""
    import numpy as np

    if metric == "l2":
        return _total((q - x) ** 2)
    dot = _total(q * x)
    if metric == "dot":
        return -dot
    product = squares[0] * squares[1]
    norm = np.where((product > 1e-290) & (product < 1e290), np.sqrt(product), np.sqrt(squares[0]) * np.sqrt(squares[1]))
    return np.where(norm > 0, 1 - np.clip(dot / np.where(norm > 0, norm, 1), -1, 1), 1.0)


class _Nearest:
    """The ``k`` nearest rows so far of each of a set of queries of one length.

    A matrix product gives bounds below the distances of all pairs; those whose bound is within the ``k``-th
    distance so far are measured, and ties go by the row's id.  So nothing is lost to the product's rounding.
    """

    def __init__(self, k: int, metric: str, block: int):
        self.k, self.metric, self.block, self.parts, self.queries = k, metric, block, [], None

    def add(self, ids, vectors) -> None:
        self.parts.append((ids, vectors))

    def _side(self, v, left: bool):
        """Vectors, squared lengths, those whose bounds need no care with large or small numbers, and the factor of the matrix product."""
        import numpy as np

        squares, slack = _total(v * v), 8 * (v.shape[1] + 8) * np.finfo(float).eps
        length = np.sqrt(squares)[:, None]
        if self.metric == "cosine":
            factor = v / np.where(length > 0, length, 1)
        elif self.metric == "dot":
            factor = np.hstack([v, length * slack if left else length])
        else:
            factor = np.hstack([-2 * v if left else v, *([squares[:, None] * (1 - slack), np.ones_like(length)][:: 1 if left else -1])])
        return v, squares, ~v.any(axis=1) | ((squares > 1e-150) & (squares < 1e150)), factor

    def _below(self, left, right):
        """Bounds below the distances of all of ``left`` to all of ``right``; NaN where a distance is NaN."""
        import numpy as np

        out = left[3] @ right[3].T
        if self.metric == "cosine":
            out = 1 - 8 * (left[0].shape[1] + 8) * np.finfo(float).eps - out
        elif self.metric == "dot":
            out = -out
        for i in np.flatnonzero(~left[2]):
            out[i] = _measured(left[0][i][None], right[0], (left[1][i], right[1]), self.metric)
        for j in np.flatnonzero(~right[2]):
            out[:, j] = _measured(left[0], right[0][j][None], (left[1], right[1][j]), self.metric)
        return out

    def _distances(self, left, right, i, j):
        import numpy as np

        step = max(1, 2**20 // (left[0].shape[1] + 1))
        parts = [(i[lo : lo + step], j[lo : lo + step]) for lo in range(0, len(i), step)]
        return np.concatenate([_measured(left[0][a], right[0][b], (left[1][a], right[1][b]), self.metric) for a, b in parts] or [np.zeros(0)])

    def meet(self, ids, vectors) -> None:
        import numpy as np
        import pyarrow as pa

        with np.errstate(all="ignore"):
            if self.queries is None:
                self.ids, self.queries = pa.concat_arrays([p[0] for p in self.parts]), self._side(np.concatenate([p[1] for p in self.parts]), True)
                self.parts = []
                self.distance, self.right = np.full((len(self.ids), self.k), np.nan), np.zeros((len(self.ids), self.k), np.int64)
            right = self._side(vectors, False)
            for lo in range(0, len(self.ids), self.block):
                self._meet(slice(lo, lo + self.block), ids, right)

    def _meet(self, at: slice, ids, right) -> None:
        import numpy as np

        left, k = tuple(c[at] for c in self.queries), self.k
        below, far = self._below(left, right), self.distance[at, -1].copy()
        if len(ids) > k and (new := np.flatnonzero(np.isnan(far))).size:  # the distances of any k rows bound the k-th
            some = np.argpartition(below[new], k - 1, axis=1)[:, :k]
            far[new] = self._distances(left, right, np.repeat(new, k), some.ravel()).reshape(-1, k).max(axis=1)
        far[np.isnan(far)] = np.inf
        i, j = np.divmod(np.flatnonzero(below <= far[:, None]), len(ids))
        d = self._distances(left, right, i, j)
        kept = d <= far[i]
        i, j, d = i[kept], j[kept], d[kept]
        if not len(i):
            return
        rows, i = np.unique(i, return_inverse=True)
        i = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
        d = np.concatenate([self.distance[at][rows].ravel(), d])
        r = np.concatenate([self.right[at][rows].ravel(), ids[j]])
        order = np.lexsort((r, d, i))
        i, d, r = i[order], d[order], r[order]
        place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i]
        i, d, r, place = (c[place < k] for c in (i, d, r, place))
        self.distance[at.start + rows[i], place], self.right[at.start + rows[i], place] = d, r

    def found(self):
        """Batches of ``NEAR``."""
        import numpy as np
        import pyarrow as pa

        for lo in range(0, 0 if self.queries is None else len(self.ids), 1024):
            i, place = np.nonzero(~np.isnan(self.distance[lo : lo + 1024]))
            columns = self.ids.take(pa.array(lo + i)), pa.array(self.right[lo + i, place]), pa.array(self.distance[lo + i, place])
            yield pa.RecordBatch.from_arrays(list(columns), names=["left_id", "right_id", "distance"])


PAIRS = 2**27


def _met(left: DataFrame, right: DataFrame, queries: int, counts: list[int], k: int, metric: str, block: int, chunk: int) -> DataFrame:
    """``NEAR``: of each left row the ``k`` nearest right rows of its cell, in each piece of the cell.

    Both sides are ``(cell, i, v)``; ``queries`` is the number of left rows of a cell at most, and ``counts`` has
    the right rows of each cell.  Each group of left rows meets
    each piece of its cell's right rows in a task of its own, of about ``PAIRS`` pairs (more, with the root of
    all pairs, in joins of over 128 such tasks); the task holds its left rows and lets the right ones pass by.
    """
    queries = max(1, queries)
    pairs = max(PAIRS, math.isqrt(queries * sum(counts) * PAIRS // 128))
    group = min(queries, max(1, math.isqrt(pairs // 4)), 2**14)  # a left row goes on with k answers: about four times a right row
    groups, pieces = -(-queries // group), [max(1, -(-n * group // pairs)) for n in counts]
    base = [groups * sum(pieces[:c]) for c in range(len(pieces))]

    def of(values) -> Column:
        return F.get(F.array(*[F.lit(x) for x in values]), "cell")

    def dealt(df: DataFrame, own: Column, copies: Column, task, side: int) -> DataFrame:
        df = df.where("v IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("i", "v"), own)).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        return df.select((of(base) + task(F.col("own"), F.col("copy"))).cast("int").alias("task"), F.lit(side).alias("side"), "i", "v")

    one = dealt(left, F.lit(groups), of(pieces), lambda own, copy: own * of(pieces) + copy, 0)
    two = dealt(right, of(pieces), F.lit(groups), lambda own, copy: copy * of(pieces) + own, 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, _Nearest] = {}
        for b in batches:
            cut = int(np.searchsorted(b.column(0).to_numpy(), 1))
            asked, rows = b.slice(0, cut), b.slice(cut)
            for at, vectors in _vectors(asked.column(2)):
                held.setdefault(vectors.shape[1], _Nearest(k, metric, block)).add(asked.column(1).take(pa.array(at)), vectors)
            for at, vectors in _vectors(rows.column(2)):
                if near := held.get(vectors.shape[1]):
                    ids = rows.column(1).to_numpy()[at]
                    for lo in range(0, len(ids), chunk):
                        near.meet(ids[lo : lo + chunk], vectors[lo : lo + chunk])
        for near in held.values():
            yield from near.found()

    return one.union(two).repartitionById(base[-1] + groups * pieces[-1], "task").sortWithinPartitions("side").select("side", "i", "v").mapInArrow(run, NEAR)


def _numbers(*vectors: tuple[DataFrame, str]) -> str:
    """The type in which vectors are exchanged: floats where all are."""
    return "array<float>" if all(df.select(quoted(c)).dtypes[0][1] == "array<float>" for df, c in vectors) else "array<double>"


def near_join(left: DataFrame, left_vector: str, left_id: str, right: DataFrame, right_vector: str, right_id: str, k: int = 20, metric: str = "cosine", block: int = 256, chunk: int = 4096) -> DataFrame:
    """For each left row (a stated query set) its ``k`` nearest right rows: ids, distance, rank.

    Groups of queries meet pieces of the rows, each pair in one place, and only ``k`` rows a query and piece are
    exchanged; nothing but two counts passes through the driver.  A task compares ``block`` queries to ``chunk``
    rows at once.  Ties go by the right id; null vectors and vectors of another length have no neighbours.
    """
    if metric not in METRICS:
        raise QueryError("INVALID_FILTER", f"no metric {metric!r}")
    kind = _numbers((left, left_vector), (right, right_vector))
    one, two = (df.select(F.lit(0).alias("cell"), quoted(i).cast("long").alias("i"), quoted(v).cast(kind).alias("v")) for df, v, i in ((left, left_vector, left_id), (right, right_vector, right_id)))
    return _ranked(_met(one, two, one.count(), [two.count()], k, metric, block, chunk), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("left_id").orderBy("distance", "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _centres(points, k: int, seed: int, rounds: int = 12):
    """Centres by k-means: distant rows first, then Lloyd's rounds."""
    import numpy as np

    r = np.random.default_rng(seed)
    k = min(k, len(np.unique(points, axis=0)))
    found = [points[r.integers(len(points))]]
    far = ((points - found[0]) ** 2).sum(axis=1)
    while len(found) < k:
        found.append(points[r.choice(len(points), p=far / far.sum())])
        far = np.minimum(far, ((points - found[-1]) ** 2).sum(axis=1))
    out = np.array(found)
    for _ in range(rounds):
        near = _nearest_centre(points, out)
        for c in range(len(out)):
            if (own := points[near == c]).size:
                out[c] = own.mean(axis=0)
    return out


def _nearest_centre(points, centres):
    return ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def _sample(df: DataFrame, column: str, size: int):
    """At most ``size`` vectors, those of the smallest hashes, all of the most frequent length."""
    import numpy as np

    rows = df.select(quoted(column).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").orderBy(F.xxhash64("v")).limit(size).toArrow().column(0).to_pylist()
    if not rows:
        raise QueryError("INVALID_FILTER", "no vectors to fit on")
    lengths = [len(v) for v in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return np.array([v for v in rows if len(v) == dim])


def clustered(df: DataFrame, column: str, k: int = 20, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """``df`` with ``_cluster``, the number of the nearest of ``k`` centres; null for a null vector or one of another length.

    The centres are fitted on at most ``sample`` rows; every row is assigned.
    """
    centres = _centres(_sample(df, column, sample), k, seed)
    return _with_codes(df, column, [centres], "_cluster").withColumn("_cluster", F.get("_cluster", F.lit(0)).cast("int"))


def _unit(points):
    """Rows of length 1; rows of zeros stay."""
    import numpy as np

    norm = np.sqrt((points * points).sum(axis=1, keepdims=True))
    return points / np.where(norm > 0, norm, 1)


def _usable(column, dim: int) -> list:
    """``_vectors`` of ``dim`` numbers without nulls, if there are any."""
    import numpy as np

    bare = column.flatten()
    whole = np.ones(len(column), bool)
    if bare.null_count:
        lengths = np.maximum(np.asarray(column.value_lengths().fill_null(0)), 0)
        whole[np.repeat(np.arange(len(column)), lengths)[np.asarray(bare.is_null())]] = False
    return [(at[whole[at]], v[whole[at]]) for at, v in _vectors(column) if v.shape[1] == dim and whole[at].any()]


def _with_codes(df: DataFrame, column: str, books: list, name: str, unit: bool = False) -> DataFrame:
    """``df`` with the array of the nearest entries of each book, which cover the vector (at length 1 with ``unit``) one after the other."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

    kept = df.drop(name)
    at = kept.columns.index(column)
    widths = [b.shape[1] for b in books]

    def run(batches):
        for b in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
            codes: list = [None] * b.num_rows
            for good, points in _usable(b.column(at).cast(pa.list_(pa.float64())), sum(widths)):
                points, lo, parts = _unit(points) if unit else points, 0, []
                for book, w in zip(books, widths):
                    parts.append(_nearest_centre(points[:, lo : lo + w], book))
                    lo += w
                for i, c in zip(good.tolist(), np.array(parts).T.tolist()):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int16()))], names=[*b.schema.names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, ArrayType(ShortType()))]))


class IvfIndex:
    """Inverted file with product quantisation, stored as Parquet with one folder for each cell.

    A search reads the folders of the nearest ``probes`` cells, orders their rows by the distances of their
    codes, and ranks the best exactly.  Centres and code books are fitted on a sample of at most
    ``sample`` rows; every row is indexed, rows without a usable vector under cell -1.  An index is made
    for one metric: for cosine, cells and codes are those of the vectors at length 1.
    """

    def __init__(self, rows: DataFrame, column: str, centres, books: list, metric: str = "cosine"):
        self.rows, self.column, self.centres, self.books, self.metric = rows, column, centres, books, metric

    @classmethod
    def build(cls, df: DataFrame, column: str, path: str, cells: int = 16, subvectors: int = 8, codes: int = 256, sample: int = 20_000, seed: int = 1, metric: str = "cosine") -> "IvfIndex":
        import json

        import numpy as np

        if metric not in METRICS:
            raise QueryError("INVALID_FILTER", f"no metric {metric!r}")
        points, unit = _sample(df, column, sample), metric == "cosine"
        points = _unit(points) if unit else points
        centres = _centres(points, cells, seed)
        books = [_centres(part, codes, seed + 1 + i, 6) for i, part in enumerate(np.array_split(points, min(subvectors, points.shape[1]), axis=1))]
        coded = _with_codes(_with_codes(df, column, books, "__code", unit), column, [centres], "__cell", unit)
        coded = coded.withColumn("__cell", F.coalesce(F.get("__cell", F.lit(0)).cast("int"), F.lit(-1)))
        coded.write.partitionBy("__cell").parquet(f"{path}/rows")
        about = json.dumps({"column": column, "centres": centres.tolist(), "books": [b.tolist() for b in books], "metric": metric})
        df.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
        return cls.load(df.sparkSession, path)

    @classmethod
    def load(cls, spark, path: str) -> "IvfIndex":
        import json

        import numpy as np

        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        return cls(spark.read.parquet(f"{path}/rows"), about["column"], np.array(about["centres"]), [np.array(b) for b in about["books"]], about["metric"])

    def _placed(self, query):
        import numpy as np

        if len(query) != self.centres.shape[1]:
            raise QueryError("INVALID_FILTER", f"the index holds vectors of {self.centres.shape[1]} numbers")
        q = np.array([query], dtype=float)
        return (_unit(q) if self.metric == "cosine" else q)[0]

    def cells(self, query, probes: int) -> list[int]:
        """The cells of the nearest centres, nearest first."""
        return sorted(range(len(self.centres)), key=lambda i, q=self._placed(query): (math.dist(self.centres[i], q), i))[:probes]

    def candidates(self, query, probes: int = 12) -> DataFrame:
        """The rows of the nearest cells; other cells' folders are not read."""
        return self.rows.where(F.col("__cell").isin(self.cells(query, probes)))

    def search(self, query, k: int = 10, probes: int = 12, again: int = 20) -> DataFrame:
        """The ``k`` nearest of the probed rows; ``again`` times as many are taken by their codes and ranked exactly."""
        q, lo, near = self._placed(query), 0, F.lit(0.0)
        for i, book in enumerate(self.books):
            part = q[lo : lo + book.shape[1]]
            lo += book.shape[1]
            table = -(book @ part) if self.metric == "dot" else ((book - part) ** 2).sum(axis=1)
            near = near + F.get(F.array(*[F.lit(float(x)) for x in table]), F.get("__code", F.lit(i)).cast("int"))
        short = self.candidates(query, probes).withColumn("__near", near).orderBy("__near").limit(k * again)
        return nearest(short.drop("__near", "__cell", "__code"), self.column, query, k, self.metric)

    def join(self, left: DataFrame, left_vector: str, left_id: str, right_id: str, k: int = 20, probes: int = 12, block: int = 256, chunk: int = 4096) -> DataFrame:
        """``near_join`` against the index: queries meet only the rows of their nearest cells."""
        kind = _numbers((left, left_vector), (self.rows, self.column))
        queries = _with_cells(left.select(quoted(left_id).cast("long").alias("i"), quoted(left_vector).cast(kind).alias("v")), self.centres, probes, self.metric == "cosine")
        rows = self.rows.select(F.col("__cell").alias("cell"), quoted(right_id).cast("long").alias("i"), quoted(self.column).cast(kind).alias("v")).where("cell >= 0")
        counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
        met = _met(queries.select(F.explode("cells").alias("cell"), "i", "v"), rows, left.count(), [counts.get(c, 0) for c in range(len(self.centres))], k, self.metric, block, chunk)
        return _ranked(met, k)


def _with_cells(queries: DataFrame, centres, probes: int, unit: bool) -> DataFrame:
    """``(i, v)`` with the array ``cells`` of each vector's nearest centres; rows without a usable vector go."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in (batch.slice(lo, 1024) for batch in batches for lo in range(0, batch.num_rows, 1024)):
            for at, q in _usable(b.column(1), centres.shape[1]):
                q = _unit(q) if unit else q
                near = np.argsort(((q[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["i", "v", "cells"])

    return queries.mapInArrow(run, f"i long, v {queries.schema['v'].dataType.simpleString()}, cells array<int>")
