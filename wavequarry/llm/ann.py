"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on full lists; every
vector is indexed: it goes to its nearest list and, near a boundary, to the
lists about as near.  A query walks an in-memory graph of the centroids and
searches the lists that a distance ratio leaves, and further ones until they
hold enough vectors; a query that still finds too few is compared with every
vector of its length.  Lists grow in number with the table, up to a bound;
those longer than a block are dealt to blocks, and so are a list's queries, so
no task holds a list.  What a vector's or query's lists multiply, distances to
all centroids and copies of a vector for each list, is made in pieces.
The largest inner product is found as the least distance after a coordinate
that fills every vector up to the largest norm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
#: Vectors that centroids are fitted on, and centroids, at most; vectors of a list, about, below that many lists.
SAMPLE = 32_768
LISTS = 2048
PER_LIST = 256
#: Vector lengths that get an index of their own, at most.
INDEXED = 8
REPLICAS = 4
#: A vector also joins lists within this ratio of its nearest distance.
CLOSURE = 1.06
#: A query searches lists within this ratio of its nearest distance.
RATIO = 1.25
#: Lists in which a query first searches; the others give only what is no worse than its k-th hit there.
START = 8
LIST_BLOCK, QUERY_BLOCK = 16_384, 8192
#: Longest vectors that these blocks are meant for; of longer ones a block holds fewer.
BLOCK_DIM = 64
#: Distances that are held at once, and bytes of rows that a task hands on at once, about.
CELLS = 1 << 20
PIECE = 4 << 20


def valid_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, size, norm2, vec): vectors that are neither null nor zero nor hold null or non-finite components.

    ``vec`` holds the components as doubles, eight bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), float("nan")), np.float64)
            ends = np.cumsum(sizes)
            fine = np.isfinite(flat)
            square = np.where(fine, flat, 0) ** 2
            wrong, total = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in ((~fine).astype(np.int64), (square > 0).astype(np.int64)))
            keep = np.flatnonzero((wrong == 0) & (total > 0))
            vecs = [flat[ends[k] - sizes[k] : ends[k]] for k in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(sizes[keep], pa.int32()), pa.array([float((v * v).sum()) for v in vecs], pa.float64()), pa.array([v.tobytes() for v in vecs], pa.binary())],
                ["vec_id", "size", "norm2", "vec"],
            )

    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).where("vec_id IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, size int, norm2 double, vec binary")


def _matrix(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist())).reshape(-1, dim)


@dataclass
class ListIndex:
    """Centroids, the graph between them, and the norm that vectors are filled to."""

    centroids: np.ndarray
    near: np.ndarray
    norm: float

    def fill(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def distances(self, filled: np.ndarray) -> np.ndarray:
        d = (filled * filled).sum(axis=1)[:, None] - 2 * filled @ self.centroids.T + (self.centroids * self.centroids).sum(axis=1)
        return np.sqrt(np.maximum(d, 0))

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and those about as near."""
        lists, step = [], max(1, CELLS // max(self.centroids.shape))
        for begin in range(0, len(x), step):
            d = self.distances(self.fill(x[begin : begin + step]))
            order = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS].copy()
            near = np.take_along_axis(d, order, axis=1)
            lists += [o[n <= CLOSURE * n[0]] for o, n in zip(order, near, strict=True)]
        return lists

    def walk(self, query: np.ndarray, ratio: float, held: list[int], enough: int, least: int = 8) -> list[int]:
        """Lists within the ratio of the nearest found, by best-first walk of the graph.

        The walk begins at the best of a few spread centroids.  The next
        nearest lists follow until all hold ``enough`` vectors by ``held``,
        which counts each vector in one list.  Nearest lists come first.
        """

        def distances(some: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.centroids[some] - query) ** 2).sum(axis=1))

        starts = np.arange(0, len(self.centroids), max(1, len(self.centroids) // 16))
        seen = dict(zip(starts.tolist(), distances(starts).tolist(), strict=True))
        frontier = [(d, k) for k, d in seen.items()]
        heapq.heapify(frontier)
        best, settled, total = frontier[0][0], 0, sum(held[k] for k in seen)
        while frontier:
            d, k = heapq.heappop(frontier)
            if d > ratio * best and settled >= least and total >= enough:
                break
            settled += 1
            fresh = np.array([n for n in self.near[k].tolist() if n not in seen], np.int64)
            if len(fresh):
                for n, far in zip(fresh.tolist(), distances(fresh).tolist(), strict=True):
                    if n not in seen:
                        seen[n] = far
                        total += held[n]
                        best = min(best, far)
                        heapq.heappush(frontier, (far, n))
        lists, covered = [], 0
        for k, d in sorted(seen.items(), key=lambda s: s[1]):
            if d > ratio * best and covered >= enough:
                break
            lists.append(k)
            covered += held[k]
        return lists


def fit_lists(x: np.ndarray, n_lists: int, norm: float, rounds: int = 12) -> ListIndex:
    """Balanced k-means on a sample: a list's size adds to the cost of joining it."""
    rng = np.random.default_rng(11)
    index = ListIndex(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 0), int), norm)
    filled = index.fill(x)
    distinct = np.unique(filled, axis=0)
    n_lists = max(1, min(n_lists, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), n_lists, replace=False)].copy()
    sizes = np.full(n_lists, len(filled) / n_lists)
    for _ in range(rounds):
        index.centroids = centroids
        cuts = range(0, len(filled), 4096)
        spread = float(np.concatenate([index.distances(filled[c : c + 4096]).min(axis=1) ** 2 for c in cuts]).mean())
        penalty = 0.25 * spread * sizes / (len(filled) / n_lists)
        own = np.concatenate([np.argmin(index.distances(filled[c : c + 4096]) ** 2 + penalty, axis=1) for c in cuts])
        counts = np.bincount(own, minlength=n_lists)
        sizes = 0.5 * sizes + 0.5 * counts
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, filled)
        full = counts > 0
        centroids = centroids.copy()
        centroids[full] = sums[full] / counts[full, None]
    index.centroids = centroids
    degree = min(n_lists - 1, 12)
    d = index.distances(centroids)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :degree]
    ring = (np.arange(n_lists) + 1) % n_lists  # keeps the graph in one piece
    index.near = np.hstack([near, ring[:, None]]) if n_lists > 1 else np.zeros((1, 0), int)
    return index


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which of sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, reach: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores) of the k largest inner products of each query, ties to the smaller id.

    A matrix product finds what may be among them, with a margin above its
    rounding; those are summed again component by component, so that equal
    vectors have equal scores whichever block they stand in.  Equal ids with
    equal scores count once; where they leave a query short, ``reach`` grows.
    """
    reach = reach or k
    longest = np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))
    for begin in range(0, len(queries), 256):
        q, own = queries[begin : begin + 256], query_ids[begin : begin + 256]
        scores = q @ vectors.T
        scores[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(scores, len(ids) - reach, axis=1)[:, len(ids) - reach] if len(ids) > reach else np.full(len(q), -np.inf)
        margin = 1e-12 * longest * np.sqrt((q * q).sum(axis=1))
        row, at = np.nonzero((scores >= (least - margin)[:, None]) & (scores > -np.inf))
        exact = np.empty(len(row))
        step = max(1, 2 * CELLS // max(1, vectors.shape[1]))
        for cut in range(0, len(row), step):
            some = slice(cut, cut + step)
            exact[some] = np.cumsum(q[row[some]] * vectors[at[some]], axis=1)[:, -1]
        order = np.lexsort((ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        fresh = _fresh(row, exact, ids[at])
        row, at, exact = row[fresh], at[fresh], exact[fresh]
        again = (np.bincount(row, minlength=len(q)) < k) & (least > -np.inf)
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & ~again[row]
        yield own[row[keep]], ids[at[keep]], exact[keep]
        if again.any():
            yield from top_k(q[again], own[again], vectors, ids, k, 2 * reach)


def _copies(batch: pa.RecordBatch, lists: Iterator[np.ndarray | list[int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batch once for each of their lists, those lists, and their places among a row's, in pieces of about ``PIECE`` bytes."""
    limit = max(1, PIECE // (batch.nbytes // max(1, batch.num_rows) + 16))
    rows: list[np.ndarray] = []
    own: list[np.ndarray] = []
    places: list[np.ndarray] = []
    held = 0

    def piece() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        return batch.take(pa.array(np.concatenate(rows))), np.concatenate(own), np.concatenate(places)

    for row, of in enumerate(lists):
        for begin in range(0, len(of), limit):
            some = np.asarray(of[begin : begin + limit], np.int32)
            if held + len(some) > limit and held:
                yield piece()
                rows, own, places, held = [], [], [], 0
            rows.append(np.full(len(some), row))
            own.append(some)
            places.append(np.arange(begin, begin + len(some), dtype=np.int32))
            held += len(some)
    if held:
        yield piece()


@dataclass(frozen=True)
class _Part:
    """Vectors of one length with an index of their own."""

    dim: int
    index: ListIndex


def _hits(vecs: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score: of each query's first ``k`` among ``vecs``, all of one length, those of at least ``least``."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not vecs.num_rows or not queries.num_rows:
        return schema.empty_table()
    dim = vecs.column("dim")[0].as_py()
    # equal rows stand in the same lists and blocks: one of them is enough
    vecs = vecs.group_by(["vec_id", "vec"]).aggregate([])
    queries = queries.group_by(["query_id", "vec", "least"]).aggregate([])
    x, q = _matrix(vecs.column("vec"), dim), _matrix(queries.column("vec"), dim)
    ids, query_ids = np.array(vecs.column("vec_id")), np.array(queries.column("query_id"))
    of, vec_ids, scores = (np.concatenate(c) for c in zip(*top_k(q, query_ids, x, ids, k), strict=True))
    by_id = np.argsort(query_ids, kind="stable")
    fine = scores >= np.array(queries.column("least"))[by_id][np.searchsorted(query_ids[by_id], of)]
    of, vec_ids, scores = of[fine], vec_ids[fine], scores[fine]
    # rows of one query_id are one query
    order = np.lexsort((vec_ids, -scores, of))
    of, vec_ids, scores = of[order], vec_ids[order], scores[order]
    fresh = _fresh(of, scores, vec_ids)
    of, vec_ids, scores = of[fresh], vec_ids[fresh], scores[fresh]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k
    return pa.table([pa.array(of[first], pa.int64()), pa.array(vec_ids[first], pa.int64()), pa.array(scores[first])], schema=schema)


def _found(posted: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the first ``k`` in each of the lists that a query is routed to, of a score of at least ``least``.

    ``posted(dim, list, vec_id, vec)`` and ``routed(dim, list, query_id, vec,
    least)`` meet by list; a long list and its queries are dealt to blocks,
    and each pair of blocks is a task's group.
    """
    keys = ["dim", "list"]
    sizes = posted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(routed.groupBy(*keys).agg(F.count(F.lit(1)).alias("q")), keys)
    # one row for each list that is asked, at most ``LISTS`` for each of ``INDEXED`` lengths and one for other lengths
    wide = F.greatest(F.col("dim") / BLOCK_DIM, F.lit(1.0))
    sizes = materialize(sizes.select(F.col("dim").alias("s_dim"), F.col("list").alias("s_list"), F.ceil(F.col("n") * wide / LIST_BLOCK).alias("n_blocks"), F.ceil(F.col("q") * wide / QUERY_BLOCK).alias("q_blocks")), "lists")
    same = (F.col("dim") == F.col("s_dim")) & (F.col("list") == F.col("s_list"))
    left = posted.join(sizes, same).withColumn("b", F.pmod(F.xxhash64("vec_id", "vec"), F.col("n_blocks"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
    right = routed.join(sizes, same).withColumn("qb", F.pmod(F.xxhash64("query_id", "vec"), F.col("q_blocks"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    keys += ["b", "qb"]
    left, right = left.select(*keys, "vec_id", "vec"), right.select(*keys, "query_id", "vec", "least")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _hits(a, b, k), "query_id long, vec_id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the first ``k`` of each query."""
    # a candidate may come from several lists: it counts once; ranks are cut before the shuffle as well as after it
    found = hits.repartition("query_id").groupBy("query_id", "vec_id", "score").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def search(df: DataFrame, every: int = 20, k: int = K, n_lists: int = LISTS, sample: int = SAMPLE, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    are all rows but those of the query's own vec_id.  Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows
    without vec_id.  Vectors have an inner product with those of their own
    length only, so each length is searched by itself: the ``INDEXED`` most
    frequent ones by an index, any others against all of their length.  Rows
    of one vec_id are one candidate for each different score.  A query has
    ``k`` rows, or all its candidates where they are fewer.  An empty table
    gives no rows.  A large ``ratio`` searches all lists: the exact way.
    """
    spark = df.sparkSession
    vectors = materialize(valid_vectors(df).withColumnRenamed("size", "dim"), "vectors")
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).orderBy(F.desc("n"), F.desc("dim")).limit(INDEXED).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts: dict[int, _Part] = {}
    for row in sizes:
        if row["n"] > PER_LIST:
            some = vectors.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()
            parts[row["dim"]] = _Part(row["dim"], fit_lists(_matrix(some.column("vec"), row["dim"]), min(n_lists, row["n"] // PER_LIST), float(np.sqrt(row["norm2"]))))

    def by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                step = max(1, CELLS // max(dim, 128))
                for begin in range(0, some.num_rows, step):
                    yield some.slice(begin, step)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_dim(batches):
            part = parts.get(batch.column("dim")[0].as_py())
            lists = part.index.assign(_matrix(batch.column("vec"), part.dim)) if part else [np.zeros(1, int)] * batch.num_rows
            for taken, own, places in _copies(batch, lists):
                yield pa.RecordBatch.from_arrays([taken.column("dim"), pa.array(own), pa.array(places == 0), taken.column("vec_id"), taken.column("vec")], ["dim", "list", "first", "vec_id", "vec"])

    posted = materialize(vectors.mapInArrow(place, "dim int, list int, first boolean, vec_id long, vec binary"), "postings")
    # a number for each list, at most ``n_lists`` of them for each indexed length: vec_ids that it is nearest to
    told = posted.where(F.col("first") & F.col("dim").isin(*parts)).groupBy("dim", "list").agg(F.count_distinct("vec_id").alias("held")).collect() if parts else []
    held = {dim: [0] * len(part.index.centroids) for dim, part in parts.items()}
    for r in told:
        held[r["dim"]][r["list"]] = r["held"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_dim(batches):
            part = parts.get(batch.column("dim")[0].as_py())
            if part:
                x = _matrix(batch.column("vec"), part.dim)
                length = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)
                aimed = np.hstack([x / length[:, None] * part.index.norm, np.zeros((len(x), 1))])
                lists = (part.index.walk(q, ratio, held[part.dim], k + 1) for q in aimed)
            else:
                lists = iter([[0]] * batch.num_rows)
            for taken, own, places in _copies(batch, lists):
                yield pa.RecordBatch.from_arrays([taken.column("dim"), pa.array(own), pa.array(places), taken.column("vec_id"), taken.column("vec")], ["dim", "list", "place", "query_id", "vec"])

    queries = vectors.where(F.col("vec_id") % every == 0)
    routed = materialize(queries.mapInArrow(route, "dim int, list int, place int, query_id long, vec binary"), "routes")
    anything = F.lit(float("-inf")).alias("least")
    first = materialize(_ranked(_found(posted, routed.where(F.col("place") < START).select("*", anything), k), k), "first-hits")
    # what is worse than a query's k-th hit so far cannot be among its first k
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    others = routed.where(F.col("place") >= START).join(bounds, "query_id", "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf"))))
    best = materialize(_ranked(first.select("query_id", "vec_id", "score").unionByName(_found(posted, others, k)), k), "hits")
    # lists do not hold k candidates of some, by repeated rows or equal scores: all vectors of their length are one list
    counts = best.groupBy("query_id").count().where(F.col("count") >= k)
    indexed = queries.where(F.col("dim").isin(*parts)) if parts else queries.limit(0)
    short = materialize(indexed.select(F.col("dim"), F.lit(0).alias("list"), F.col("vec_id").alias("query_id"), "vec").join(counts.select("query_id"), "query_id", "left_anti"), "short")
    if not short.isEmpty():
        again = _ranked(_found(vectors.select("dim", F.lit(0).alias("list"), "vec_id", "vec"), short.select("dim", "list", "query_id", "vec", anything), k), k)
        best = best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return best.select("query_id", "rank", "vec_id", "score")
