"""Exact top-k search as a Voronoi kNN join.

Every vector goes to the cell of its nearest pivot; a cell's summary is its number of rows
and its radius. Queries are grouped by their cells into blocks of at most QUERY_ROWS. For a
query q the (k + 1)-th best score among the pivots, which are rows themselves, and the
cells' lower bounds p.q - r|q|, by their row counts, give a score that k rows reach. A cell
is needed by a block if p.q + r|q| reaches that for one of its queries. Only needed cells
are replicated to a block, in chunks of CHUNK_ROWS rows, solved there by one matrix product,
and the chunks' k best are ranked together.

Vectors are integers: floor(256 x) of each component as a double, kept as doubles, which
hold them exactly at any size. Cells and bounds are found in floating point, with room
for its error; the scores that are returned are exact. The score is the inner product;
the highest come first, of equal ones the smaller id.

Defined cases: a vector that is null, or holds a null or non-finite component, or has no
id, takes no part; a score beyond 64 bits is the end of their range, and such scores are
ties; components are held to 2**500 in size, where every score but 0 is beyond that range;
shorter vectors are filled up with zeros;
rows of a query's own id are its own and no candidates for it; repeated query rows give
one result; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, read, table

QUERY_ROWS = 1024
CHUNK_ROWS = 4096
#: Pivots: one for each PIVOT_ROWS rows, within these bounds. They are the distinct vectors with the smallest hashes, so a bounded sample.
PIVOT_ROWS, FEWEST_PIVOTS, MOST_PIVOTS = 512, 32, 1024
NEEDED_BROADCAST = 100_000
_LARGEST, _END = 2.0**500, 2**63 - 1


def _quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: whole components as the bytes of doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid:
                    continue
                x = np.asarray(v.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float) if len(v) else np.zeros(0)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                vecs.append((np.floor(256 * np.clip(x, -_LARGEST / 256, _LARGEST / 256)) + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"])

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), run, "id long, vec binary")


def _matrix(rows: Iterable[bytes], width: int) -> np.ndarray:
    rows = list(rows)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f8")
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers, held to the range of 64 bits: as doubles or longs where no sum can leave their exact range, else, for the few rows of a block with large components, as integers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    sizes = [np.abs(x).max(axis=1) for x in (a, b)]
    large = [s * sizes[1 - i].max() * a.shape[1] >= 2.0**62 for i, s in enumerate(sizes)]
    if sizes[0].max() * sizes[1].max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.where(np.abs(x) < 2.0**62, x, 0).astype(np.int64) for x in (a, b)]
    out = whole[0] @ whole[1].T
    exact = lambda x, y: np.array([[max(-_END, min(_END, sum(int(p) * int(q) for p, q in zip(r, s, strict=True)))) for s in y] for r in x], np.int64).reshape(len(x), len(y))
    out[large[0]] = exact(a[large[0]].tolist(), b.tolist())
    out[:, large[1]] = exact(a.tolist(), b[large[1]].tolist())
    return out


def _sample(v: DataFrame, n: int, wanted: int) -> list:
    """The `wanted` distinct vectors with the smallest hashes. Only vectors below a threshold of the hash, some times `wanted`, are grouped and sent, so that little comes to the driver whatever the table."""
    share = 4.0 * wanted / n
    while True:
        low = v if share >= 1 else v.where(F.xxhash64("vec") < F.lit(int(-(2.0**63) + share * 2.0**64)))
        found = low.groupBy("vec").agg(F.min("id").alias("id"))
        if share >= 1 or found.count() >= wanted:
            return found.orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
        share *= 8


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on the column id."""
    spark = vectors.sparkSession
    v = table(_quantized(vectors, id_col, vec_col), "knn-vectors")
    stats = v.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("w")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not stats.n:
        return spark.createDataFrame([], empty)
    width = max(1, (stats.w or 0) // 8)
    sample = _sample(v, stats.n, min(MOST_PIVOTS, max(FEWEST_PIVOTS, stats.n // PIVOT_ROWS)))
    pivots = spark.sparkContext.broadcast(_matrix((r.vec for r in sample), width))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        square = (p**2).sum(axis=1)
        for b in batches:
            x = _matrix((r.as_py() for r in b.column("vec")), width)
            if not len(x):
                continue
            own = (x**2).sum(axis=1)
            apart = own[:, None] - 2.0 * (x @ p.T) + square
            cell = apart.argmin(axis=1)
            dist = np.sqrt(np.maximum(apart[np.arange(len(x)), cell], 0) + 1e-10 * (own + square[cell]))  # not below the true distance
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id"), b.column("vec"), pa.array(dist)], names=["cell", "id", "vec", "dist"])

    cells = table(arrow_map(v.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), assign, "cell int, id long, vec binary, dist double"), "knn-cells")
    queries = cells.where(is_query).select("cell", "id", "vec").distinct()
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.count(F.when(is_query, 1)).alias("q")).collect()
    count, radius = np.zeros(len(sample), np.int64), np.zeros(len(sample))
    for r in summary:
        count[r.cell], radius[r.cell] = r.n, r.r
    first, parts = _blocks(_matrix((r.vec for r in sample), width), {r.cell: r.q for r in summary})
    chunks = np.maximum(1, -(-count // CHUNK_ROWS))
    shared = spark.sparkContext.broadcast((count, radius, first, parts))

    def blocked(df: DataFrame) -> DataFrame:
        """With `block`, the number of the query's group."""
        by_cell = [F.array(*[F.lit(int(x)) for x in a]) for a in (first, parts)]
        at = F.col("cell") + 1
        return df.withColumn("block", (F.element_at(by_cell[0], at) + F.pmod(F.xxhash64("id"), F.element_at(by_cell[1], at))).cast("int"))

    def needs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block and cell of each pair that may hold one of a query's k best."""
        p = pivots.value
        count, radius, _, _ = shared.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            q = _matrix((r.as_py() for r in b.column("vec")), width)
            if not len(q):
                continue
            at = q @ p.T
            norm = np.sqrt((q**2).sum(axis=1))[:, None]
            spread = norm * radius
            slack = 1e-9 * (norm * np.sqrt((p**2).sum(axis=1)) + spread) + 1e-6
            reached = np.full(len(q), -np.inf)
            if len(p) > k:
                reached = np.partition(at - slack, len(p) - k - 1, axis=1)[:, len(p) - k - 1]
            low = at - spread - slack
            order = np.argsort(-low, axis=1)
            enough = (np.cumsum(count[order], axis=1) > k).argmax(axis=1)
            bound = np.take_along_axis(low, order, axis=1)[np.arange(len(q)), enough]
            reached = np.minimum(np.maximum(reached, np.where(count.sum() > k, bound, -np.inf)), float(_END))
            reached = np.where(reached < -float(_END), -np.inf, reached)  # scores beyond the range are ties
            i, cell = np.nonzero((at + spread + slack >= reached[:, None]) & (count > 0))
            new = set(zip(np.asarray(b.column("block"))[i].tolist(), cell.tolist(), strict=True)) - seen
            seen |= new
            if new:
                x, y = zip(*sorted(new), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["block", "cell"])

    q = table(blocked(queries), "knn-queries")
    needed = arrow_map(q.select("block", "vec"), needs, "block int, cell int").distinct()
    of_cell = F.element_at(F.array(*[F.lit(int(x)) for x in chunks]), F.col("cell") + 1)
    needed = table(needed.withColumn("chunk", F.explode(F.sequence(F.lit(0), of_cell - 1))), "knn-needed")
    few = needed.count() <= NEEDED_BROADCAST
    needed_by = F.broadcast(needed) if few else needed
    rows = cells.withColumn("chunk", F.pmod(F.xxhash64("id"), of_cell).cast("int")).join(needed_by, ["cell", "chunk"]).select("block", "cell", "chunk", F.lit(1).alias("side"), "id", "vec")
    asked = needed_by.join(q.drop("cell"), "block") if not few else q.drop("cell").join(needed_by, "block")
    both = rows.unionByName(asked.select("block", "cell", "chunk", F.lit(0).alias("side"), "id", "vec"))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def best() -> Iterator[pa.RecordBatch]:
            if not sides[0] or not sides[1]:
                return
            q = _matrix((x[1] for x in sides[0]), width)
            ids = np.array([x[0] for x in sides[1]])
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            score = products(q, _matrix((x[1] for x in sides[1]), width)[order])
            q_ids = np.array([x[0] for x in sides[0]])
            own = q_ids[:, None] == ids[None, :]
            ranked = np.where(own, np.iinfo(np.int64).min, score)
            most = min(k, len(ids))
            if most < len(ids):  # of equal scores at the limit, the first are those with the smaller ids
                limit = np.partition(ranked, len(ids) - most, axis=1)[:, len(ids) - most]
                above = ranked > limit[:, None]
                at = ranked == limit[:, None]
                chosen = above | at & (np.cumsum(at, axis=1) <= (most - above.sum(axis=1))[:, None])
            else:
                chosen = np.ones_like(own)
            i, j = np.nonzero(chosen & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array([sides[0][n][1] for n in i.tolist()], pa.binary()), pa.array(ids[j]), pa.array(score[i, j])], names=["query_id", "q", "vec_id", "score"])

        for b in batches:
            for *at, side, i, vec in zip(*(b.column(c).to_pylist() for c in ("block", "cell", "chunk", "side", "id", "vec")), strict=True):
                if at != key:
                    yield from best()
                    key, sides = at, ([], [])
                sides[side].append((i, vec))
        yield from best()

    by = ["block", "cell", "chunk"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = arrow_map(both.repartition(tasks, *by).sortWithinPartitions(*by), solve, "query_id long, q binary, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(pivots: np.ndarray, queries: dict[int, int]) -> tuple[list[int], list[int]]:
    """For each cell its first block and the number of its blocks: neighbouring cells share a block up to QUERY_ROWS queries, larger ones have several."""
    first, parts = [0] * len(pivots), [1] * len(pivots)
    left, block, size = set(range(len(pivots))), 0, 0
    here = 0
    while left:  # from each pivot to the nearest one that is left
        left.discard(here)
        n = queries.get(here, 0)
        if size and size + n > QUERY_ROWS:
            block, size = block + 1, 0
        first[here], parts[here] = block, max(1, -(-n // QUERY_ROWS))
        block += parts[here] - 1
        size = size + n if parts[here] == 1 else QUERY_ROWS
        if left:
            rest = np.array(sorted(left))
            here = int(rest[((pivots[rest] - pivots[here]) ** 2).sum(axis=1).argmin()])
    return first, parts


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the five best of every vector whose id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = r"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""
