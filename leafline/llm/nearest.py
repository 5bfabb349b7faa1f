"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised once, x = s q + e with int8 q, and kept with s and the norms of x, s q and e.
The product of two vectors differs from s s' q.q' by at most |e'| |x| + |e| |s' q'|. Only codes and
norms are dealt over the grid: a tile multiplies a block of queries by a block of candidates and
passes on each pair whose upper bound reaches the query's k-th best lower bound in the tile. The
k-th best lower bound over all tiles cuts again. Surviving pairs fetch the original vectors, are
recomputed in double precision, and each query's are merged by a heap of k. No pair is lost to
quantisation, so recall is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged

#: Rows of a block, so that a tile has a bounded size whatever the table's.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
#: Queries multiplied at a time within a tile.
STRIP = 128
#: Components whose products add up below 2**24, so that they are exact in float32.
EXACT = 1024


def usable(v: Column) -> Column:
    """Vectors that take part: no null or non-finite component, and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x):
    """int8 codes, scales, and the norms of the error, the coded part and the vector, rounded up."""
    import numpy as np

    most = np.abs(x).max(axis=1, keepdims=True)
    scale = np.maximum(most / 127, np.finfo(float).tiny)
    q = np.clip(np.rint(x / scale), -127, 127)
    part, slack = scale * q, 1 + 1e-6  # for rounding in these norms and in the bounds
    norm = lambda y: most[:, 0] * np.sqrt(((y / most) ** 2).sum(axis=1)) * slack  # noqa: E731  scaled: no overflow
    return q.astype(np.int8), scale[:, 0], norm(x - part), norm(part), norm(x)


def products(a, b):
    """Inner products of int8 rows, exactly."""
    import numpy as np

    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def exact(a, b):
    """Inner products of rows, summed in order of the components, so equal vectors score equally."""
    import numpy as np

    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile(queries: tuple, rows: tuple, k: int):
    """(query's row, candidate's row, lower bound, upper bound) of a tile's pairs that may be among a query's k best.

    Each side: (ids, rows, codes, scales, norms of the error, of the coded part, of the vector).
    """
    import numpy as np

    out = []
    for at in range(0, len(queries[0]), STRIP):
        ids, at_row, q, s, e, _, n = (x[at : at + STRIP] for x in queries)
        dots = products(q, rows[2]) * s[:, None] * rows[3][None, :]
        bound = n[:, None] * rows[4][None, :] + e[:, None] * rows[5][None, :] + 1e-12
        low, up, other = dots - bound, dots + bound, ids[:, None] != rows[0][None, :]
        low[~other | np.isnan(low)] = -np.inf  # an overflow proves nothing
        up[np.isnan(up)] = np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(ids), -np.inf)
        i, j = np.nonzero((up >= kth[:, None]) & other)
        out.append((at_row[i], rows[1][j], low[i, j], up[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; every other row is a candidate.

    Defined cases: vectors that are null, zero or hold null or non-finite components, and rows of
    null id, take no part; a query meets only vectors of its own length; ties go to the smaller
    id; with repeated ids each row is a candidate, one of them is the query, and a query leaves out
    rows of its own id; other columns are not read; an empty table gives no rows.
    """

    def code(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sizes = b.column(3).to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
                q, *rest = quantised(x)
                cols = [*part.columns[:2], part.column(3), pa.array([r.tobytes() for r in q], pa.binary()), *(pa.array(y) for y in rest)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "d", "q", "s", "e", "p", "n"])
        released()

    def cell(a, b):
        import numpy as np
        import pyarrow as pa

        def side(t):
            q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(t.num_rows, -1)
            return t.column("id").to_numpy(), t.column("row").to_numpy(), q, *(t.column(c).to_numpy() for c in ("s", "e", "p", "n"))

        got = tile(side(a), side(b), k) if a.num_rows and b.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        return pa.table(dict(zip(("query", "row", "low", "up"), map(pa.array, got))))

    def recompute(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sizes = b.column(4).to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                x, y = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d)) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(exact(x, y))], names=["query_id", "vec_id", "score"])
        released()

    def merge(batches):
        """Rows by query: each one's k best, from a heap that holds no more."""
        import heapq

        import pyarrow as pa

        def best(query, heap):
            top = sorted(heap, reverse=True)
            return [(query, r, -i, s) for r, (s, i) in enumerate(top, 1)]

        query, heap, out = None, [], []
        for b in batches:
            for q, i, s in zip(*(c.to_pylist() for c in b.columns)):
                if q != query:
                    out += best(query, heap)
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                else:
                    heapq.heappushpop(heap, (s, -i))
            if len(out) > 10_000:
                yield table(out)
                out = []
        yield table(out + best(query, heap))

    def table(rows):
        import pyarrow as pa

        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = staged(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v")))
    coded = staged(rows.select("row", "id", "v", "d").mapInArrow(code, "row long, id long, d int, q binary, s double, e double, p double, n double"))
    asks = coded.where(F.col("id") % every == 0)
    queries = staged(asks.join(asks.groupBy("id").agg(F.min("row").alias("row")).select("row"), "row", "left_semi"))
    n_rows, n_queries = coded.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    part = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id", "row"), F.lit(n)).cast("int")
    # A cell of the grid is one tile: both sides are dealt to it, blocks are of bounded expected size.
    left = queries.withColumn("qb", part("q", query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = coded.withColumn("rb", part("r", row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["qb", "rb", "d"]
    pairs = staged(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query long, row long, low double, up double"))

    # The k-th best lower bound of a query over all tiles; ranks beyond k go before the shuffle.
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).where(F.col("r") <= k)
    kth = ranked.where(F.col("r") == k).select("query", F.col("low").alias("least"))
    alive = pairs.join(kth, "query", "left").where(F.col("least").isNull() | (F.col("up") >= F.col("least"))).select("query", "row")
    asked = alive.join(rows.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("x")), "query")
    wide = asked.join(rows.select("row", F.col("id").alias("vec_id"), F.col("v").alias("y")), "row")
    scored = wide.select("query_id", "vec_id", "x", "y", F.size("x").alias("d")).mapInArrow(recompute, "query_id long, vec_id long, score double")
    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

