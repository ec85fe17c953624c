"""Exact top-k search: norm-sorted inner products with rotated partial sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sampled, written
from .vectors import matrix, numbered_vectors

TOP, EVERY, SCALE = 20, 20, 64
#: Candidates and queries of one group, about, and bands of length that candidates are dealt to.
CANDIDATES, QUERIES, BANDS = 8192, 2048, 16
#: Vectors that the rotation is fitted on at most; it is exact for all.
SAMPLE = 4096
#: Candidates met at once, and numbers of rotated components after which partial sums are bounded.
STEP, STAGES = 512, (16, 32, 48)


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthonormal basis that puts most of the vectors' length into the first components."""
    return np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


def search(queries: np.ndarray, query_id: np.ndarray, rows: np.ndarray, row_id: np.ndarray, row_name: np.ndarray, basis: np.ndarray, top: int, floor: np.ndarray | None = None):
    """(query number, row number, score) of each query's ``top`` best rows other than itself, ties to the smaller name, and the number of pairs scored.

    Rows come by descending length. A query is done once its length times the
    next row's is less than its worst kept score, or than ``floor``, a score
    that its result is known to reach; before that, after each of ``STAGES``
    rotated components, a row is skipped if their inner product, plus the
    product of both rests' lengths, which bounds the rest by Cauchy and
    Schwarz, is less.
    """
    length = np.linalg.norm(rows, axis=1)
    order = np.lexsort((row_name, -length))
    rows, row_id, row_name, length = rows[order], row_id[order], row_name[order], length[order]
    own = np.linalg.norm(queries, axis=1)
    q, c = queries @ basis, rows @ basis
    stages = [s for s in STAGES if s < q.shape[1]]
    q_rest, c_rest = ([np.linalg.norm(x[:, s:], axis=1) for s in stages] for x in (q, c))
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    worst, scored = np.full(len(queries), -np.inf) if floor is None else floor.astype(float), 0
    for k in range(0, len(rows), STEP):
        some = np.arange(k, min(k + STEP, len(rows)))
        slack = 1e-9 * (1 + own * length[k])
        active = np.flatnonzero(own * length[k] + slack >= worst)
        if not len(active):
            break
        n = len(active) * len(some)
        partial, before, pairs = np.zeros((len(active), len(some))), 0, None
        for nth, s in enumerate(stages):
            mine, theirs, rests = q[active, before:s], c[some, before:s], (q_rest[nth][active], c_rest[nth][some])
            least = worst[active] - slack[active]
            if pairs is None:  # most are left: whole blocks
                partial += mine @ theirs.T
                stays = partial + rests[0][:, None] * rests[1] >= least[:, None]
                if np.count_nonzero(stays) * 4 <= n:
                    pairs = np.nonzero(stays)
                    partial = partial[pairs]
            else:
                a, b = pairs
                partial = partial + np.einsum("ij,ij->i", mine[a], theirs[b])
                stays = partial + rests[0][a] * rests[1][b] >= least[a]
                pairs, partial = (a[stays], b[stays]), partial[stays]
            before = s
        if pairs is None:
            a, b = np.nonzero(stays) if stages else (x.ravel() for x in np.indices((len(active), len(some))))
            score = (queries[active] @ rows[some].T)[a, b]
        else:
            a, b = pairs
            score = np.einsum("ij,ij->i", queries[active[a]], rows[some[b]])
        other = query_id[active[a]] != row_id[some[b]]
        a, b, score = a[other], b[other], score[other]
        scored += len(a)
        a, b = active[a], some[b]
        enough = score >= worst[a]
        at, row, score = (np.r_[x, y[enough]] for x, y in zip(kept, (a, b, score), strict=True))
        sort = np.lexsort((row_name[row], -score, at))
        at, row, score = at[sort], row[sort], score[sort]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(at)])
        rank = np.arange(len(at)) - np.repeat(begin, size)
        full = size >= top
        worst[at[begin[full]]] = np.maximum(worst[at[begin[full]]], score[begin[full] + top - 1])
        stays = rank < top
        kept = at[stays], row[stays], score[stays]
    return kept[0], order[kept[1]], kept[2], scored


def top_inner_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``top`` best rows of each row whose id is divisible by ``every``.

    Components become floor(64 x) and the score is their integer inner
    product, computed in doubles, which is exact while sums stay below 2^53;
    ties go to the smaller id. Candidates are dealt to bands of descending
    length and, by a hash, to groups within a band, so that neither a band nor
    vectors of equal length meet in one task. First every query meets one group
    of the longest band; the worst score of that result is a floor that its
    final result reaches. With it, a query visits only the groups of bands whose
    greatest length times its own reaches the floor, and groups return only
    what reaches it. The groups' lists, ``top`` rows each, are merged.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; zero vectors and repeated ids do, a query
    skipping only its own row. Shorter vectors end in zeros. Other columns,
    whatever their names, are left out. An empty table gives an empty one.
    """
    rows, size, dtype = numbered_vectors(vectors, id_col, vector_col)
    usable = rows.where("valid AND id IS NOT NULL").select("uid", "id", "vector", F.lit(float(SCALE)).alias("scale"))
    spark = vectors.sparkSession

    def measure(batches):
        for batch in batches:
            held = np.floor(SCALE * matrix(batch.column(2), size, dtype))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.linalg.norm(held, axis=1))], names=["uid", "id", "vector", "length"])

    usable = written(usable.select("uid", "id", "vector").mapInArrow(measure, "uid long, id long, vector binary, length double"), "lengths")
    n, asking = usable.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    bands = max(1, min(BANDS, n // CANDIDATES))
    edges = (usable.agg(F.percentile_approx("length", [k / bands for k in range(1, bands)], 10_000)).first()[0] or []) if bands > 1 else []
    band = sum((F.when(F.col("length") >= x, 0).otherwise(1) for x in edges), F.lit(0)).alias("band")  # band 0 is the longest
    banded = usable.select("*", band)
    sizes = {b: (max(1, -(-m // CANDIDATES)), x) for b, m, x in banded.groupBy("band").agg(F.count("*"), F.max("length")).collect()}  # a row per band
    askers = max(1, -(-asking // QUERIES))
    sample = np.floor(SCALE * matrix(pa.array([x[0] for x in sampled(usable, F.xxhash64("uid"), n, SAMPLE).select("vector").collect()], pa.binary()), size, dtype))
    basis = spark.sparkContext.broadcast(rotation(sample))
    salt = F.xxhash64("uid", F.lit(5))
    groups = F.coalesce(F.get(F.array(*(F.lit(sizes.get(b, (1, 0.0))[0]) for b in range(bands))), F.col("band")), F.lit(1))
    candidates = written(banded.select("band", F.pmod(salt, groups).cast("int").alias("g"), "uid", "id", "vector"), "candidates")
    queries = usable.where(F.col("id") % every == 0).select(F.pmod(salt, F.lit(askers)).cast("int").alias("a"), "uid", "id", "vector", "length")

    def meet(table: pa.Table) -> pa.Table:
        asks, uid, name = table["asks"].to_numpy(), table["uid"].to_numpy(), table["id"].to_numpy()
        held = np.floor(SCALE * matrix(table["vector"], size, dtype))
        a, b, score, _ = search(held[asks], uid[asks], held[~asks], uid[~asks], name[~asks], basis.value, top, table["floor"].to_numpy()[asks])
        return pa.table({"query": uid[asks][a], "query_id": name[asks][a], "vec_id": name[~asks][b], "score": score.astype(np.int64)})

    def met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """``queries`` (band, g, a, uid, id, vector, floor) against the candidates of their bands and groups."""
        holds = candidates.select("band", "g", F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("a"), "uid", "id", F.lit(False).alias("asks"), F.lit(0.0).alias("floor"), "vector")
        asks = queries.select("band", "g", "a", "uid", "id", F.lit(True).alias("asks"), "floor", "vector")
        return holds.union(asks).groupBy("band", "g", "a").applyInArrow(meet, "query long, query_id long, vec_id long, score long")

    longest = min(sizes, default=0)
    none = F.lit(float("-inf"))
    first = met(candidates.where((F.col("band") == longest) & (F.col("g") == 0)), queries.select(F.lit(longest).alias("band"), F.lit(0).alias("g"), "a", "uid", "id", "vector", none.alias("floor")))
    floors = written(first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst")).where(F.col("n") >= top).select(F.col("query").alias("uid"), "worst"), "floors")
    reached = queries.join(floors, "uid", "left").select("a", "uid", "id", "vector", "length", F.coalesce("worst", none).alias("floor"))
    held = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(m).alias("parts"), F.lit(x).alias("most")) for b, (m, x) in sorted(sizes.items()))) if sizes else F.array(F.struct(F.lit(0).alias("band"), F.lit(1).alias("parts"), F.lit(0.0).alias("most")))
    visits = reached.select("*", F.explode(held).alias("x")).where(F.col("length") * F.col("x.most") * (1 + 1e-9) + 1e-9 >= F.col("floor"))
    visits = visits.select(F.col("x.band").alias("band"), F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("g"), "a", "uid", "id", "vector", "floor")
    found = met(candidates, visits)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q, usable c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
