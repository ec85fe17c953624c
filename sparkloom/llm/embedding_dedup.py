"""Embedding near-dedup: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import packed, unpacked
from .components import Forest, star_components
from .shared import sampled, written
from .spans import mix
from .vectors import matrix, numbered_vectors, units

COSINE = 0.95
#: Vectors in a cell, about; larger cells are dealt to blocks.
CELL = 8192
#: Cells of the first level, cells within one of these, and cells in all, at most.
COARSE, FINE, CELLS = 256, 256, 4096
#: Vectors that the centres are fitted on for each cell, vectors at least, and their bytes at most; all vectors are assigned.
FITTED, SAMPLE, SAMPLE_BYTES = 32, 8192, 32 << 20
#: Vectors on either side of one block of products, about: the fewer blocks, the fewer copies of a vector.
BLOCK = 16_384
#: What a row is in a block: a member of the cell by a copy, a vector that asks the members, one of the cell's own.
_MEMBER, _ASKS, _OWN = 1, 2, 4


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres: far points first, then means of the vectors nearest by cosine, put back on the sphere."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres, near = [sample[0]], sample @ sample[0]
    for _ in range(k - 1):
        centres.append(sample[np.argmin(near)])
        near = np.maximum(near, sample @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        cell = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """The centres of the first level and, for each, of the cells within its own; each with their distances from each other."""

    coarse: tuple[np.ndarray, np.ndarray]
    fine: list[tuple[np.ndarray, np.ndarray]]

    def __len__(self) -> int:
        return sum(len(centres) for centres, _ in self.fine)


def fit_cells(sample: np.ndarray, cells: int) -> Cells:
    """About ``cells`` cells in two levels; a cell of the first has as many within it as its part of the sample asks for."""
    apart = lambda centres: np.array([np.linalg.norm(centres - x, axis=1) for x in centres])
    coarse = spherical_kmeans(sample, max(1, min(COARSE, cells, len(sample))))
    home, fine = np.argmax(sample @ coarse.T, axis=1), []
    for k in range(len(coarse)):
        mine = sample[home == k]
        n = min(FINE, cells * len(mine) // max(len(sample), 1), len(mine))
        fine.append(spherical_kmeans(mine, n) if n > 1 else coarse[k : k + 1])
    return Cells((coarse, apart(coarse)), [(x, apart(x)) for x in fine])


def cells_of(vectors: np.ndarray, cells: Cells, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): each vector's cell and the later cells that a vector within the angle may belong to.

    If y is nearer to centre j than to x's centre h, the plane between the two
    lies between x and y, so the sine of their angle is at least x's distance
    from it. Of two cells the earlier one's vectors visit the later's. This
    holds among the centres of the first level, and again among those within
    one of its cells, also for an x that comes from another.
    """
    sine = np.sqrt(1 - cosine * cosine)

    def reached(vectors: np.ndarray, centres: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = vectors @ centres.T
        home = np.argmax(dots, axis=1)
        return dots[np.arange(len(home)), home][:, None] - dots <= sine * apart[home] + 1e-9, home

    near, home = reached(vectors, *cells.coarse)
    near &= np.arange(near.shape[1]) >= home[:, None]
    rows, places, owns, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
    for k, fine in enumerate(cells.fine):
        at = np.flatnonzero(near[:, k])
        inside, nearest = reached(vectors[at], *fine)
        own = home[at] == k
        inside &= ~own[:, None] | (np.arange(inside.shape[1]) >= nearest[:, None])
        row, place = np.nonzero(inside)
        rows.append(at[row])
        places.append(first + place)
        owns.append(own[row] & (place == nearest[row]))
        first += len(fine[0])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(owns)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors`` its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors whose cosine, in doubles, is at least ``cosine`` are linked. Cells
    of spherical k-means, in two levels, share out the work and lose no link,
    as vectors near a cell's edge visit the cells beyond it. A cell's members and visitors are
    dealt to blocks by a hash, so that a cell with a third of all rows becomes
    many block products; these return counts and spanning forests, not pairs.
    Rows travel as packed matrices, one for each batch and block.

    Null, zero and non-finite vectors have no links and are their own
    component; shorter vectors end in zeros. Rows that repeat an id are
    vectors of their own. A component without any id has none, and rows
    without an id aren't kept. Other columns, whatever their names, are left
    out. An empty table gives an empty one.
    """
    rows, size, dtype = numbered_vectors(vectors, id_col, vector_col)
    usable = rows.where("valid").select("uid", "vector")
    n = usable.count()
    cells = max(1, min(CELLS, n // CELL))
    most = max(1, min(max(SAMPLE, FITTED * cells), SAMPLE_BYTES // (size * dtype().itemsize)))
    taken = sampled(usable, F.xxhash64("uid"), n, most).select("vector").collect()
    sample = units(matrix(pa.array([x[0] for x in taken], pa.binary()), size, dtype))
    sample = sample[sample.any(axis=1)]
    centres = fit_cells(sample, cells)

    def placed(batch: pa.RecordBatch):
        unit = units(matrix(batch.column(1), size, dtype))
        some = np.flatnonzero(unit.any(axis=1))
        row, cell, own = cells_of(unit[some], centres, cosine)
        return some[row], cell, own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cell, own = placed(batch)
            held = [np.bincount(x, minlength=len(centres)) for x in (cell[own], cell)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), *map(pa.array, held)], names=["cell", "members", "entries"])

    parts = np.ones((len(centres), 2), np.int64)
    for cell, members, entries in usable.mapInArrow(count, "cell long, members long, entries long").groupBy("cell").agg(F.sum("members"), F.sum("entries")).collect():  # a row per cell
        parts[cell] = max(1, -(-members // BLOCK)), max(1, -(-entries // BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, own = placed(batch)
            uid = batch.column(0).to_numpy()
            salt = mix(uid.view(np.uint64) + np.uint64(3))[row]
            i, j = parts[cell].T
            mine_i, mine_j = (salt % i.astype(np.uint64)).astype(np.int64), ((salt >> np.uint64(32)) % j.astype(np.uint64)).astype(np.int64)
            alone = (i == 1) & (j == 1)
            holds = np.flatnonzero(own & ~alone)
            asked, held = np.repeat(np.arange(len(row)), i), np.repeat(holds, j[holds])
            group = np.r_[
                cell[asked] << 40 | (np.arange(len(asked)) - np.repeat(np.cumsum(i) - i, i)) << 20 | mine_j[asked],
                cell[held] << 40 | mine_i[held] << 20 | (np.arange(len(held)) - np.repeat(np.cumsum(j[holds]) - j[holds], j[holds])),
            ]
            role = np.r_[_ASKS + own[asked] * _OWN + (own & alone)[asked] * _MEMBER, np.full(len(held), _MEMBER + _OWN)].astype(np.uint8)
            at = row[np.r_[asked, held]]
            vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype).reshape(-1, size)
            out = packed(group, uids=uid[at], roles=role, vectors=vectors[at])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=["group", "uids", "roles", "vectors"])

    def compare(table: pa.Table) -> pa.Table:
        uid, role = unpacked(table["uids"], np.int64), unpacked(table["roles"], np.uint8)
        all_ = units(unpacked(table["vectors"], dtype).astype(np.float64).reshape(-1, size))
        mine, asking, own = np.flatnonzero(role & _MEMBER), np.flatnonzero(role & _ASKS), role & _OWN > 0
        links, forest = np.zeros(len(uid), np.int64), Forest(len(uid))
        members = all_[mine].T.copy()
        for k in range(0, len(asking), 256):
            some = asking[k : k + 256]
            a, b = np.nonzero(all_[some] @ members >= cosine)
            a, b = some[a], mine[b]
            apart = uid[a] != uid[b]
            a, b = a[apart], b[apart]
            np.add.at(links, b, 1)
            np.add.at(links, a[~own[a]], 1)  # two members meet twice, a visitor once
            forest.union(a, b)
        a, b = forest.edges()
        held = np.flatnonzero(links)
        return pa.table({
            "uid": np.r_[uid[held], uid[a]], "other": pa.array(np.r_[uid[held], uid[b]]), "links": np.r_[links[held], np.zeros(len(a), np.int64)],
        })

    routed = usable.mapInArrow(route, "group long, uids binary, roles binary, vectors binary")
    found = written(routed.groupBy("group").applyInArrow(compare, "uid long, other long, links long"), "links")
    # a vector may stand twice in a group, as member and as entry: its two places are one node
    component = star_components(found.where("uid <> other").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("uid").agg(F.sum("links").alias("n"))
    joined = rows.select("uid", "id").join(counts, "uid", "left").join(component.withColumnRenamed("node", "uid"), "uid", "left")
    joined = written(joined.select("uid", "id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "uid").alias("component")), "members")
    least = written(joined.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    return joined.join(least, "component").select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE links.a = components.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM components
"""
