"""Near texts by SimHash: fingerprints propose families, shingle sets decide inside them.

At a similarity of 0.8 two fingerprints of 128 bits differ by 19 +- 4 bits and
unrelated ones by 64 +- 6: the radius that loses no pair is so wide that the
upper vantage-point tree, which deals fingerprints to shards by distance, would
prune nothing, and bits alone can't decide 0.8. So the shards are made by
shingles: the prefixes of two near sets share one (see ``prefixes``). In a
shard vantage-point trees link fingerprints within the radius; linked classes
make a family, and in a family pairs are decided by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .blobs import unpacked
from .components import Forest, star_components
from .repeats import reference_blocks, rows_of
from .shared import discard, renamed, written
from .simhash import distances, link, majority_bits, shingle_spans

#: Lanes of 64 bits of a fingerprint, and bits by which near texts' fingerprints differ at most: six standard deviations above the mean at 0.8.
LANES, MOST_BITS = 2, 44
#: Documents, taken by hash, whose shingles are counted, and common shingles kept at most: both only order the shingles.
SAMPLE, COMMON = 20_000, 200_000
#: Members of a shard or a family that one group holds, about; more are split into pairs of parts.
GROUP = 1024


# -- sets --------------------------------------------------------------------


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, sorted within it, and the text of each."""
    joined, begin, end, shingles = shingle_spans(data, offsets, words)
    owner = np.repeat(np.arange(len(shingles)), shingles)
    hashes = spans.hash_spans(joined, begin, end)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[new], owner[new]


def prefixes(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray, rare: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(n p / q) + 1 shingles of each set in the order of ``rare`` and hash, and their owners.

    Sets whose similarity is p / q or more share at least ceil(n p / q)
    shingles of either, so that one is in both prefixes, whatever the order.
    """
    p, q = share
    order = np.lexsort((hashes, rare, owner))
    nth = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    first = nth < (size - (size * p + q - 1) // q + 1)[owner]
    return hashes[order[first]], owner[first]


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sets of distinct values have the similarity or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * share[1] >= (len(a) + len(b) - both) * share[0]


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of common shingles in a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.bytes_of(batch.column(0))
            for i, j in spans.slices(offsets):
                values, n = np.unique(sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0).select("text")
    found = sample.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    hashes, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _classes(blocks: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, id_type: T.DataType, words: int, share: tuple[int, int]) -> DataFrame:
    """A row per distinct set: its least row, size, fingerprint and prefix. A row is known by its block and place in it."""
    shared = blocks.sparkSession.sparkContext.broadcast(common)
    names = ["id", "block", "row", "set0", "set1", "size", "print", "prefix"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = rows_of(payload)
                n = len(rows)
                hashes, owner = sets_of(*spans.bytes_of(rows[text_col]), words)
                size = np.bincount(owner, minlength=n)
                rare = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rare = np.where(known[at] == hashes, counts[at], 0)
                sums = np.zeros((2, n), np.uint64)
                for lane in (0, 1):
                    np.add.at(sums[lane], owner, spans.mix(hashes + np.uint64(7 + 4 * lane)))
                prints = np.zeros((n, LANES), np.uint64)
                lane_hashes = hashes
                for lane in range(LANES):
                    prints[:, lane] = majority_bits(lane_hashes, size)
                    lane_hashes = spans.mix(lane_hashes + np.uint64(lane + 1))
                columns = [
                    rows[id_col].combine_chunks(), pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.array(size), pa.array([x.tobytes() for x in prints], pa.binary()), _lists(*prefixes(hashes, owner, size, rare, share), n),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [id_type, *(T.LongType(),) * 5, T.BinaryType(), T.ArrayType(T.LongType())]
    rows = blocks.select("block", "payload").mapInArrow(emit, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "block", "row")).alias("least")
    held = rows.groupBy("set0", "set1", "size").agg(least, F.first("print").alias("print"), F.first("prefix").alias("prefix"))
    return written(held.select(F.xxhash64("least.block", "least.row").alias("hash"), F.struct("least.block", "least.row").alias("node"), "least", "size", "print", "prefix"), "classes")


# -- families ------------------------------------------------------------------


def _parted(rows: DataFrame, key: str, held: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``group``: all of a small key in one, of a large one in a group for each pair of parts; ``held`` has key and count."""
    parts = held.select(key, F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = rows.join(parts, key).withColumn("own", own).select("*", every)
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumn("group", F.when(F.col("parts") == 1, F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(pair)).withColumn("unit", F.when(F.col("parts") == 1, F.xxhash64(key)).otherwise(pair)).drop("parts", "own", "other")


def _near_prints(unit: np.ndarray, node: np.ndarray, prints: np.ndarray, forest: Forest) -> None:
    """Unite the nodes (numbers) whose fingerprints are within the radius and that share a unit."""
    order = np.argsort(unit, kind="stable")
    unit, node, prints = unit[order], node[order], prints[order]
    bounds = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
    size = np.diff(bounds)
    small = np.repeat(size <= 32, size)
    for step in range(1, 32):
        a = np.flatnonzero(small[:-step] & (unit[:-step] == unit[step:]))
        if not len(a):
            break
        a = a[distances(prints[a], prints[a + step]) <= MOST_BITS]
        forest.union(node[a], node[a + step])
    for k in np.flatnonzero(size > 32).tolist():
        mine = slice(bounds[k], bounds[k + 1])
        local = Forest(int(size[k]))
        link(local, prints[mine], np.arange(size[k]), np.arange(size[k]), MOST_BITS)
        a, b = local.edges()
        forest.union(node[mine][a], node[mine][b])


def _numbers(block: pa.ChunkedArray, row: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, row), and the number among them of each row."""
    both = np.stack([block.to_numpy(), row.to_numpy()], axis=1)
    return np.unique(both, axis=0, return_inverse=True)


def _edges(nodes: np.ndarray, forest: Forest) -> pa.Table:
    a, b = forest.edges()
    struct = lambda x: pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["block", "row"])
    return pa.table({"a": struct(nodes[a]), "b": struct(nodes[b])})


_EDGE = "a struct<block: long, row: long>, b struct<block: long, row: long>"


def _families(classes: DataFrame, buckets: int) -> DataFrame:
    """``node`` and ``component`` of the classes that near fingerprints connect within shards."""
    entries = classes.select("node", F.explode("prefix").alias("shingle"))
    recurring = written(entries.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "recurring")
    shards = _parted(entries, "shingle", recurring, buckets).join(classes.select("node", "print"), "node")

    def meet(table: pa.Table) -> pa.Table:
        nodes, number = _numbers(table["block"], table["row"])
        forest = Forest(len(nodes))
        _near_prints(table["unit"].to_numpy(), number, unpacked(table["print"], np.uint64).reshape(-1, LANES), forest)
        return _edges(nodes, forest)

    edges = shards.select("group", "unit", "node.block", "node.row", "print").groupBy("group").applyInArrow(meet, _EDGE)
    found = star_components(edges)
    discard(recurring)
    return found


def _groups(blocks: DataFrame, classes: DataFrame, text_col: str, words: int, share: tuple[int, int], buckets: int) -> DataFrame:
    """``node`` and ``component`` of the classes that similar sets connect."""
    families = written(_families(classes, buckets), "families")
    members = families.join(classes.select("node", "size", "print"), "node").select("node", "node.block", "node.row", "component", "size", "print")

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for payload in left["payload"] if len(right) else ():
            rows = rows_of(payload)
            place = right["row"].to_numpy()
            texts = rows[text_col].combine_chunks().take(pa.array(place))
            hashes, owner = sets_of(*spans.bytes_of(texts), words)
            bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(place)))].tolist()
            raw = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            parts.append(right.append_column("set", raw))
        return pa.concat_tables(parts) if parts else right.append_column("set", pa.nulls(len(right), pa.binary())).slice(0, 0)

    kinds = T.StructType([*members.schema.fields, T.StructField("set", T.BinaryType())])
    sets = blocks.select("block", "payload").groupBy("block").cogroup(members.groupBy("block")).applyInArrow(emit, kinds)
    sizes = families.groupBy("component").agg(F.count("*").alias("n"))

    def decide(table: pa.Table) -> pa.Table:
        nodes, number = _numbers(table["block"], table["row"])
        prints, size = unpacked(table["print"], np.uint64).reshape(-1, LANES), table["size"].to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        forest = Forest(len(nodes))
        for _, at in spans.groups_of(table["unit"].to_numpy()):
            for k, x in enumerate(at[:-1].tolist()):
                others = at[k + 1 :]
                close = (np.minimum(size[others], size[x]) * share[1] >= np.maximum(size[others], size[x]) * share[0]) & (distances(prints[others], prints[x]) <= MOST_BITS)
                others = others[close]
                others = others[forest.roots(number[others]) != forest.roots(number[[x]])]
                near = np.array([y for y in others.tolist() if similar(held[x], held[y], share)], np.int64)
                forest.union(np.full(len(near), number[x]), number[near])
        return _edges(nodes, forest)

    edges = _parted(sets, "component", sizes, buckets).select("group", "unit", "block", "row", "size", "print", "set").groupBy("group").applyInArrow(decide, _EDGE)
    return star_components(edges)


def one_of_each(docs: DataFrame, words: int, share: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near texts, the one with the smallest id; all its columns.

    Two texts are near if the Jaccard similarity of their sets of shingles of
    ``words`` words is p / q or more, for ``share`` (p, q); groups are what
    chains of near texts connect. A pair is linked only after its two sets were
    compared, and lost only if fingerprints of similar sets differ by more than
    ``MOST_BITS``, six standard deviations from what is expected.

    A-Z are lower-cased, words are runs of bytes other than white space, and a
    text with fewer words is one shingle. Null and empty texts are near each
    other. Null ids come after all others; of rows that repeat an id and a
    text one stays. Other columns, whatever their names, come out as they were.
    A very long text is held whole in one task. An empty table gives an empty
    one.
    """
    plain = docs
    docs, own = renamed(docs)
    id_col, text_col = own[id_col], own[text_col]
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = reference_blocks(docs, text_col)
    common = _common(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words)
    classes = _classes(blocks, common, id_col, text_col, docs.schema[id_col].dataType, words, share)
    found = _groups(blocks, classes, text_col, words, share, buckets)
    named = classes.select("node", "least").join(found, "node", "left").select("least", F.coalesce("component", "node").alias("component"))
    kept = named.groupBy("component").agg(F.min("least").alias("k")).select("k.block", "k.row")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        place = pa.array(np.sort(right["row"].to_numpy()))
        parts = [rows_of(payload).take(place) for payload in left["payload"]]
        return pa.concat_tables(parts)

    out = blocks.select("block", "payload").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(finish, docs.schema)
    return out.toDF(*plain.columns)
