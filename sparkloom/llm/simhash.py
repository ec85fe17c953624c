"""SimHash near-dedup: fingerprints linked exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .blobs import packed, unpacked
from .components import Forest, star_components
from .shared import sampled, written

WORDS, MOST_BITS, SEED = 4, 4, 42
#: Fingerprints, taken by hash, that the upper tree is built from at most.
SAMPLE = 8192
#: Fingerprints that a shard is to own, about, and levels of the upper tree at most; what is more is dealt to parts.
SHARD, LEVELS = 4096, 11
#: A shard's members, and members with visitors, that one group holds, about.
MEMBERS, ENTRIES = 16_384, 262_144
#: Distances computed at once.
TILE = 1 << 18


# -- fingerprints ----------------------------------------------------------


def shingle_spans(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one space, start and end in them of every shingle, and each text's number of shingles."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data = np.where(upper, data + 0x20, data).astype(np.uint8)
    begin, end, text = spans.split(data, offsets)
    texts, n = len(offsets) - 1, len(begin)
    if not n:
        none = np.zeros(0, np.int64)
        return data[:0], none, none, np.zeros(texts, np.int64)
    sizes = end - begin
    to = np.cumsum(sizes + 1) - 1  # ends in the words joined by one space
    at = to - sizes
    joined = np.full(int(to[-1]) + 1, 0x20, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = data[np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))]
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(texts), shingles)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(start + words, (first + count)[owner]) - 1
    return joined, at[start], to[last], shingles


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text, which owns the next ``count`` hashes, the 64 bits that are set in over half of them."""
    texts, out = len(count), np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    if len(hashes) < 64 * texts:  # short texts: bits are added one by one
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
    else:  # long ones: by how often each byte has each value
        owner = np.repeat(np.arange(len(some)) * 256, count[some])
        seen = [np.bincount(owner + byte, minlength=len(some) * 256).reshape(-1, 256) @ _BITS_OF_BYTE for byte in hashes.view(np.uint8).reshape(-1, 8).T]
        sums = np.concatenate(seen, axis=1)
    out[some] = np.packbits(2 * sums > count[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Per text 64 bits: a bit is set if it is in over half its shingles' XXH64 with seed 42."""
    joined, begin, end, shingles = shingle_spans(data, offsets, words)
    return majority_bits(spans.xxh64(joined, begin, end, SEED), shingles)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its id and the fingerprint as a long, f0."""
    names = [id_col, "f0"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.bytes_of(batch.column(1))
            for i, j in spans.slices(offsets):
                found = fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found.view(np.int64))], names=names)

    schema = T.StructType([docs.schema[id_col], T.StructField("f0", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(emit, schema)


# -- vantage-point trees ---------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of lanes) to each other, or of all to one."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def build_tree(sample: np.ndarray, levels: int) -> list[tuple[np.ndarray, int] | None]:
    """A heap of (vantage point, median distance): children 2k+1 within it, 2k+2 beyond; None for a side without fingerprints."""
    heap: list[tuple[np.ndarray, int] | None] = [None] * (2**levels - 1)
    parts = {0: sample}
    for k in range(len(heap)):
        part = parts.pop(k, sample[:0])
        if len(part):
            # of a few candidates the one whose distances spread most: its boundary is crossed least
            point = max(part[:8], key=lambda p: distances(part, p).var())
            far = distances(part, point)
            middle = int(np.median(far))
            heap[k] = (point, middle)
            parts[2 * k + 1], parts[2 * k + 2] = part[far <= middle], part[far > middle]
    return heap


def shards_of(prints: np.ndarray, heap: list, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, own) for the shard that owns each fingerprint and the later shards that its ball of radius ``most`` reaches.

    If two fingerprints are near, each one's ball reaches the other's shard by
    the triangle inequality, so it is enough that the one with the earlier
    shard visits the later.
    """
    home = np.zeros(len(prints), np.int64)
    rows, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
    while True:
        inner = node < len(heap)
        if not inner.any():
            break
        row_parts, node_parts = [rows[~inner]], [node[~inner]]
        for k in np.unique(node[inner]).tolist():
            mine = rows[node == k]
            if heap[k] is None:
                row_parts.append(mine)
                node_parts.append(np.full(len(mine), 2 * k + 1))
                at = mine[home[mine] == k]
                home[at] = 2 * k + 1
                continue
            far = distances(prints[mine], heap[k][0])
            at_home = home[mine] == k
            home[mine[at_home]] = np.where(far[at_home] <= heap[k][1], 2 * k + 1, 2 * k + 2)
            for child, reached in ((2 * k + 1, far <= heap[k][1] + most), (2 * k + 2, far > heap[k][1] - most)):
                row_parts.append(mine[reached])
                node_parts.append(np.full(int(reached.sum()), child))
        rows, node = np.concatenate(row_parts), np.concatenate(node_parts)
    keep = node >= home[rows]
    return rows[keep], node[keep] - len(heap), node[keep] == home[rows[keep]]


def link(forest: Forest, prints: np.ndarray, queries: np.ndarray, members: np.ndarray, most: int) -> None:
    """Unite all query and member numbers at distance ``most`` or less, descending a vantage-point tree over the members."""
    if not len(queries) or not len(members):
        return
    if len(members) > 128 and len(queries) * len(members) > TILE:
        point = prints[members[len(members) // 2]]
        far, asked = distances(prints[members], point), distances(prints[queries], point)
        middle = int(np.median(far))
        inside, outside = asked <= middle + most, asked > middle - most
        beyond = far > middle
        if beyond.any() and (inside.sum() * (~beyond).sum() + outside.sum() * beyond.sum()) < 0.95 * len(queries) * len(members):
            link(forest, prints, queries[inside], members[~beyond], most)
            link(forest, prints, queries[outside], members[beyond], most)
            return
    step = max(1, TILE // len(members))
    for k in range(0, len(queries), step):
        some = queries[k : k + step]
        near = np.zeros((len(some), len(members)), np.uint8)
        for lane in range(min(2, prints.shape[1])):
            near += np.bitwise_count(prints[some, lane][:, None] ^ prints[members, lane][None, :])
        a, b = np.nonzero(near <= most)
        if prints.shape[1] > 2:  # few pairs are left for the other lanes
            close = distances(prints[some[a]], prints[members[b]]) <= most
            a, b = a[close], b[close]
        forest.union(some[a], members[b])


def _parts(sample: np.ndarray, heap: list, n: int, most: int) -> np.ndarray:
    """Into how many parts each shard's members and visitors are dealt, from where the sample's fingerprints go."""
    shards = len(heap) + 1
    _, shard, own = shards_of(sample, heap, most)
    scale = n / max(len(sample), 1)
    members, entries = np.bincount(shard[own], minlength=shards) * scale, np.bincount(shard, minlength=shards) * scale
    return np.maximum(1, np.ceil(np.stack([members / MEMBERS, entries / ENTRIES], axis=1))).astype(np.int64)


def _edges(classes: DataFrame, most: int) -> DataFrame:
    """A spanning forest's edges (a, b: fingerprints) of the graph of near fingerprints; ``classes`` has the column f0."""
    n = classes.count()
    rows = sampled(classes.select("f0"), F.xxhash64(F.lit(1), "f0"), n, SAMPLE).collect()
    sample = np.array([x[0] for x in rows], np.int64).view(np.uint64)[:, None]
    heap = build_tree(sample, min(LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))))
    parts = _parts(sample, heap, n, most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard, own = shards_of(prints[:, None], heap, most)
            salt = spans.mix(prints)[row]
            i, j = (parts[shard, k] for k in (0, 1))
            mine_i, mine_j = (salt % i.astype(np.uint64)).astype(np.int64), ((salt >> np.uint64(32)) % j.astype(np.uint64)).astype(np.int64)
            asks, holds = np.arange(len(row)), np.flatnonzero(own)
            asked = np.repeat(asks, i[asks])  # a fingerprint asks every part of the members in its part of the entries
            held = np.repeat(holds, j[holds])
            group = np.r_[
                shard[asked] << 40 | (np.arange(len(asked)) - np.repeat(np.cumsum(i[asks]) - i[asks], i[asks])) << 20 | mine_j[asked],
                shard[held] << 40 | mine_i[held] << 20 | (np.arange(len(held)) - np.repeat(np.cumsum(j[holds]) - j[holds], j[holds])),
            ]
            member = np.r_[np.zeros(len(asked), bool), np.ones(len(held), bool)]
            rows = packed(group, prints=prints[row[np.r_[asked, held]]], member=member)
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=["group", "prints", "member"])

    def search(table: pa.Table) -> pa.Table:
        prints, member = unpacked(table["prints"], np.uint64), unpacked(table["member"], np.bool_)
        nodes, number = np.unique(prints, return_inverse=True)
        forest = Forest(len(nodes))
        link(forest, nodes[:, None], np.unique(number[~member]), np.unique(number[member]), most)
        a, b = forest.edges()
        return pa.table({"a": nodes[a].view(np.int64), "b": nodes[b].view(np.int64)})

    routed = classes.select("f0").mapInArrow(route, "group long, prints binary, member binary")
    return routed.groupBy("group").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its id, the fingerprint ``f0`` and ``component_id``, the smallest id reachable over near fingerprints.

    Equal fingerprints are one class, however many documents share it. A tree
    of vantage points, built from a bounded sample, deals the classes to
    shards by Hamming distance; a class also visits the shards that its ball
    overlaps, and inside a shard a tree over its members prunes by the
    triangle inequality, so that every pair of classes within ``most_bits`` is
    met. A shard's members and its visitors are dealt to parts, and a group
    holds one part of either, whatever the number of documents. Groups return
    spanning forests, never all pairs.

    A-Z are lower-cased, words are runs of bytes other than white space, and a
    text with fewer than ``words`` words is one shingle. Null and empty texts
    have fingerprint zero and are linked like any other. Rows with a null id
    link others but name no component unless all of it is null; rows that
    repeat an id are classified each. Other columns, whatever their names, are
    left out. A text is held whole in one task, at about 100 bytes for each of
    its bytes. An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(plain, words, "id", "text"), "fingerprints")
    classes = written(prints.groupBy("f0").agg(F.min("id").alias("least")), "classes")
    found = star_components(_edges(classes, most_bits)).withColumnRenamed("node", "f0")
    named = written(classes.join(found, "f0", "left").select("f0", "least", F.coalesce("component", "f0").alias("component")), "named")
    roots = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "roots")  # a plain table, so that the join can split a large component
    joined = prints.join(named.join(roots, "component").select("f0", "component_id"), "f0")
    return joined.select(F.col("id").alias(id_col), "f0", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
