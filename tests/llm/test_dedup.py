import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import components, embedding_dedup, line_dedup, repeats, shared, simhash, spans, substring_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, n_words string, __key int"


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    passage = [" ".join(word() for _ in range(50)) for _ in range(3)]
    texts = [None, "", " \n\t", "one two", "x " * 200, passage[0], passage[0], "  ".join(passage), passage[1][40:] + "\n" + passage[0][:150]]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(passage)[r.randint(0, 20) :])
        texts.append(r.choice([" ", "\n", "\t "]).join(parts))
    texts.append(" ".join(word() for _ in range(30_000)))
    return dict(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs.items()], DOCS).repartition(3)


def test_passages_equal_brute_force(spark):
    docs = corpus()
    found = substring_dedup.remove_repeated_passages(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in found} == brute.repeated_passages(docs)
    assert {r["__key"] for r in found} == {1}


def test_long_texts_are_sliced_alone():
    assert list(spans.slices(np.array([0, 120, 140, 260, 260]), 10)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert list(spans.slices(np.array([0, 4, 8, 12, 30]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(spans.slices(np.array([0]), 10)) == []


@pytest.mark.parametrize(("block", "salted"), [(2 << 20, 1024), (3000, 2)])
def test_small_blocks_and_salts_change_nothing(spark, monkeypatch, block, salted):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "SALTED", salted)
    docs = corpus(11)
    found = substring_dedup.remove_repeated_passages(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in found} == {i: x[:2] for i, x in brute.repeated_passages(docs).items()}
    docs = lines_corpus()
    wanted = brute.repeated_lines(docs)
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.remove_repeated_lines(frame(spark, docs)).collect()} == {i: x[:2] for i, x in wanted.items()}


def test_windows_that_differ_in_one_patterned_word_stay(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other, rest = one.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(34))
    rows = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated_passages(rows).collect()] == [0, 0]
    rows = spark.createDataFrame([(1, f"{one}\nx\ny"), (2, f"{other}\nx\ny")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.remove_repeated_lines(rows).collect()] == [0, 0]


def test_a_very_long_text(spark):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"{r.getrandbits(40):x}" for _ in range(300_000))
    rows = spark.createDataFrame([(1, f"{long} {passage} {long[:5_000_00]}"), (2, passage)], "doc_id long, text string")
    found = {x.doc_id: x for x in substring_dedup.remove_repeated_passages(rows).collect()}
    repeated = len(long[:5_000_00].split(" "))
    assert found[2].n_removed == 60 and 60 + 2 * repeated - 2 <= found[1].n_removed <= 60 + 2 * repeated
    lines = "\n".join(f"{r.getrandbits(60):x}" for _ in range(200_000))
    rows = spark.createDataFrame([(1, lines), (2, "a\n" + lines)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in line_dedup.remove_repeated_lines(rows).collect()} == {1: 0, 2: 200_000}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert substring_dedup.remove_repeated_passages(none).count() == 0
    assert line_dedup.remove_repeated_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "other")], "doc_id long, text string")
    found = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeated_passages(rows).collect()]
    assert sorted(found, key=str) == [(1, 40), (1, 40), (2, 0), (None, 40)]
    alone = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated_passages(alone).collect()] == [40, 40]
    lines = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")
    found = [(r.doc_id, r.n_removed) for r in line_dedup.remove_repeated_lines(lines).collect()]
    assert sorted(found, key=str) == [(1, 0), (1, 3), (None, 3)]


def lines_corpus():
    r = random.Random(5)
    block = [f"line {k}" for k in range(8)]
    texts = [None, "", "\n\n", "a\n\nb", "\n".join(block), "x\n" + "\n".join(block[2:6]) + "\ny", "\n".join(["same"] * 7), "\n".join(block[:2]) + "\nz", "\n\n".join(block) + "\n"]
    texts += ["\n".join(r.choice(block) for _ in range(r.randint(0, 12))) for _ in range(50)]
    return dict(enumerate(texts))


def test_lines_equal_brute_force(spark):
    docs = lines_corpus()
    wanted = brute.repeated_lines(docs)
    for r in line_dedup.remove_repeated_lines(frame(spark, docs)).collect():
        n, gone, kept = wanted[r.doc_id]
        assert (r.n_lines, r.n_removed, [x for x in (r.text or "").split("\n") if x.strip()]) == (n, gone, kept), r.doc_id
        if not gone:
            assert r.text == (docs[r.doc_id] or "")


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = corpus(7)
    for i in range(100, 160):  # near copies, so that components are more than pairs
        w = docs[77 if 77 in docs else 69].split()[: 300]
        w[i - 100] = "new"
        docs[i] = " ".join(w).upper()
    prints = {i: brute.fingerprint(t) for i, t in docs.items()}
    groups = brute.components(docs, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in simhash.near_duplicates(frame(spark, docs)).collect():
        assert r.f0 % (1 << 64) == prints[r.doc_id] and r.component_id == groups[r.doc_id]


@pytest.mark.parametrize(("shard", "members", "entries"), [(20, 8, 30), (1000, 7, 7), (16, 10_000, 10_000)])
def test_parts_of_shards_lose_no_link(spark, monkeypatch, shard, members, entries):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "ENTRIES", entries)
    r = random.Random(6)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(340):
        prints.append(r.choice(prints) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in prints})
    classes = spark.createDataFrame([(x,) for x in prints], "f0 long").repartition(3)
    groups = brute.components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 if prints[a] ^ prints[b] >= 0 else ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4)
    forest = components.Forest(len(prints))
    number = {x: k for k, x in enumerate(prints)}
    edges = [(number[x.a], number[x.b]) for x in simhash._edges(classes, 4).collect()]
    forest.union(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    assert forest.roots(np.arange(len(prints))).tolist() == [groups[k] for k in range(len(prints))]


@given(st.lists(st.binary(max_size=150), max_size=12))
def test_xxh64_equals_the_library(held):
    data = np.frombuffer(b"".join(held), np.uint8)
    end = np.cumsum([0, *map(len, held)])
    assert spans.xxh64(data, end[:-1], end[1:], 42).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in held]


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=9), max_size=9), st.booleans())
def test_majority_bits(held, long):
    held = [x * (1 + 70 * long) for x in held]
    found = simhash.majority_bits(np.array([h for x in held for h in x], np.uint64), np.array([len(x) for x in held], np.int64))
    assert found.tolist() == [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for x in held]


@pytest.mark.parametrize(("lanes", "most", "levels"), [(1, 4, 5), (1, 12, 3), (2, 10, 4)])
def test_vantage_point_shards_lose_no_pair(lanes, most, levels):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**64, (40, lanes), dtype=np.uint64)
    prints = np.repeat(centres, 20, axis=0)
    for _ in range(3):
        flip = r.integers(0, 64, prints.shape).astype(np.uint64)
        prints = prints ^ (np.uint64(1) << flip)
    prints = np.unique(prints, axis=0)
    row, shard, own = simhash.shards_of(prints, simhash.build_tree(prints[:200], levels), most)
    home = dict(zip(row[own].tolist(), shard[own].tolist(), strict=True))
    assert len(home) == len(prints) == own.sum()
    reached = set(zip(row.tolist(), shard.tolist(), strict=True))
    near = simhash.distances(prints[:, None, :], prints[None, :, :]) <= most
    for a, b in zip(*np.nonzero(near), strict=True):
        first, second = (a, b) if home[int(a)] <= home[int(b)] else (b, a)
        assert (int(first), home[int(second)]) in reached
    forest = components.Forest(len(prints))
    simhash.link(forest, prints, np.arange(len(prints)), np.arange(len(prints)), most)
    full = components.Forest(len(prints))
    full.union(*np.nonzero(near))
    assert (forest.roots(np.arange(len(prints))) == full.roots(np.arange(len(prints)))).all()


def test_star_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 501), (501, 500), (7, 7)]
    found = {r.node: r.component for r in components.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)} | {500: 500, 501: 500}
    assert components.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=400, seed=2):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, 8))
    rows = [(i, (base[i % 30] * r.uniform(0.1, 5) + r.normal(size=8) * 0.12).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * 8), (n + 2, [float("nan")] + [1.0] * 7), (n + 3, [None] + [1.0] * 7), (n + 4, [float("inf")] * 8), (n + 5, []), (n + 6, [1.0]), (n + 7, [2.0, 0.0])]
    return rows


def test_cells_in_two_levels_lose_no_near_vector():
    r = np.random.default_rng(4)
    rows = np.repeat(r.normal(size=(60, 5)), 12, axis=0) + r.normal(size=(720, 5)) * 0.2
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for cells in (embedding_dedup.fit_cells(rows[::3], 40), embedding_dedup.fit_cells(rows[:1], 40), embedding_dedup.fit_cells(rows[:0], 1)):
        row, cell, own = embedding_dedup.cells_of(rows, cells, 0.95)
        assert own.sum() == len(rows) and sorted(row[own]) == list(range(len(rows))) and cell.max() < len(cells)
        home = dict(zip(row[own].tolist(), cell[own].tolist(), strict=True))
        visits = set(zip(row.tolist(), cell.tolist(), strict=True))
        for a, b in zip(*np.nonzero(rows @ rows.T >= 0.95), strict=True):
            assert (int(a), home[int(b)]) in visits or (int(b), home[int(a)]) in visits
    assert embedding_dedup.cells_of(rows[:0], cells, 0.95)[0].size == 0


@pytest.mark.parametrize("block, coarse", [(8192, 256), (16, 256), (16, 3)])
def test_embeddings_equal_brute_force(spark, monkeypatch, block, coarse):
    rows = vectors()
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 50)
    monkeypatch.setattr(embedding_dedup, "COARSE", coarse)
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v + [0.0] * (8 - len(v)), np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x)
    near = lambda a, b: a in unit and b in unit and unit[a] @ unit[b] >= 0.95
    groups = brute.components([i for i, _ in rows], near)
    links = {i: sum(near(i, j) for j, _ in rows if j != i) for i, _ in rows}
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (links[i], groups[i], groups[i] == i) for i, _ in rows}
    assert max(links.values()) > 5


def test_embeddings_with_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(5, [1.0, 0.0], 1, "x"), (5, [1.0, 0.0], 2, "y"), (None, [2.0, 0.0], 3, "z"), (7, [0.0, 1.0], 4, "u"), (7, [0.0, 1.0], 4, "u"), (None, [-1.0, 0.0], 5, "v"), (3, None, 6, "w")]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int, component string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, False), (3, 0, 3, True)], key=str)


def test_samples_have_their_size(spark):
    for n, most in ((0, 5), (3, 5), (5000, 4500), (20_000, 1000)):
        rows = shared.sampled(spark.range(n), F.xxhash64("id"), n, most).collect()
        assert len(rows) == len({r.id for r in rows}) == min(n, most)
