import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import token_alignment
from sparkloom.llm.token_alignment import Stretches, align, align_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n \nb", "a \n b", "\n", "x▁y", "<|endoftext|> and <s> </s>", "it's 'tis we'll", "naïve café", "日本語のテキスト です", "a b   c", " wide  space",
    "😀 smile 👍🏽 family 👨‍👩‍👧", "\x00\x01 \x1c \x1d x", "=" * 300 + " " + "-" * 77, "ab" * 500, "Word word WORD word", "tab\there and\r\nthere", "é combining", "﻿bom", "1234567890 12 345", "a" * 100 + " " + "a" * 100, "мир и труд", "\u0085 next\u0085 line",
]


@pytest.fixture(scope="module")
def known():
    return Stretches(A, B)


def tokens(known, text):
    """Both sides' ids and bytes by the libraries, from the whole text."""
    a = known.a.encode(f" {text}", add_special_tokens=False).ids
    b = known.b.encode(text)
    data, begin, size = known.bytes_a
    spelled_a = [data[begin[i] : begin[i] + size[i]].tobytes() for i in a]
    spelled_b = [bytes([int(p[3:5], 16)]) if known.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, known.b.id_to_piece(i)) for i in b)]
    return a, spelled_a, b, spelled_b


def groups_of(known, text):
    if not text:
        return [], 0, 0
    a, spelled_a, b, spelled_b = tokens(known, text)
    if b"".join(spelled_a) != f" {text}".encode() or b"".join(spelled_b) != f" {text}".encode():
        return [], 0, 0
    ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
    out = {high: ([], []) for high in sorted(set(ends_a) & set(ends_b))}
    for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
        for i, high in zip(ids, np.array(list(out))[np.searchsorted(list(out), ends)].tolist(), strict=True):
            out[high][side].append(i)
    return list(out.values()), len(a), len(b)


def brute(known, rows):
    """As the contract says, document by document."""
    groups = [groups_of(known, text) for _, text in rows]
    count = Counter(p for g, _, _ in groups for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for (key, _), (g, n_a, n_b) in zip(rows, groups, strict=True):
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((key, n_a, n_b, len(g), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_equals_brute_force_over_documents_and_odd_texts(spark, known):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, x) for i, x in enumerate(ODD * 2)] + [(None, "null id"), (3, "a repeated id")]
    found = align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), A, B, digest=True)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(known, rows), key=repr)


def test_query_covers_every_document(spark, known):
    from sparkloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, SF).collect())) == sorted(brute(known, rows))


def test_very_long_text_without_cuts(spark, known):
    random.seed(3)
    text = "".join(random.choice(["=", "==", "日本", "\n", "x1"]) for _ in range(20_000))
    rows = [(1, text), (2, "short")]
    assert sorted(map(tuple, align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), A, B, digest=True).collect())) == sorted(brute(known, rows))


def test_groups_as_text_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "unbelievable words", 1, 2)], "doc_id string, text string, n_a int, block int")
    row = align_tokens(docs, A, B).first()
    assert row.doc_id == "k" and row.groups.count("|") == row.n_groups
    assert align_tokens(docs.limit(0), A, B).count() == 0


ends = st.lists(st.integers(1, 40), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ends, ends), max_size=6))
def test_align_cuts_at_common_ends(sequences):
    """One sequence's ends on both sides, made to share the last one."""
    sides = [([*a, 41], [*b, 41]) for a, b in sequences]
    flat = [np.array([x + 100 * k for k, s in enumerate(sides) for x in s[i]], np.int64) for i in (0, 1)]
    bounds = [np.cumsum([0, *(len(s[i]) for s in sides)]) for i in (0, 1)]
    cut_a, cut_b = align(flat[0], bounds[0], flat[1], bounds[1])
    common = set(flat[0].tolist()) & set(flat[1].tolist())
    assert cut_a.tolist() == [x in common for x in flat[0].tolist()] and cut_b.tolist() == [x in common for x in flat[1].tolist()]


def test_align_compares_few_ends_of_a_shifted_run():
    """After one irregular group the rest is one-to-one at another shift."""
    a, b = np.r_[1, 2, np.arange(3, 5000)], np.r_[2, np.arange(3, 5000)]
    cut_a, cut_b = align(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
    assert not cut_a[0] and cut_a[1:].all() and cut_b.all()


def test_a_worker_keeps_few_stretches_whatever_it_reads(known, monkeypatch):
    rng = random.Random(3)
    rows = [" ".join(rng.choice(["the", "naïve", "日本", f"w{rng.randrange(500)}x"]) for _ in range(60)) for _ in range(40)] + ["", None]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x], pa.string())], names=["doc_id", "text"]) for i, x in enumerate(rows)]
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 1000)
    shown = lambda r: (r.drop_columns("payload").to_pylist(), pa.ipc.open_stream(r["payload"][0].as_buffer()).read_all()["docs"][0])
    known.forget()
    whole = [shown(r) for r in token_alignment.blocks_of(iter(batches), known, 0, True)]
    monkeypatch.setattr(token_alignment, "KEPT_STRETCHES", 5)
    known.forget()
    held, found = [], []
    for r in token_alignment.blocks_of(iter(batches), known, 0, True):
        held.append(len(known.known))
        found.append(shown(r))
    assert found == whole and len(found) > 5 and max(held) <= 5 and {"the", "naïve", "日本"} <= set(known.known)
