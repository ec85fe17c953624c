"""Every numbered query over odd tables: nulls, repeats, ties, clashing names, no rows, very long texts."""

import collections

import pytest
from pyspark.sql import functions as F
from sparkloom.llm import line_dedup, queries, simhash, token_counts

from tests.llm import brute

#: Names that operators use inside, as columns of the input, with types of their own.
CLASHING = {"uid": "x", "id": 1, "score": "high", "predicted": "p", "h": 2.5, "group": "g", "component": None, "component_id": "c", "f0": 3, "host": 7, "path": 8, "verdict": 9, "mix_slot": "m", "mix_place": None, "n_removed": "r", "n_words": "w", "valid": "v", "vector": "q", "start": "s", "length": "l", "at": "a", "c0": "z", "order": "o", "label_": 1}
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
}


def odd_rows():
    text = "\n".join(f"line {k} of a longer text with some words" for k in range(30))
    docs = [(1, text), (1, text), (2, text + "\nend"), (None, text), (None, None), (3, ""), (4, None), (5, " \n\t "), (6, "one"), (7, "é" * 300), (20, text.upper())]
    return {
        "documents": [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None) for k, (i, t) in enumerate(docs)],
        "labels": [(1, 1, 0), (1, 1, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (6, 1, 0), (99, 1, 1)],
        "embeddings": [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (20, [1.0, 2.0], None), (21, None, 1), (22, [0.0, 0.0], 1), (None, [2.0, 4.0], 1), (24, [None, 1.0], 1), (25, [float("nan"), 1.0], 1), (40, [-1.0], 1), (41, [], 1)],
        "benchmark": [(1, "line of WORDS"), (1, "line of WORDS"), (None, "one"), (2, None), (3, ""), (4, "nowhere")],
        "pages": [(1, "http://a.example.com/en/x?y", "h"), (1, "http://a.example.com/en/x?y", "h"), (2, None, None), (None, "https://WWW.Example.com/en/", ""), (3, "", ""), (4, "://", ""), (5, "no scheme", ""), (6, "http://b.net/es/#a://b", "")],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('odd')}"
    for name, rows in odd_rows().items():
        plain = spark.createDataFrame(rows, TABLES[name])
        plain.coalesce(1).write.parquet(f"{base}/plain/{name}.parquet")
        plain.limit(0).write.parquet(f"{base}/empty/{name}.parquet")
        extra = {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in CLASHING.items() if k not in plain.columns}
        plain.withColumns(extra).coalesce(1).write.parquet(f"{base}/clashing/{name}.parquet")
    return base


def counted(df):
    return collections.Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, folders, name):
    query = queries.QUERIES[name]
    plain, clashing, empty = (query(spark, f"{folders}/{kind}") for kind in ("plain", "clashing", "empty"))
    assert plain.schema.simpleString() == clashing.schema.simpleString() == empty.schema.simpleString()
    found = counted(plain)
    assert found == counted(clashing)
    assert empty.count() == 0
    table = {"op2_url_filter": "pages", "op8_embedding_near_dedup": "embeddings"}.get(name, "documents")
    if name not in ("op6_packing", "op9_exact_top_k", "op11_lexical_search"):  # these give several rows, or none, for one
        ids = collections.Counter(r[0] for r in odd_rows()[table])
        first = collections.Counter()
        for row, n in found.items():
            first[row[plain.columns.index("page_id" if table == "pages" else "vec_id" if table == "embeddings" else "doc_id")]] += n
        assert first == ids


def test_very_long_texts(spark):
    """Texts of some megabytes, one of them a single word and one a single line, beside short ones."""
    import public_tokenizers
    from tokenizers import Tokenizer

    lines = [f"word{k % 997} and {k} more of them" for k in range(60_000)]
    texts = {1: "\n".join(lines), 2: "x" * 1_000_000, 3: " ".join(lines[:20_000]), 4: "\n".join(lines[100:110]), 5: "short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)

    prints = {r.doc_id: r.f0 & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()}
    assert prints == {i: brute.fingerprint(t) for i, t in texts.items()}

    gone = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert gone == {i: removed for i, (_, removed, _) in brute.repeated_lines(texts).items()} and gone[4] == 10

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(str(path))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
