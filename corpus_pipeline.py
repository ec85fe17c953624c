"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup, mixing, near_texts, packing, toxicity
from sparkloom.llm.shared import renamed, written
from sparkloom.sources.session import with_package

#: Five-word shingles; documents whose sets of them have a Jaccard similarity of 4 / 5 or more are near.
SHINGLE, SHARE = 5, (4, 5)
#: Words from which a run of one or two lines counts as a passage.
PASSAGE = 50


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, doesn't reject; all their columns as they were.

    Null and empty texts have the bias alone and stay unless it rejects. Rows
    that repeat an id or a text are judged each. Columns may have any names.
    Empty tables of documents or labels reject nothing. Texts are scored whole.
    """
    with_package(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, own = renamed(docs)
    return toxicity.score(plain, model, own["text"]).where("predicted = 0").select(*own.values()).toDF(*docs.columns)


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later copies of a run of three lines or a passage.

    ``text`` is rewritten, null becoming empty, and ``n_chars``, where there is
    such a column, follows it; all other columns, whatever their names, stay as
    they were. The first copy, in the order of the id, stays; null ids come
    last; rows that repeat an id and a text are documents of their own. An
    empty table gives an empty one.
    """
    with_package(spark)
    plain, own = renamed(docs)
    kept = line_dedup.remove_repeated_lines(plain, own["doc_id"], own["text"], passage_words=PASSAGE)
    follows = {own["n_chars"]: F.coalesce(F.length(own["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {}
    return kept.select(*(follows.get(c, F.col(c)).alias(c) for c in own.values())).toDF(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with all its columns as they were.

    The one with the smallest id stays, null ids coming last. Null and empty
    texts are one group; of rows that repeat an id and a text one stays. An
    empty table gives an empty one. See ``near_texts.one_of_each``.
    """
    with_package(spark)
    return near_texts.one_of_each(docs, SHINGLE, SHARE)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule: files and rows follow it; all their columns as they were.

    Null sources count as the empty source. Null and repeated ids are mixed
    each. An empty table gives an empty one.
    """
    plain, own = renamed(docs)
    order = ["mix_slot", "mix_place", own["doc_id"]]
    mixed = mixing.mix(plain, id_col=own["doc_id"], source_col=own["source"])
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*own.values()).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by training sequence; sequences follow the schedule of the stage before.

    Null and empty texts give one piece with the end id alone; null and
    repeated ids are packed each; an empty table gives no pieces.
    """
    import public_tokenizers

    with_package(spark)
    at = (F.col("mix_slot") * mixing.BLOCK + F.col("mix_place")).alias("at")
    return packing.pack_in_order(docs, public_tokenizers.path("word_bpe_49k.json"), lambda rows: mixing.mix(rows).select("*", at), ("source",))


STAGES = [
    ("toxicity", toxic_documents_out),
    ("line_dedup", repeated_lines_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("source_mixing", sources_mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, link over chains and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
