"""Token counts: rank-synchronous merging of ragged arrays of pre-tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .bpe import Merges

LIMIT = 512
#: Chunks whose counts a worker keeps at most; then those not met again go.
CACHE_CHUNKS = 400_000
#: White space as the library's patterns have it, which isn't quite what Python's ``\s`` has.
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Counter:
    """Counts of whole texts, from counts of chunks between single spaces.

    A space before a text's next word belongs to that word's pre-token, so a
    text without double spaces falls apart at its spaces into chunks that are
    counted on their own and kept; other texts are pre-tokenised whole.
    """

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.older_first: dict[str, int] = {}
        self.older_later: dict[str, int] = {}

    def _learn(self, chunks: list[str]) -> list[int]:
        pretokens = [PRETOKEN.findall(x) for x in chunks]
        distinct = {x: i for i, x in enumerate(set().union(*pretokens))}
        counts = self.merges.merge([x.encode() for x in distinct])[1].tolist() if distinct else []
        return [sum(counts[distinct[x]] for x in found) for found in pretokens]

    def count(self, texts: list[str]) -> list[int]:
        out, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if self.special is None or not self.special.search(text):
                parts.append((i, text))
            else:
                out[i] += sum(1 for _ in self.special.finditer(text))
                parts += [(i, x) for x in self.special.split(text)]
        whole = [(i, x) for i, x in parts if "  " in x or x[-1:] == " "]
        split = [(i, x.split(" ")) for i, x in parts if not ("  " in x or x[-1:] == " ")]
        for cache, older, lead, chunks in ((self.first, self.older_first, "", {x[0] for _, x in split}), (self.later, self.older_later, " ", set().union(*(x[1:] for _, x in split)))):
            if len(cache) > CACHE_CHUNKS:
                older.clear()
                older.update(cache)
                cache.clear()
            missing = chunks.difference(cache)
            known = missing & older.keys()
            cache.update((x, older[x]) for x in known)
            missing = list(missing - known)
            cache.update(zip(missing, self._learn([lead + x for x in missing]), strict=True))
        for i, x in split:
            out[i] += self.first[x[0]] + sum(map(self.later.__getitem__, x[1:]))
        for (i, _), n in zip(whole, self._learn([x for _, x in whole]), strict=True):
            out[i] += n
        return out


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``vocabulary`` is the path, on every executor, of a byte-level vocabulary
    file; its special strings inside texts count as one token each. Texts are
    read whole, a very long one in one task, which holds its pre-tokens at once
    (about 100 bytes for each of its bytes); null counts as empty and gives 0
    and 0; every input row gives one output row, repeated or not; other columns
    are left out; an empty table gives an empty one.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            _, offsets = spans.bytes_of(batch.column(1))
            n: list[int] = []
            for i, j in spans.slices(offsets):
                n += counter.count([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n, pa.int64())], names=names)

    names = [id_col, "n_bytes", "n_tokens"]
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = docs.select(id_col, text_col).mapInArrow(tally, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
