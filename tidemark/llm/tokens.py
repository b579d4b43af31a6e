"""Token counts of whole texts by rank-synchronous merging."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger
from .common import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str = VOCABULARY, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit.

    ``path`` is a byte-level BPE file that every executor can read. A null text
    counts as empty and has no tokens. Other columns are ignored. Texts are
    never cut; a batch is worked through in groups of a few MB, so memory does
    not follow its size.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [len(ids) // 4 for ids in merger.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["_id", "n_tokens"])

    slim = docs.select(F.struct(F.col(id_col).alias("i"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("b")).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    out = slim.mapInArrow(count, f"_id {kind}, n_tokens long")
    return out.select(F.col("_id.i").alias(id_col), F.col("_id.b").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op5_token_counts")
def op5_token_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"))
