"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that come out as the
one token of their own are whole tokens. A text is cut into pre-tokens; those
among the whole tokens count one without merging, only the rest are merged.

Null text: empty, 0 tokens and bytes. Very long texts are counted whole. One
output row per input row (repeated rows stay, there is nothing to tie); an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kestrel.llm.common import chunks, read, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_tokens > limit of every text. Runs where
    the rows lie: no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        from kestrel.llm.pretokens import Bare

        tokenizer = Bare(vocabulary)
        for batch in chunks(batches):
            texts = batch.column(1)
            n = pa.array(tokenizer.counts(texts), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(count, SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
