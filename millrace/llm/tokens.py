"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a .tiktoken file, one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, row_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(row_id, n_tokens): the tokens of each whole text; NULL and empty text have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    return spread(df.select(F.col(row_id).alias("id"), F.col(text).alias("text"))).mapInArrow(count, f"id {dict(df.dtypes)[row_id]}, n_tokens bigint").withColumnRenamed("id", row_id)
