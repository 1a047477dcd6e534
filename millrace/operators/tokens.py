"""Token lengths by a tokenizer file of the tokenizers library."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def token_lengths(df: DataFrame, text: str, path: str, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of the text, without special tokens; 0 where it is null. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                n = [len(e) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], [*part.schema.names, name])

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{name}` long")


def within(df: DataFrame, most: int, name: str = "n_tokens") -> DataFrame:
    """The rows of at most so many tokens."""
    return df.filter(df[name] <= most)
