"""Document sizes in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.storage import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the byte-level vocabularies cut a text before merging. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    """The tokenizer of a vocabulary file of byte-level ranks, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, key: str, text: str, path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_tokens, quality, *keep): every row with its whole text's size. quality: the share of letters and
    digits in the text, at least 0.01. Null and empty texts have size 0; rows with a null key are left out."""
    picked = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c) for c in keep]).where("key is not null")
    kept = [picked.schema[c] for c in keep]
    names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            q = [max(0.01, sum(map(str.isalnum, t)) / len(t)) if t else 0.01 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(q, pa.float64()), *[b.column(c) for c in names]], ["key", "n_tokens", "quality", *names])

    schema = ", ".join(["key long", "n_tokens long", "quality double", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept]])
    return spread(picked).mapInArrow(count, schema)
