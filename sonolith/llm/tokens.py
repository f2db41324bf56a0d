"""Encoding of a whole corpus with a public tokenizer.

`encode_texts` adds the list of token ids to every row, `count_tokens` their number. Texts are encoded where they lie,
batch by batch, without a shuffle; pre-tokens that were seen before come from a bounded cache of the worker. The
vocabulary (under 1 MB, whatever the corpus) is read on the driver and broadcast.

Defined cases: a null or empty text gives an empty list; a blank text gives the ids of its white space; texts of any
length are encoded whole; repeated rows come out as often as they came in; an input column named like the output is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sonolith.llm.bpe import encoder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64_000_000


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as file:
        content = file.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: over {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the ids (array<int>) of the texts; the text itself stays only if it is selected again before."""
    shared = _vocabulary(df, vocabulary)
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds what a batch of long texts holds at once
                part = batch.slice(at, 1024)
                lists = [encode(t) for t in part.column(text).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], ids], names=[*names, out])

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df, without the text, with the number of its tokens."""
    shared = _vocabulary(df, vocabulary)
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            counts = pa.array([len(encode(t)) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], counts], names=[*names, out])

    return df.mapInArrow(run, schema)
