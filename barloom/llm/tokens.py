"""Token counts with a public byte-level BPE vocabulary, given as the path of a rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rank file on the driver's machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Sends the rank file along with the job, once per Spark context, for executors that don't have its path. A second file of the same name isn't sent: its path must be
    readable everywhere."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_barloom_vocabularies", {})
    if os.path.basename(path) not in sent:
        sent[os.path.basename(path)] = path
        context.addFile(path)


def _readable(path: str) -> str:
    """The path itself where it can be read, else the file that came with the job."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(_readable(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """The length in bytes of each token id."""
    with open(_readable(path), "rb") as f:
        pairs = [(int(b), len(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    out = np.zeros(max(i for i, _ in pairs) + 1, dtype=np.int64)
    for i, n in pairs:
        out[i] = n
    return out


def token_counts(df: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of the whole text (0 for null or empty). One pass, no shuffle."""
    ship_vocabulary(df.sparkSession, vocabulary)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [0 if t is None else len(encode(t)) for t in (x.as_py() for x in batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(count, f"{kept}, n_tokens bigint")
