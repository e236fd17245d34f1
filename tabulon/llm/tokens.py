"""Text sizes in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.errors import EngineError
from tabulon.runtime import fresh

#: Where the tokenizer's vocabulary lies; the folder must be readable on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies of this kind split text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def count_tokens(df: DataFrame, text: str, name: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without the text column but with its number of tokens; null for null, 0 for the empty text.

    ``tokenizer`` is a file of one of three kinds, told by its name: ``.tiktoken`` ranks, a
    ``.model`` of pieces, or a ``.json`` tokenizer. A taken ``name`` gets a numbered suffix.
    """
    if not os.path.exists(tokenizer):
        raise EngineError(f"No tokenizer at {tokenizer}.")
    kept = [f for f in df.schema.fields if f.name != text]
    (name,) = fresh([f.name for f in kept], name)
    fields = T.StructType([*kept, T.StructField(name, T.LongType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = _encoder(tokenizer)
        for b in batches:
            coded = b.column(at).dictionary_encode()
            values = coded.dictionary.to_pylist()
            sizes = []
            for k in range(0, len(values), 256):
                sizes += encode(values[k : k + 256])
            column = pa.array(sizes, pa.int64()).take(coded.indices) if sizes else pa.nulls(len(coded), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), column], names=[f.name for f in fields])

    return df.mapInArrow(run, fields)
