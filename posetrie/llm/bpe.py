"""Byte-level BPE with the tiktoken library: whole texts to token ids, token ids back to raw bytes.

Ranks come from a local rank file, which every worker reads once. Long texts are cut at safe
boundaries first: between a character that isn't white space and one that is, no match of the
splitting pattern goes on, so that the pieces' ids joined are the ids of the whole.

A null text counts as empty: no ids, no bytes. Extra columns stay as they are; the new columns'
names are parameters and must be free. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from posetrie.llm.common import add_column, list_array, rows_of, slices

#: White space as Unicode has it.
BLANK = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_EDGE = re.compile(f"[^{BLANK}](?=[{BLANK}])")
#: Characters beyond which a text is cut.
LONG = 1 << 16


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file of lines of base64 and rank."""
    import tiktoken

    with open(rank_file, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """text in parts of about long characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > long and (edge := _EDGE.search(text, start + long - 1)):
        yield text[start : edge.end()]
        start = edge.end()
    yield text[start:]


def _ids(texts: pa.Array, enc) -> pa.Array:
    return list_array([np.array([i for part in pieces(x or "") for i in enc.encode_ordinary(part)], np.int32) for x in texts.to_pylist()], pa.int32())


def _raw(rows: pa.Array, enc) -> pa.Array:
    return pa.array([b"" if x is None else enc.decode_bytes(x.tolist()) for x in rows_of(rows)], pa.binary())


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text as array<int>."""
    return add_column(docs, text, _ids, to, T.ArrayType(T.IntegerType()), lambda: encoding(rank_file, pattern))


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """tokens with the raw bytes of their ids, whether or not these are valid UTF-8 (null ids: no bytes)."""
    return add_column(tokens, ids, _raw, to, T.BinaryType(), lambda: encoding(rank_file, pattern))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """docs without their texts, with what encode() and then decode() give; in one Python worker a task, where these two in a row take two."""
    kept = docs.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(to, T.BinaryType())])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in slices(batch):
                found = _ids(part.column(part.num_columns - 1), enc)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found, _raw(found, enc)], names=schema.names)

    return docs.select(*kept.columns, text).mapInArrow(run, schema)
