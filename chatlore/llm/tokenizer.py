"""Encoding of texts with a public byte-level BPE tokenizer, and decoding back.

Texts go through Arrow batches to the tokenizers library; each Python worker loads the vocabulary
once. Defined cases: null and empty texts give an empty list; names of special tokens in a text are
ordinary text; texts of any length are encoded whole (long ones in pieces cut where the
pre-tokenizer always cuts, see ``_pieces``). The result is one row for each input row, repeated rows
included; all columns but the named ones are dropped.

Decoding maps each token's characters back to bytes through the byte table and joins the bytes of
all tokens before it reads UTF-8, so characters split over tokens come out whole. Unpaired
surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
LONG = 1 << 16
BATCH_CHARS = 1 << 21
# A line end followed by a letter or digit always starts a new pre-token after it.
_CUT = re.compile(r"(?<=[^\s])\n(?=[^\W_])")


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def _pieces(text: str) -> list[str]:
    """Cut a long text right after line ends between a non-space and a letter or digit.

    ``\\n`` alone there is a pre-token of its own and the letter begins the next one, so the
    ids of the pieces are those of the whole.
    """
    out, start = [], 0
    while len(text) - start > LONG:
        m = _CUT.search(text, start + LONG)
        if not m:
            break
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    t = load(path)
    parts, owner = [], []
    for n, text in enumerate(texts):
        if text:
            p = _pieces(text) if len(text) > LONG else [text]
            parts += p
            owner += [n] * len(p)
    ids: list[list[int]] = [[] for _ in texts]
    start = 0
    while start < len(parts):
        end, chars = start, 0
        while end < len(parts) and (end == start or chars + len(parts[end]) <= BATCH_CHARS):
            chars += len(parts[end])
            end += 1
        for n, e in zip(owner[start:end], t.encode_batch_fast(parts[start:end], add_special_tokens=False)):
            ids[n] = ids[n] + e.ids if ids[n] else e.ids
        start = end
    return ids


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row."""
    path = path or vocabulary()
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_texts(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others
    for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + n): b for n, b in enumerate(rest)}


def decode_ids(ids: list[int], path: str) -> str:
    table, t = byte_table(), load(path)
    return b"".join(bytes(table[c] for c in t.id_to_token(i)) for i in ids).decode("utf-8")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of rows of ids; an empty or null list gives the empty text."""
    path = path or vocabulary()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x or [], path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes each token stands for, by id: one for each of its characters."""
    t = load(path)
    return np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size(with_added_tokens=True))], np.int64)


def offsets(text: str | None, ids: list[int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token, in the text itself.

    Bytes of the tokens are counted up, and each byte is mapped to the character it belongs to; tokens that share
    a character overlap there."""
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(token_bytes(path)[np.asarray(ids)])
    begin = np.concatenate([[0], end[:-1]])
    return character[begin], character[end - 1] + 1


def encode_with_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids, begins, ends) of every row: characters of each token, from 0."""
    path = path or vocabulary()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, begins array<bigint>, ends array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, path)
            spans = [offsets(t, i, path) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), *[pa.array([x[n] for x in spans], pa.list_(pa.int64())) for n in (0, 1)]],
                [key, "ids", "begins", "ends"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
