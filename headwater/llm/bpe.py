"""Byte-level BPE: encoding by a shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .wordblocks import answers, blocks, gathered, unpacked


def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in c.tiktoken_ranks(path).items()}


def encode_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, output: str = "ids") -> DataFrame:
    """One row per input row. output "ids": id, ids (array of int). "digests": id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes that the ids decode to).

    Each match of the pattern is encoded separately by the ranks of a tiktoken file, without special tokens. Null texts
    count as empty, null ids stay null, repeated rows give repeated results; other columns are not read; an empty table
    gives no rows. A document is assembled in one task, so the longest one has to fit it.
    """
    import public_tokenizers

    path = c.tokenizer_file("byte_bpe_multi_50k.tiktoken", vocabulary)
    pattern = pattern or public_tokenizers.PATTERN
    table = blocks(docs, id_col, text_col, pattern)
    id_name = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema[id_col].dataType)

    def encode():
        e = c.kept(("tiktoken", path, pattern), lambda: c.tiktoken_encoding(path, pattern))
        return lambda words: [e.encode_ordinary(w) for w in words]

    def finish(row: dict, lens: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> pa.Table:
        seq = unpacked(row["seq"])
        ends = np.cumsum(np.array(row["lens"], np.int64))
        docs_of = list(zip((ends - np.array(row["lens"], np.int64)).tolist(), ends.tolist(), strict=True))
        first = pa.array(row["ids"], id_arrow)
        every = ids.tolist()
        of = [every[s : s + n] for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]
        if output == "ids":
            raw = [np.array(x, "<i4").tobytes() for x in of]
            flat = [np.frombuffer(b"".join(map(raw.__getitem__, seq[s:e].tolist())), "<i4") for s, e in docs_of]
            return pa.table([first, pa.array(flat, pa.list_(pa.int32()))], names=[id_col, "ids"])
        table_of = c.kept(("token bytes", path), lambda: token_bytes(path))
        decimal = ["".join([f"{i}," for i in x]).encode() for x in of]
        decoded = [b"".join([table_of[i] for i in x]) for x in of]
        del every, of
        n_tokens, by_ids, by_bytes = [], [], []
        for s, e in docs_of:
            at = seq[s:e]
            n_tokens.append(int(lens[at].sum()))
            at = at.tolist()
            by_ids.append(hashlib.sha256(b"".join(map(decimal.__getitem__, at))[:-1]).hexdigest())
            by_bytes.append(hashlib.sha256(b"".join(map(decoded.__getitem__, at))).hexdigest())
        return pa.table([first, pa.array(n_tokens, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    spec = "ids array<int>" if output == "ids" else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return gathered(table, answers(table, encode), finish, f"`{id_col}` {id_name}, {spec}")


def decode_bpe(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) of each row's ids, by the token-byte table. Null ids give an empty text; an id outside the table is an error; bytes that are no UTF-8 become replacement characters."""
    path = c.tokenizer_file("byte_bpe_multi_50k.tiktoken", vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = c.kept(("token bytes", path), lambda: token_bytes(path))
        for b in batches:
            texts = [b"".join(map(table_of.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return c.map_arrow(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")), run, f"id {encoded.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
