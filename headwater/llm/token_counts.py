"""Token counts: pieces are counted once for each distinct pre-token, joined to the documents' pre-token frequencies, and summed. No ids are kept."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .wordblocks import answers, blocks, gathered, unpacked


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", []))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512, pattern: str | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more tokens than the limit).

    vocabulary: a byte-level BPE file of the tokenizers library whose pre-tokens are the matches of the pattern. Special
    strings inside texts are found as the library finds them by default. Null texts count as empty, null ids stay null,
    repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    import public_tokenizers

    path = c.tokenizer_file("byte_bpe_50k.json", vocabulary)
    table = blocks(docs, id_col, text_col, pattern or public_tokenizers.PATTERN, special_strings(path), frequencies=True)

    def encode():
        t = c.kept(("tokenizers", path), lambda: tokenizer(path))
        return lambda words: [(len(e),) for e in t.encode_batch_fast(words, add_special_tokens=False)]

    def finish(row: dict, lens: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> pa.Table:
        pieces = ids[starts].astype(np.int64) if len(lens) else np.empty(0, np.int64)
        of = np.array(row["lens"], np.int64)
        ends = np.cumsum(of)
        steps = unpacked(row["seq"]).astype(np.int64)
        whole = np.concatenate([[0], np.cumsum(steps)])
        base = whole[ends - of]
        at = whole[1:] - np.repeat(base, of)
        sums = np.concatenate([[0], np.cumsum(pieces[at] * unpacked(row["counts"]).astype(np.int64))]) if len(at) else np.zeros(1, np.int64)
        n = sums[ends] - sums[ends - of]
        return pa.table([pa.array(row["ids"], id_arrow), pa.array(row["n_bytes"], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    return gathered(table, answers(table, encode), finish, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
