"""Blocks of documents with a dictionary each: the ground of the operators that encode every distinct pre-token once.

Exploding every pre-token of every document would shuffle several times the corpus. Pre-tokens are aggregated first, in
blocks of whole documents: a block's row has its distinct pre-tokens and, for each document, their positions as numbers of
the block's own dictionary (or, for counting, their frequencies). Only (pre-token, block, number) rows are shuffled by
pre-token; equal pre-tokens meet in sorted order, so one is encoded once, as the rows stream by. What comes back to a block
is packed by task. The blocks themselves are a table bucketed by block, so they don't move again.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Pre-tokens of a block, about: a block ends with the document that reaches it.
BLOCK_TOKENS = 6_000_000
#: Entries of one packed answer.
PACK = 400_000
#: A space before another white space: cutting there could change a match of white space.
DOUBLE = re.compile(r" \s")


def settled(text: str) -> bool:
    """True if all characters were assigned long ago: every library's Unicode tables agree on their kind."""
    if text.isascii() or max(text) < "ɐ":
        return True
    old = unicodedata.ucd_3_2_0.category
    return all(ch < "ɐ" or old(ch) not in ("Cn", "Zs", "Cf") for ch in set(text))


class Splitter:
    """Pre-tokens of texts as numbers of a dictionary that grows.

    A text is cut before each single space that a visible character follows, where a match always begins; the pieces repeat,
    and what one splits into is remembered. A piece with unsettled characters or a special string stays whole: the library
    splits it when it encodes it, with the same result.
    """

    def __init__(self, pattern: str, specials: tuple[str, ...] = ()):
        import regex

        self.findall = regex.compile(pattern).findall
        self.specials = specials
        self.number: dict[str, int] = {}
        splitter = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                out = self[piece] = splitter.numbers(" " + piece)
                return out

        self.pieces = Pieces()

    def numbers(self, piece: str) -> bytes:
        if not piece:
            return b""
        whole = any(s in piece for s in self.specials) or not settled(piece)
        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in ([piece] if whole else self.findall(piece))], np.uint32).tobytes()

    def split(self, text: str | None) -> bytes:
        """Numbers of the text's pre-tokens in order, as 32-bit integers."""
        if not text:
            return b""
        if DOUBLE.search(text):
            return self.numbers(text)
        first, *rest = text.split(" ")
        return self.numbers(first) + b"".join(map(self.pieces.__getitem__, rest))


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return c.kept("zstd", lambda: zstandard.ZstdCompressor(level=3)).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str, specials: tuple[str, ...] = (), frequencies: bool = False) -> DataFrame:
    """The table of blocks: block, words, ids, n_bytes, lens (numbers of each document), seq, and with frequencies, counts."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    spec = f"block long, words array<string>, ids array<{id_type.simpleString()}>, n_bytes array<long>, lens array<int>, seq binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = 0
        splitter, ids, n_bytes, lens, seqs, counts, total = None, [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            seq = np.concatenate(seqs) if seqs else np.empty(0, np.uint32)
            k = packed(np.concatenate(counts)) if counts else None
            cols = [[(part << 32) | made], [list(splitter.number)], [pa.concat_arrays(ids)], [n_bytes], [lens], [packed(seq)], [k]]
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(ids[0].type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["block", "words", "ids", "n_bytes", "lens", "seq", "counts"])

        for b in batches:
            start = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                splitter = splitter or Splitter(pattern, specials)
                seq = np.frombuffer(splitter.split(text), np.uint32)
                n_bytes.append(len(c.utf8(text)))
                total += len(seq)
                if frequencies:
                    seq, k = np.unique(seq, return_counts=True)
                    counts.append(k.astype(np.uint32))
                    lens.append(len(seq))
                    seqs.append(np.diff(seq, prepend=np.uint32(0)).astype(np.uint32))  # rising numbers by their steps
                else:
                    lens.append(len(seq))
                    seqs.append(seq)
                if total >= BLOCK_TOKENS:
                    ids.append(b.column(0).slice(start, i + 1 - start))
                    yield row()
                    made += 1
                    start = i + 1
                    splitter, ids, n_bytes, lens, seqs, counts, total = None, [], [], [], [], [], 0
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if lens:
            yield row()

    found = c.map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, spec)
    name = f"headwater_blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.format("parquet").option("path", c.scratch_path(spark, "blocks")).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    c.made_table(spark, name)
    return spark.table(name)


def answers(table: DataFrame, encode: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """(block, at, lens, ids): for numbers `at` of a block's words, what encode gives for each word, as numbers one after the other.

    encode() is called once a task and gives a function from distinct words to lists of numbers.
    """
    asked = table.select("block", F.posexplode("words").alias("at", "word"))
    asked = asked.select("word", (F.col("block")).alias("block"), "at").repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encode()
        last, answer = None, None
        held: dict[int, tuple[list, list]] = {}
        n = 0

        def out() -> pa.RecordBatch:
            rows = [(k, packed(np.array(at, np.uint32)), packed(np.array([len(x) for x in got], np.uint32)), packed(np.array([i for x in got for i in x], np.uint32))) for k, (at, got) in held.items()]
            cols = zip(*rows, strict=True) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["block", "at", "lens", "ids"])

        for b in batches:
            ws = b.column(0).to_pylist()
            new = [w for i, w in enumerate(ws) if w != (ws[i - 1] if i else last)]
            got = iter(of(new))
            for w, block, at in zip(ws, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if w != last:
                    last, answer = w, next(got)
                x = held.get(block)
                if x is None:
                    x = held[block] = ([], [])
                x[0].append(at)
                x[1].append(answer)
            n += len(ws)
            if n >= PACK:
                yield out()
                held, n = {}, 0
        yield out()

    return c.map_arrow(asked, run, "block long, at binary, lens binary, ids binary")


def gathered(table: DataFrame, answered: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(block row, lengths by number, ids) of each block, which yields record batches. A word without an answer is an error."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c.slim()  # the block before this one is gone
        for n, row in zip(pc.list_value_length(left.column("words")).to_pylist(), left.drop_columns(["words"]).to_pylist(), strict=True):
            at = np.concatenate([unpacked(x.as_py()) for x in right.column("at")]) if right.num_rows else np.empty(0, np.uint32)
            lens = np.concatenate([unpacked(x.as_py()) for x in right.column("lens")]) if right.num_rows else np.empty(0, np.uint32)
            ids = np.concatenate([unpacked(x.as_py()) for x in right.column("ids")]) if right.num_rows else np.empty(0, np.uint32)
            if len(at) != n or len(np.unique(at)) != n:
                raise RuntimeError(f"block {row['block']}: {len(at)} answers for {n} words")
            starts = np.zeros(n + 1, np.int64)
            np.cumsum(lens, out=starts[1:])
            order = np.empty(n, np.int64)
            order[at] = np.arange(n)
            return finish(row, lens[order].astype(np.int64), starts[order], ids)
        raise RuntimeError("answers for a block that isn't there")

    return table.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
