"""Token ids in a content-addressed store.

A document's id stream is cut where a rolling hash of its last ids says so, so equal passages give equal chunks wherever they
stand. Unique chunks are stored once under their SHA-256; a document is a recipe, the list of its chunks. Recipes stand in
ascending id order in parts, and each knows how many ids stand before it. A Merkle tree over chunks, documents and parts
verifies what is read back.

Files, all Parquet, under one folder: chunks (key: the hash, data: the ids), recipes (part, key, id, n, hashes, root, start),
manifest (part, n_docs, n_ids, start, root), root (n_parts, n_docs, n_ids, root, width: one row over the manifest). Readers
follow the tree from its root: the root row must follow from the manifest, the manifest from the recipes, a recipe from its
hashes, and a chunk from its data; anything lost or changed is an error.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Chunk lengths in ids: least, mean beyond the least, most. The rolling hash sees so many ids.
LEAST, MEAN, MOST, ROLL = 128, 512, 4096, 8
#: Words that an encoder remembers before it forgets half of them.
CACHE = 1_000_000
#: Bytes of text that are encoded at once, about: the memory's index is made anew for each.
GROUP = 16 << 20
#: Marks that may stand behind a word; together they are one match of the pattern. No apostrophe: it may begin one.
TAIL = '.,;:!?*%&$#|"()'
#: What the vocabulary file says of its normalizer and splitting pattern, for which `quick` below holds.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[!-~¡-įı-ſ]+")


def gears() -> np.ndarray:
    """A 32-bit number for each of 65536 ids, by splitmix64."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. A cut depends on the last ROLL ids alone, but for the least and the most length."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = c.kept("gears", gears)[ids & 0xFFFF]
    h = g.copy()
    with np.errstate(over="ignore"):
        for j in range(1, ROLL):
            h[j:] += g[:-j] << np.uint32(j)
    marks = (np.flatnonzero((h >> np.uint32(16)) % np.uint32(MEAN) == 0) + 1).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            last = m
            out.append(m)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is; of nothing, the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Memory:
    """What make gives for strings, in arrays: a name's run of ids in one flat array. Beyond a bound the half that is longest unasked is forgotten."""

    def __init__(self, make, kind: str):
        self.make, self.turn = make, 0
        self.names, self.flat = pa.array([], pa.string()), np.empty(0, kind)
        self.sizes, self.asked = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: pa.Array) -> np.ndarray:
        """Numbers of distinct strings; they hold until the next call."""
        self.turn += 1
        if len(self.names) > CACHE:
            self.forget()
        found = pc.index_in(keys, value_set=self.names)
        new = pc.is_null(found)
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if unknown := keys.filter(new).to_pylist():
            made = list(map(self.make, unknown))
            at[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.names), len(self.names) + len(made))
            self.names = pa.concat_arrays([self.names, pa.array(unknown, pa.string())])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(made), self.flat.dtype)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made))])
            self.asked = np.concatenate([self.asked, np.zeros(len(made), np.int64)])
        self.asked[at] = self.turn
        return at

    def forget(self) -> None:
        kept = np.sort(np.argsort(self.asked, kind="stable")[len(self.asked) // 2 :])
        self.names = self.names.take(pa.array(kept))
        self.flat, self.sizes = gathered(self.flat, self.sizes, kept)
        self.asked = self.asked[kept]


class Encoder:
    """Ids of texts as the tokenizers library gives them, piece by piece between white space, which the vocabulary drops. What pieces and words give is remembered, within a bound."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.code, self.kind = ("H", "<u2") if self.width == 2 else ("I", "<u4")
        self.specials = tuple(x["content"] for x in spec.get("added_tokens", []))
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.spaced = normal == NORMALIZERS and splits == [WORD_SPLIT] and all("<" in x for x in self.specials)
        self.findall = regex.compile(WORD_SPLIT).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.shown = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.tokenize = self.tokenizer.model.tokenize
        self.memory = Memory(self.ids, self.kind)

    def word(self, w: str) -> list[int]:
        """Ids of one match of the splitting pattern, in small letters."""
        return [t.id for t in self.tokenize(w if w.isascii() else "".join([self.shown[b] for b in w.encode()]))]

    def ids(self, piece: str) -> list[int]:
        """Ids of what stands between two spaces, or of a part of it that is whole matches of the pattern."""
        if "<" not in piece or not any(s in piece for s in self.specials):
            low = piece.lower()
            if len(low) == len(piece) and PLAIN.fullmatch(piece):  # other white space and controls are the library's
                return self.word(low) if low.isalpha() else [i for w in self.findall(low) for i in self.word(w)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one text after the other; where each begins, and the end). Distinct pieces are found, made small and parted from the marks behind them as arrays."""
        if not self.spaced:
            found = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for x in found for i in x], self.kind), np.cumsum([0, *map(len, found)])
        parted = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        seen = parted.flatten().dictionary_encode()
        pieces = seen.dictionary
        low = pc.utf8_lower(pieces)
        core = pc.utf8_rtrim(low, TAIL)
        simple = pc.and_(pc.and_(pc.utf8_is_alpha(core), pc.equal(pc.utf8_length(low), pc.utf8_length(pieces))), pc.match_substring_regex(pieces, f"^{PLAIN.pattern}$"))
        first = pc.if_else(simple, core, pieces).dictionary_encode()
        cut = np.where(simple.to_numpy(zero_copy_only=False), pc.binary_length(low).to_numpy() - pc.binary_length(core).to_numpy(), 0)
        rows = [np.flatnonzero(cut == k) for k in np.unique(cut) if k]
        marks = pa.chunked_array([pc.utf8_slice_codeunits(low.take(pa.array(x)), -int(cut[x[0]])) for x in rows], pa.string()).combine_chunks().dictionary_encode()

        keys = pa.chunked_array([first.dictionary, marks.dictionary, pa.array([""])]).combine_chunks().dictionary_encode()
        at = self.memory.find(keys.dictionary)[keys.indices.to_numpy()]
        units = np.full((len(pieces), 2), at[-1])
        units[:, 0] = at[first.indices.to_numpy()]
        if rows:
            units[np.concatenate(rows), 1] = at[len(first.dictionary) + marks.indices.to_numpy()]
        own, sizes = gathered(self.memory.flat, self.memory.sizes, units.reshape(-1))
        ids, sizes = gathered(own, sizes.reshape(-1, 2).sum(1), seen.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = parted.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of flat that `which` names, one after the other; their sizes). sizes: those of all runs of flat, in order."""
    n = sizes[which]
    ends = np.cumsum(n)
    starts = (np.cumsum(sizes) - sizes)[which]
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n)], n


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GROUP bytes."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > GROUP:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array of texts of about GROUP bytes; a longer text alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + GROUP, "right")))
        yield texts.slice(start, end - start)
        start = end


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 2) -> None:
    """Encode the texts and write the store. Null texts are empty; each row is a document, also repeated ones and null ids (which come first). Other columns are not read; of an empty table the store is empty."""
    spark = docs.sparkSession
    file = c.tokenizer_file("word_bpe_49k.json", vocabulary)
    id_name = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = c.kept(("ids", file), lambda: Encoder(file))
        end = np.array([] if end_id is None else [end_id], e.kind)
        part, made = TaskContext.get().partitionId(), 0
        for b in pooled(batches):
            keys, datas, ns, hashes, roots, row = [], [], [], [], [], []
            encoded = ((ids, k, m) for ids, at in map(e.encode, groups(b.column(1))) for k, m in itertools.pairwise(at.tolist()))
            for i, (found, k, m) in enumerate(encoded):
                ids = np.concatenate([found[k:m], end])
                raw = ids.tobytes()
                own, last = [], 0
                for x in cuts(ids):
                    data = raw[last * e.width : x * e.width]
                    h = hashlib.sha256(data).digest()
                    own.append(h)
                    keys.append(h)
                    datas.append(data)
                    row.append(None)
                    last = x
                keys.append(part.to_bytes(8, "big") + made.to_bytes(8, "big"))
                made += 1
                datas.append(None)
                row.append(i)
                ns.append(len(ids))
                hashes.append(own)
                roots.append(merkle(own))
            at = pa.array(row, pa.int64())
            docs_of = [pa.array(x, t).take(at) for x, t in ((ns, pa.int64()), (hashes, pa.list_(pa.binary())), (roots, pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(["chunk" if x is None else "recipe" for x in row], pa.string()), pa.array(keys, pa.binary()), pa.array(datas, pa.binary()), b.column(0).take(at), *docs_of], names=["kind", "key", "data", "id", "n", "hashes", "root"])

    rows = c.map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"kind string, key binary, data binary, id {id_name}, n long, hashes array<binary>, root binary")
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    made = c.scratch_path(spark, "encoded")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(made)
    made_rows = spark.read.schema(rows.schema).parquet(made)
    unique_chunks(made_rows.filter("kind = 'chunk'").select("key", "data", "place")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = made_rows.filter("kind = 'recipe'").select("key", "id", "n", "hashes", "root")
    placed = c.written(recipes.repartitionByRange(F.col("id").asc_nulls_first(), "key").sortWithinPartitions(F.col("id").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id()), "recipes")
    c.delete_path(spark, made)
    sums = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("n")).collect()}  # a row for each part
    starts, total = [], 0
    for p in sorted(sums):
        starts.append((p, total))
        total += sums[p]
    base = spark.createDataFrame(starts, "part int, base long")
    before = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, -1)
    placed.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).drop("base").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(spark, path).write.parquet(f"{path}/manifest")
    root_of(spark.read.parquet(f"{path}/manifest").collect(), spark, Encoder(file).width).coalesce(1).write.parquet(f"{path}/root")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """(key, data) of chunks (key, data, place), each key once. Keys and places alone are aggregated; data moves only if the repeated ones are too many to broadcast."""
    first = chunks.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("times")).filter("times > 1").select("key", "first")
    again = c.written(chunks.select("key", "place").join(c.broadcast_if_small(c.written(first, "repeated"), 24), "key").filter("place <> first").select("place"), "again")
    return chunks.join(c.broadcast_if_small(again, 16), "place", "left_anti").select("key", "data")


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_docs, n_ids, start, root): root is the Merkle root of the part's documents in order, from their own."""
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "start", "n", "root").repartition("part").sortWithinPartitions("part", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, start: int, n: int, roots: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (len(roots), pa.int64()), (n, pa.int64()), (start, pa.int64()), (merkle(roots), pa.binary()))], names=["part", "n_docs", "n_ids", "start", "root"])

        open_part, start, n, roots = None, 0, 0, []
        for b in batches:
            for p, s, k, r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if p != open_part:
                    if roots:
                        yield out(open_part, start, n, roots)
                    open_part, start, n, roots = p, s, 0, []
                n += k
                roots.append(r)
        if roots:
            yield out(open_part, start, n, roots)

    return c.map_arrow(recipes, run, "part int, n_docs long, n_ids long, start long, root binary")


def root_of(manifest: list, spark: SparkSession, width: int) -> DataFrame:
    """One row over the manifest's rows, of which there is one a part: (n_parts, n_docs, n_ids, root, width)."""
    own = sorted(tuple(r) for r in manifest)
    leaves = [hashlib.sha256(repr((r[0], r[1], r[2], r[3], bytes(r[4]))).encode()).digest() for r in own]
    return spark.createDataFrame([(len(own), sum(r[1] for r in own), sum(r[2] for r in own), bytearray(merkle(leaves)), width)], "n_parts long, n_docs long, n_ids long, root binary, width int")


def verify_store(spark: SparkSession, path: str) -> list[str]:
    """What the manifest and the root say that recipes and manifest don't: nothing, if all are whole. Documents and chunks are verified as they are read."""
    manifest, made = ({r["part"]: tuple(r) for r in df.collect()} for df in (spark.read.parquet(f"{path}/manifest"), manifest_of(spark, path)))  # a row for each part
    faults = [f"part {p} is not what the manifest says" for p in sorted({*manifest, *made}) if manifest.get(p) != made.get(p)]
    roots = spark.read.parquet(f"{path}/root").collect()
    if len(roots) != 1 or tuple(root_of(list(manifest.values()), spark, roots[0]["width"]).first()) != tuple(roots[0]):
        faults.append("the manifest is not what the root says")
    return faults


def opened(spark: SparkSession, path: str) -> int:
    """Bytes of an id in a store whose manifest and recipes are whole; else an error."""
    if faults := verify_store(spark, path):
        raise ValueError(f"{path}: " + "; ".join(faults[:20]))
    return spark.read.parquet(f"{path}/root").first()["width"]


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, data binary").parquet(f"{path}/chunks")


def checked(key: bytes, data: bytes) -> bytes:
    if hashlib.sha256(data).digest() != key:
        raise ValueError(f"chunk {key.hex()} does not hold what its name says")
    return data


def references(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select(F.col("key").alias("doc"), F.posexplode("hashes").alias("i", "key"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids): every document put together from its chunks, each verified. An empty store gives no rows; a document's ids are held by one task."""
    width = opened(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, root, hashes, pieces in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                data = b"".join(checked(h, p["data"]) for h, p in zip(hashes, pieces or [], strict=True))
                if merkle(hashes) != root or len(data) != n * width:
                    raise ValueError("a document does not follow its recipe")
                ids.append(np.frombuffer(data, f"<u{width}").astype("<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["id", "start", "n_tokens", "ids"])

    pieces = references(spark, path).join(chunks_of(spark, path), "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("pieces"))
    rows = recipes.join(pieces.withColumnRenamed("doc", "key"), "key", "left").select("id", "start", "n", "root", "hashes", "pieces")
    return c.map_arrow(rows, whole, f"id {recipes.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the files: each unique chunk is read, verified and summed once; a document's checksum comes from its chunks' by the rule that a checksum's start and the data add up. Null ids stand first, as written; an empty store gives no rows; a long document is a long recipe, its ids are not gathered."""
    width = opened(spark, path)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.frombuffer(checked(k, d), f"<u{width}").astype("<u4") for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.crc32(x.tobytes()) for x in whole], pa.int64()), pa.array([len(x) for x in whole], pa.int64())], names=["key", "crc", "n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = memoryview(bytes(4 * MOST))
        for b in batches:
            out = []
            for n, root, hashes, pieces in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                pieces = pieces or []
                crc = 0
                for p in pieces:
                    z = zeros[: 4 * p["n"]]
                    crc = zlib.crc32(z, crc) ^ zlib.crc32(z) ^ p["crc"]
                if merkle(hashes) != root or len(pieces) != len(hashes) or sum(p["n"] for p in pieces) != n:
                    raise ValueError("a document does not follow its recipe")
                out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    sums = c.map_arrow(chunks_of(spark, path), summed, "key binary, crc long, n long")
    pieces = references(spark, path).join(sums, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "crc", "n"))).alias("pieces"))
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = recipes.join(pieces.withColumnRenamed("doc", "key"), "key", "left").select("id", "start", "n", "root", "hashes", "pieces")
    return c.map_arrow(rows, joined, f"id {recipes.schema['id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
