"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius r gets 2^(r+1) - 1 bit masks: each of the 64 bit places has a vector of r+1 bits, and mask v keeps the places whose
vector has an odd inner product with v. Any r places leave a v that is even with all of them, so two fingerprints that
differ in at most r places agree on all bits that some mask keeps: no pair within the radius is missed.

Equal fingerprints are one node. Inside a bucket no pairs are made: its fingerprints, in chunks, are searched for links
breadth-first and only a spanning forest leaves it. A bucket beyond a chunk is dealt out as pairs of chunks, so every pair
of its fingerprints still meets. Components are found by large-star/small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BITS = 64
#: Fingerprints of a bucket that meet in one task; two chunks at most.
CHUNK = 2048
PIECE = 1 << 14


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; of the whole sequence if it is shorter; 0 without words."""
    w = c.utf8(text).translate(c.LOWER_TABLE).split()
    if not w:
        return 0
    line = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(line, seed)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()[shingle - 1 :]
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes already made: a bit is 1 if more than half of them have it; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64())], names=["id", "fp"])

    return c.map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed longs. The places' vectors go round all nonzero ones, so each mask keeps about half the places."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(root, point) for each point linked to a root, over the graph of points within the radius. A point leaves the search once it is reached."""
    out = []
    rest = np.unique(points)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                out += [(int(root), int(x)) for x in found]
    return out


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all within the radius, directly or through others."""
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])).alias("t", "key"))
    crowded = keys.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n")
    met = keys.join(crowded, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = met.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    dealt = dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list[np.ndarray]) -> pa.RecordBatch:
            found = list({e for g in groups for e in forest(g, radius)})
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        open_key, open_rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            fp = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            groups = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[:, s].tolist())
                if key != open_key:
                    if open_rows:
                        groups.append(np.concatenate(open_rows))
                    open_key, open_rows = key, []
                open_rows.append(fp[s:e])
            yield out(groups)
        if open_rows:
            yield out([np.concatenate(open_rows)])

    return c.map_arrow(dealt, run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has a link. Large-star and small-star rounds until nothing changes."""
    edges = c.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges = c.written(small.filter("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable through links).

    Null and wordless texts have fingerprint zero and link like others. A null id stays null and is never a component_id
    unless no document reachable has one. Repeated rows give repeated results; other columns are not read; an empty table
    gives no rows.
    """
    fps = c.written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = c.written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(links(nodes.select("fp"), radius))
    owned = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of = c.written(owned.join(c.broadcast_if_small(first, 32), "root").select("fp", "component_id"), "components")
    out = fps.join(c.broadcast_if_small(of, 32), "fp")  # beyond that, crowded fingerprints are split by the join
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
