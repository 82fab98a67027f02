"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.components import components
from lacuna.llm.text import encode, texts_of
from lacuna.session import Scratch

BITS = 64
#: A bucket of up to so many different fingerprints is compared in one piece; a larger one is cut by further blocks.
BUCKET = 2048


def simhash(text: str | bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text: bit b is set if it is set in over half of the shingles' hashes."""
    words = (text if isinstance(text, bytes) else encode(text)).lower().split()
    if not words:
        return 0
    take = min(shingle, len(words))
    body = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    digest, begins, ends = xxhash.xxh64_digest, np.r_[0, stops[:-1]].tolist(), (stops[take - 1:] - 1).tolist()
    total, n = np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, 65536):  # a very long text needs no more memory than its words
        raw = b"".join([digest(body[s:e], seed) for s, e in zip(begins[at:at + 65536], ends[at:at + 65536])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType

    def run(parts):
        for part in parts:
            codes = np.array([simhash(t, shingle) for t in texts_of(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(free: list[int], blocks: int, distance: int) -> list[int]:
    """Masks such that fingerprints differing in up to ``distance`` of the free bits agree under one of them at least.

    The free bits are cut into ``blocks`` blocks. Differing bits touch ``distance`` blocks at most, so all the
    others agree: one mask for each choice of blocks - distance blocks.
    """
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in free[cuts[i]:cuts[i + 1]]) for i in range(blocks)]
    return sorted({sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)})


def choose_blocks(n: int, distance: int) -> int:
    """The least number of blocks whose masks hold log2(n) bits or more, so that a mean bucket stays of size one."""
    blocks = distance + 1
    while blocks < distance + 8 and BITS * (blocks - distance) // blocks < log2(max(n, 2)):
        blocks += 1
    return blocks


def bucket_links(values: list[int], distance: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``distance`` bits in one bucket: one for each fingerprint but a root each."""
    if len(values) == 2:
        a, b = values
        return [(a, b)] if ((a ^ b) & (1 << BITS) - 1).bit_count() <= distance else []
    codes = np.array(values, np.int64).view(np.uint64)
    left, out = np.arange(len(codes)), []
    while len(left):
        root, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            near = np.zeros(len(left), bool)
            for k in wave:
                near |= np.bitwise_count(codes[left] ^ codes[k]) <= distance
            wave, left = left[near], left[~near]
            out += [(values[root], values[int(k)]) for k in wave]
    return out


def near_links(codes: DataFrame, scratch: Scratch, n: int, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``codes`` (fp, all different) at ``distance`` bits or fewer.

    Pairs meet in a bucket: the fingerprints that agree under one of the block masks. Buckets are counted
    before anything is gathered. One with more than ``bucket`` fingerprints is dealt out again: under its
    mask all agree, so the remaining bits are cut into blocks by the same pigeonhole rule. Each pass fixes
    more bits, and under 64 - log2(bucket) fixed bits no bucket can be larger, so nothing is capped. A
    bucket yields links that span what is connected in it, not all of its pairs.
    """
    spark, level, tables = codes.sparkSession, 0, []
    masks = [(0, m) for m in block_masks(list(range(BITS)), choose_blocks(n, distance), distance)]
    pending = codes.select("fp", F.lit(0).cast("long").alias("mask"))

    def run(parts):
        for part in parts:
            pairs = [x for values in part.column(0).to_pylist() for x in bucket_links(values, distance)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)],
                                             names=["a", "b"])

    while masks:
        plan = {}
        for old, new in masks:
            plan.setdefault(_signed(old), []).append(_signed(new))
        if len(plan) == 1:
            dealt = pending.select("fp", F.explode(F.array(*[F.lit(m) for m in next(iter(plan.values()))])).alias("m"))
        else:  # the masks depend on the bits fixed so far only, not on the data: a table of bounded size
            table = spark.createDataFrame([(k, m) for k, v in plan.items() for m in v], "mask bigint, m bigint")
            dealt = pending.join(table, "mask").select("fp", "m")
        keyed = dealt.select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
        many = scratch.write(keyed.groupBy("m", "k").agg(F.count("*").alias("size")).where("size > 1"),
                             f"sizes_{level}")
        small = keyed.join(many.where(F.col("size") <= bucket), ["m", "k"]).groupBy("m", "k").agg(
            F.collect_list("fp").alias("fps"))
        tables.append(scratch.write(small.select("fps").mapInArrow(run, "a bigint, b bigint"), f"links_{level}"))
        large = [r["m"] for r in many.where(F.col("size") > bucket).select("m").distinct().collect()]
        masks = []
        for m in large:  # one entry for each mask, never for each bucket
            free = [b for b in range(BITS) if not m >> b & 1]
            blocks = min(len(free), distance + 4)
            unsigned = m & (1 << BITS) - 1
            masks += [(unsigned, unsigned | x) for x in block_masks(free, blocks, distance)]
        if masks:
            pending = keyed.join(many.where(F.col("size") > bucket), ["m", "k"]).select("fp", F.col("m").alias("mask"))
            pending = scratch.write(pending, f"pending_{level}")
        level += 1
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4,
                    shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id.

    Texts are lower-cased (A-Z) and cut at white space; a fingerprint is the majority over the XXH64 of all
    shingles of ``shingle`` words. Fingerprints link at ``distance`` differing bits or fewer; ``component_id`` is
    the smallest id that can be reached. Equal fingerprints are one node, so copies cost one row each.

    A null or wordless text has fingerprint 0 and links like any other. Repeated rows are kept, rows with one
    id and different texts stand for themselves, a null id is reached but never the smallest (a component of
    null ids only has a null ``component_id``). Empty tables give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes, seen = scratch.write_observed(table.groupBy("fp").agg(F.min("id").alias("least")), "nodes", n="count(1)")
    links = near_links(nodes.select("fp"), scratch, seen["n"], distance, bucket)
    labels = scratch.write(components(links, scratch, "stars"), "labels")
    joined = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        nodes["fp"], "least", F.coalesce("label", nodes["fp"]).alias("label"))
    # Only nodes with a link need the smallest id of their component; the others have their own.
    lowest = joined.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("component_id"))
    final = scratch.write(joined.join(lowest, "label").select(F.col("fp").alias("node_fp"), "component_id"), "classes")
    return table.join(final, table["fp"] == final["node_fp"]).select("id", "fp", "component_id")
