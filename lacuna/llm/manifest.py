"""A Merkle manifest of a dataset: bitmap ranks place the leaves of each group, slot arrays reduce them to one root."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.index import dense_position
from lacuna.session import Scratch

#: Children of a node, and the levels that are reduced at a time: a block has FANOUT ** levels slots.
FANOUT, LEVELS = 16, 3
#: The word of a null id: before all others.
_NO_ID = -(1 << 60)


def digest(fields: list[str], current: dict[str, Column] | None = None) -> Column:
    """SHA-256 (binary) over the fields of a row: ``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    parts = []
    for name in fields:
        value = (current or {}).get(name, F.col(f"`{name}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _before(counts: DataFrame, within: list[str], levels: list[str]) -> DataFrame:
    """``counts`` (within, levels, n) with ``before``: the sum of n over the rows of lower levels.

    A directory of one tier per level: each sorts only the entries below one entry of the tier above.
    """
    order = Window.partitionBy(*within).orderBy(levels[0]).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long")
    if len(levels) == 1:
        return counts.withColumn("before", base)
    keys = [*within, levels[0]]
    tier = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, base.alias("base"))
    return _before(counts, keys, levels[1:]).join(tier, keys).withColumn("before", F.expr("before + base")).drop("base")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the task (part) and how many rows with the same keys the task had before (nth)."""
    at = [rows.columns.index(k) for k in keys]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts):
        task, seen = TaskContext.get().partitionId(), {}
        for part in parts:
            nth = []
            for key in zip(*[part.column(i).to_pylist() for i in at]):
                nth.append(seen.get(key, 0))
                seen[key] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(nth), task)), pa.array(nth, pa.int64())],
                                             names=[*part.schema.names, "part", "nth"])

    return rows.mapInArrow(run, f"{fields}, part bigint, nth bigint")


def ranked(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (grp, id, leaf, ...) with ``slot``, the number of leaves before it in its group; and (grp, total).

    Ids of a group are bits of a compressed bitmap: its words that are not empty, merged from all tasks by a bitwise or,
    with the number of leaves before each word as a directory. The rank of an id is its word's entry and the set bits
    below its own. No leaf is sorted, and the directory is built in tiers of at most 2^20 entries.

    Ids that repeat in a group are the exception. Their words are ranked by counts instead: of id, digest and task,
    and the number within the task tells equal rows apart.
    """
    word = F.coalesce(F.shiftright("id", 6), F.lit(_NO_ID))
    bit = F.expr("CASE WHEN id IS NULL THEN 0L ELSE shiftleft(1L, cast(id & 63 AS int)) END")
    leaves = leaves.withColumn("word", word)
    words, seen = scratch.write_observed(
        leaves.groupBy("grp", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")).select(
            "*", F.shiftright("word", 20).alias("up"), F.shiftright("word", 40).alias("top"),
            F.expr("n > greatest(bit_count(bits), 1)").alias("tied")),
        "words", tied="count_if(tied)")
    totals = words.groupBy("grp").agg(F.sum("n").alias("total"))
    directory = scratch.write(_before(words, ["grp"], ["top", "up", "word"]).select("grp", "word", "bits", "before", "tied"),
                              "directory")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 AS int)))")
    placed = leaves.join(directory, ["grp", "word"])
    once = placed.where("NOT tied").withColumn(
        "slot", F.when(F.col("id").isNull(), F.col("before")).otherwise(F.col("before") + below))
    own = [c for c in leaves.columns if c != "word"]
    if not seen["tied"]:
        return once.select(*own, "slot"), totals
    rows = leaves.join(directory.where("tied").select("grp", "word", F.col("before").alias("base")), ["grp", "word"])
    rows = scratch.write(_numbered(rows, ["grp", "id", "leaf"]), "tied")
    keys = rows.select("*", F.coalesce("id", F.lit(_NO_ID)).alias("name"), F.substring("leaf", 1, 2).alias("head"))
    levels = ["name", "head", "leaf", "part"]
    counts = keys.groupBy("grp", "word", *levels).agg(F.count("*").alias("n"))
    several = keys.join(_before(counts, ["grp", "word"], levels).drop("n"), ["grp", "word", *levels])
    return once.select(*own, "slot").union(
        several.withColumn("slot", F.expr("base + before + nth")).select(*own, "slot")), totals


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def _levels(slots: list[str], n: int, levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """Each level of a block of a tree of ``n`` nodes: (digests, joined runs); the last has one digest and no runs."""
    for _ in range(min(levels, _height(n))):
        runs = ["".join(slots[i:i + FANOUT]) for i in range(0, len(slots), FANOUT)]
        yield slots, runs
        slots = [_hash(run) for run in runs]
    yield slots, []


def _siblings(nodes: list[tuple[list[str], list[str]]], slot: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of a slot's node in its run, level by level."""
    for _, runs in nodes[:-1]:
        up, k = divmod(slot, FANOUT)
        yield runs[up][:64 * k], runs[up][64 * k + 64:]
        slot = up


def _slots(at: list[int], digests: list[bytes]) -> list[str]:
    slots = [""] * len(at)
    for k, d in zip(at, digests):
        slots[k] = d.hex()
    return slots


def _blocks(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """(grp, block, total, entries): the slots of each block, at most ``size``."""
    return nodes.groupBy("grp", F.expr(f"slot div {size}").alias("block")).agg(
        F.max("total").alias("total"), F.collect_list(F.struct((F.col("slot") % size).cast("int").alias("at"), "leaf", *more)).alias("entries"))


def _reduced(blocks: DataFrame, levels: int) -> DataFrame:
    """The nodes above the blocks: (grp, slot, total, leaf)."""
    def run(parts):
        for part in parts:
            grp, block, total, at, leaf = part.columns
            out, nexts = [], []
            for r in range(part.num_rows):
                n = total[r].as_py()
                *_, (slots, _) = _levels(_slots(at[r].as_py(), leaf[r].as_py()), n, levels)
                out.append(bytes.fromhex(slots[0]))
                nexts.append(-(-n // FANOUT ** levels))
            yield pa.RecordBatch.from_arrays([grp, block, pa.array(nexts, pa.int64()), pa.array(out, pa.binary())],
                                             names=["grp", "slot", "total", "leaf"])

    return blocks.select("grp", "block", "total", "entries.at", "entries.leaf").mapInArrow(
        run, "grp string, slot bigint, total bigint, leaf binary")


def _paths(blocks: DataFrame, levels: int) -> DataFrame:
    """(grp, slot, path) of the nodes in the blocks, from the ``path`` of each: pairs of what stands left and right."""
    def run(parts):
        for part in parts:
            grp, block, total, at, leaf, path = part.columns
            row, slot, out = [], [], []
            for r in range(part.num_rows):
                slots = _slots(at[r].as_py(), leaf[r].as_py())
                nodes, above = list(_levels(slots, total[r].as_py(), levels)), path[r].as_py()
                for k in range(len(slots)):
                    row.append(r)
                    slot.append(block[r].as_py() * FANOUT ** levels + k)
                    out.append([x for pair in _siblings(nodes, k) for x in pair] + above)
            yield pa.RecordBatch.from_arrays([grp.take(pa.array(row, pa.int64())), pa.array(slot, pa.int64()),
                                              pa.array(out, pa.list_(pa.string()))], names=["grp", "slot", "path"])

    return blocks.select("grp", "block", "total", "entries.at", "entries.leaf", "path").mapInArrow(
        run, "grp string, slot bigint, path array<string>")


def _climb(blocks: DataFrame, levels: int, scratch: Scratch, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (grp, leaf) of all trees, and the blocks of each round, lowest first."""
    rounds = [blocks]
    while True:
        nodes, seen = scratch.write_observed(_reduced(rounds[-1], levels), f"{name}_{len(rounds)}", most="max(total)")
        if (seen["most"] or 1) <= 1:
            return nodes.select("grp", "leaf"), rounds
        rounds.append(scratch.write(_blocks(nodes, FANOUT ** levels), f"{name}_blocks_{len(rounds)}"))


def _descend(rounds: list[DataFrame], top: DataFrame, levels: int, scratch: Scratch, name: str) -> DataFrame:
    """(grp, block, path) of the lowest blocks, given the ``path`` of each tree's root."""
    paths = top.select("grp", F.lit(0).cast("long").alias("block"), "path")
    for k in range(len(rounds) - 1, 0, -1):
        paths = scratch.write(_paths(rounds[k].join(paths, ["grp", "block"]), levels), f"{name}_paths_{k}").withColumnRenamed("slot", "block")
    return paths


def _audited(blocks: DataFrame, root: str, levels: int) -> DataFrame:
    names = ["doc_id", "leaf", "proof_sha256", "folded_root", "verified"]

    def run(parts):
        for part in parts:
            grp, total, path, at, ids, leaf, seen = part.columns
            for r in range(part.num_rows):
                where, above = at[r].as_py(), path[r].as_py()
                slots = _slots(where, leaf[r].as_py())
                nodes, beyond = list(_levels(slots, total[r].as_py(), levels)), "".join(above)
                over = list(zip(above[::2], above[1::2]))
                proofs, folds = [], []
                for k, now in zip(where, seen[r].as_py()):
                    beside = list(_siblings(nodes, k))
                    proofs.append(_hash("".join([x for pair in beside for x in pair]) + beyond))
                    node = now.hex()
                    for left, right in beside + over:
                        node = _hash(left + node + right)
                    folds.append(node)
                n = len(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(grp[r], n), ids[r].values, pa.array([slots[k] for k in where], pa.string()), pa.array(proofs, pa.string()),
                     pa.array(folds, pa.string()), pa.array([f == root for f in folds], pa.bool_())], names=["grp", *names])

    return blocks.select("grp", "total", "path", "entries.at", "entries.id", "entries.leaf", "entries.seen").mapInArrow(
        run, "grp string, doc_id bigint, leaf string, proof_sha256 string, folded_root string, verified boolean")


def build(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
          changed: Column | None = None, current: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: grp, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the ``digest`` of a row's ``fields``. The leaves of a group (``group_col``) ascend by id; every 16
    consecutive nodes become the SHA-256 of their digests until one is left, the group's subroot (a lone leaf is that itself).
    The subroots, in the order of their groups' bytes, become the root likewise. ``proof_sha256`` hashes what is beside a leaf's
    path, level by level up to the root, each level left to right. An audit then recomputes the root: from the row as it is
    now, which is ``docs`` with the expressions ``current`` where ``changed`` holds, and the stored siblings.

    Each block of 4,096 slots is an array keyed by slot and reduced three ``levels`` at once, so leaves are shuffled to
    their blocks once, whatever the size of a group, and the levels above are 4,096 times smaller each. Only the root
    reaches the driver.

    A null group is a group of its own and the first; null ids are the first leaves of their group. Rows that repeat an id
    in a group are a leaf each, in the order of their digests; equal rows are interchangeable. Nulls in fields and
    empty texts differ. An empty table gives no rows; ids must be whole numbers; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), group.alias("grp"), digest(fields).alias("leaf"),
                       F.when(F.lit(False) if changed is None else changed, digest(fields, current)).alias("seen"))
    leaves = scratch.write(rows, "leaves")
    slots, totals = ranked(leaves, scratch)
    slots = slots.withColumn("seen", F.coalesce("seen", "leaf"))
    blocks = scratch.write(_blocks(slots.withColumn("total", F.lit(0)), FANOUT ** levels, "id", "seen").drop("total").join(totals, "grp"), "blocks")
    subroots, rounds = _climb(blocks, levels, scratch, "nodes")
    groups = dense_position(subroots, ["grp"], "slot")
    groups = scratch.write(groups.crossJoin(subroots.agg(F.count("*").alias("total"))), "groups")
    top = scratch.write(_blocks(groups.select(F.lit("").alias("grp"), "slot", "total", "leaf"), FANOUT ** levels), "top_blocks")
    roots, above = _climb(top, levels, scratch, "top")
    root = "".join(r["leaf"].hex() for r in roots.take(1))  # none in an empty table
    start = roots.select("grp", F.array().cast("array<string>").alias("path"))
    of_blocks = _descend(above, start, levels, scratch, "top")
    of_groups = _paths(top.join(of_blocks, ["grp", "block"]), levels).select("slot", "path")
    of_groups = scratch.write(groups.select("slot", F.col("grp")).join(of_groups, "slot").select("grp", "path"), "group_paths")
    paths = _descend(rounds, of_groups, levels, scratch, "nodes")
    done = _audited(blocks.join(paths, ["grp", "block"]), root, levels)
    names = groups.select("grp", F.lower(F.hex("leaf")).alias("subroot"))
    return done.join(names, "grp").select(
        F.expr("CASE WHEN grp = '' THEN NULL ELSE substring(grp, 2) END").alias("grp"), "doc_id", "leaf", "subroot",
        F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")
