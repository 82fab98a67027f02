"""Fixity audit of archive replicas with Merkle trees over record offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import Scratch

#: Bytes of an archive that a lowest range covers, and how many ranges make one of the next level.
SPAN, FANOUT = 1 << 16, 16


def leaves(records: DataFrame, file_col: str, offset_col: str, payload_col: str) -> DataFrame:
    """(file, at, size, copies, digest): one row per offset of a file.

    The digest is the SHA-256 of the payload; a null payload is empty. Several records at one offset are
    combined by count and sums of their digests' quarters, which need no order and are partial sums before the
    shuffle, however many there are.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    one = records.select(F.col(file_col).cast("string").alias("file"), F.col(offset_col).cast("long").alias("at"),
                         F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    part = lambda i: F.sum(F.conv(F.substring("digest", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)"))
    merged = one.groupBy("file", "at").agg(F.max("size").alias("size"), F.count("*").alias("copies"),
                                           F.min("digest").alias("digest"), F.max("digest").alias("other"),
                                           *[part(i).alias(f"p{i}") for i in range(4)])
    several = F.sha2(F.concat_ws(":", F.col("copies"), *[F.col(f"p{i}") for i in range(4)]), 256)
    return merged.select("file", "at", "size", "copies",
                         F.when(F.col("copies") == 1, F.col("digest")).otherwise(several).alias("digest"))


def _ordered_digest(order: Column) -> Column:
    """SHA-256 over the children of a node in order: position, then digest."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat_ws(
        ":", x["at"], x["digest"])), ","), 256)


def tree(leaf: DataFrame, height: int, scratch: Scratch, name: str, span: int = SPAN,
         fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (file, idx, digest) of each level, lowest first; the last has one node, the root, per file.

    A node of level l covers the offsets [idx, idx + 1) times span * fanout^l. It has at most ``span`` children
    on the lowest level, as offsets are whole numbers, and ``fanout`` above, so no group grows with the data.
    """
    levels = []
    low = leaf.groupBy("file", F.floor(F.col("at") / span).alias("idx")).agg(
        _ordered_digest(F.struct("at", "digest")).alias("digest"))
    levels.append(scratch.write(low, f"{name}_0"))
    for level in range(1, height):
        above = levels[-1].groupBy("file", F.floor(F.col("idx") / fanout).alias("up")).agg(
            _ordered_digest(F.struct(F.col("idx").alias("at"), F.col("digest"))).alias("digest"))
        levels.append(scratch.write(above.withColumnRenamed("up", "idx"), f"{name}_{level}"))
    return levels


def _both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _both(a, b, keys).where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))


def audit(replica_a: DataFrame, replica_b: DataFrame, file_col: str = "file", offset_col: str = "at",
          payload_col: str = "payload", span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Offsets at which two replicas differ: file, at, kind (changed | missing | extra | unplaced), size_a, size_b, digest_a,
    digest_b, copies_a, copies_b.

    Each replica is hashed into one tree per file. Roots are compared first; then, level by level, only the
    children of nodes that differ, and at last the records of ranges that differ. "missing" is in a only.

    A null file is a file of its own. Records with a null or negative offset have no place in a tree; they come back
    as "unplaced", one row per file and such offset with what either replica has there, equal or not. Records repeated at one
    offset are one leaf, ``copies`` says how many. Two empty replicas have no differences; other columns are ignored.
    """
    scratch = Scratch(replica_a.sparkSession, "merkle")
    sides, unplaced, top = [], [], 0
    for name, records in (("a", replica_a), ("b", replica_b)):
        leaf, seen = scratch.write_observed(
            leaves(records, file_col, offset_col, payload_col), f"leaf_{name}", top="max(at)")
        top = max(top, seen["top"] or 0)
        sides.append(leaf.where("at >= 0"))
        unplaced.append(leaf.where("at IS NULL OR at < 0"))
    height, reach = 1, span
    while reach <= top:
        height, reach = height + 1, reach * fanout
    a, b = (tree(leaf, height, scratch, f"tree_{n}", span, fanout) for n, leaf in zip("ab", sides))
    pick = lambda x, key: x.select(F.coalesce("a.file", "b.file").alias("file"),
                                   F.coalesce(f"a.{key}", f"b.{key}").alias(key))
    suspects = pick(_differing(a[-1], b[-1], ["file", "idx"]), "idx")
    below = lambda nodes, bad, up: nodes.alias("n").join(
        bad.alias("s"), F.col("n.file").eqNullSafe(F.col("s.file")) & (up == F.col("s.idx")), "left_semi")
    for level in range(height - 2, -1, -1):
        up = F.floor(F.col("n.idx") / fanout)
        suspects = scratch.write(suspects, f"suspects_{level + 1}")  # both sides read them
        suspects = pick(_differing(below(a[level], suspects, up), below(b[level], suspects, up), ["file", "idx"]), "idx")
    suspects = scratch.write(suspects, "suspects_0")
    up = F.floor(F.col("n.at") / span)
    found = _differing(below(sides[0], suspects, up), below(sides[1], suspects, up), ["file", "at"])
    lost = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("changed")
    return _told(found, lost).union(_told(_both(*unplaced, ["file", "at"]), F.lit("unplaced")))


def _told(both: DataFrame, kind: Column) -> DataFrame:
    return both.select(
        F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.at", "b.at").alias("at"), kind.alias("kind"),
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("size", "digest", "copies") for side in "ab"])
