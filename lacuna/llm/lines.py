"""Lines that many documents share: all but the first holder lose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import Scratch

BLANK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    # \\z is the very end; $ would also match before a last line separator, which is not white space here.
    return F.translate(F.regexp_replace(line, f"^{BLANK}|{BLANK}\\z", ""), UPPER, LOWER)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                      min_docs: int = 2) -> DataFrame:
    """``docs`` with the text replaced, and n_lines and n_dropped added.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stays
    only in the smallest id that holds it. Other lines stay in order, joined by a newline.

    Keys are told apart by two 64-bit hashes. Distinct documents per key are counted by grouping (hash, id) and
    then hash, both combined before the shuffle, so that a line in a third of all documents is one partial
    row per task. Positions to drop are gathered per document, and only documents that lose a line carry any.

    A null or empty text is one empty line. A null id is one document, after all others in order. Rows that
    repeat an id are one document: all of them keep what their id keeps. A line repeated within its
    keeping document stays as often as it is there. Columns named n_lines or n_dropped are replaced; no other
    column is touched. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    one = "\n"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = rows.select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", one)).alias("pos", "line"))
    keys = lines.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars)
    keys = keys.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # Two documents need no distinct count: the smallest and the largest holder differ (a null differs from both).
    if min_docs <= 2:
        counted = keys.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"),
                                               F.max(F.col("id").isNull()).alias("nameless"))
        shared = counted.where("keeper < last OR (nameless AND keeper IS NOT NULL)" if min_docs == 2 else "true")
    else:
        counted = keys.groupBy("h1", "h2", "id").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(
            F.min("id").alias("keeper"), F.count("*").alias("docs"))
        shared = counted.where(F.col("docs") >= min_docs)
    shared = scratch.write(shared.select("h1", "h2", "keeper"), "shared")
    gone = keys.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "row").agg(
        F.collect_set("pos").alias("gone"))
    id_, row, lost, own, parts = (free_name(n, docs.columns) for n in ("gone_id", "gone_row", "gone_lines", "text_row", "split_lines"))
    gone = scratch.write(gone.select(F.col("id").alias(id_), F.col("row").alias(row), F.col("gone").alias(lost)), "gone")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.drop("n_lines", "n_dropped").withColumn(own, F.xxhash64(body))
    joined = held.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(row)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    return (joined.withColumn(parts, F.split(body, one))
            .withColumn(text_col, F.when(F.col(lost).isNull(), F.array_join(parts, one)).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get(parts, i)), one)))
            .withColumn("n_lines", F.size(parts).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size(lost), F.lit(0)).cast("long"))
            .select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"))
