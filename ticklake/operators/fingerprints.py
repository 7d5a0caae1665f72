"""Content fingerprints of row groups, and the guard against evaluating on the same held-out rows twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, key: str, columns: tuple[str, ...], block: int = 10_000) -> DataFrame:
    """SHA-256 of each group: of the digests of its blocks of rows, joined by ',', in order.

    A block has the rows whose first column, a whole number, is the same when divided by block; its digest is that of
    its rows (columns joined by ':', rows by ',' in the columns' order). So no value holds more than a block or the
    digests of a group's blocks.
    """
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in columns))
    joined = lambda cells: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["_t"]), ",").cast("binary"), 256)
    at = F.floor(F.col(columns[0]) / block).alias("_block")
    blocks = rows.groupBy(key, at).agg(F.count(F.lit(1)).alias("_k"), joined(F.struct(*columns, text.alias("_t"))).alias("_d"))
    return blocks.groupBy(key).agg(F.sum("_k").alias("n"), joined(F.struct("_block", F.col("_d").alias("_t"))).alias("fingerprint"))


def block_fingerprint(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """An order-free fingerprint of each group by sums of row hashes: groups of any size are aggregated in parts."""
    h = F.xxhash64(*columns)
    parts = [F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("_a"), F.sum(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(998_244_353))).alias("_b"), F.count(F.lit(1)).alias("n")]
    return rows.groupBy(key).agg(*parts).select(key, "n", F.sha2(F.concat_ws(":", "n", "_a", "_b").cast("binary"), 256).alias("fingerprint"))


def reused(current: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows of current whose fingerprint some earlier report already has."""
    return current.join(reports.select("fingerprint").distinct(), "fingerprint", "left_semi")


def require_fresh(current: DataFrame, reports: DataFrame) -> DataFrame:
    """current, unless a held-out part of it was evaluated before."""
    if not reused(current, reports).isEmpty():
        raise ValueError("these held-out rows were already evaluated by an earlier report")
    return current


def duplicate_content(files: DataFrame) -> DataFrame:
    """Contents (path, content as of the binaryFile source) that stand under more than one path: digest, paths."""
    return files.groupBy(F.sha2("content", 256).alias("digest")).agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
