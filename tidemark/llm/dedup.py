"""Exact deduplication with a Bloom filter of repeated hashes.

First pass: the texts are normalised and digested, and each partition puts its digests' hashes
into the blocks of a two-level Bloom filter: bits that were set once, bits that were set more
than once.  The blocks are merged by block number.  Second pass: a digest that the second level
doesn't hold certainly occurs once and passes straight through; only the others are shuffled and
grouped.

A filter is of bounded size and never fuller than it is made for: the hashes are divided into
ranges, as many as the rows ask for, and each range has both passes with a filter of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bloom import id_filter
from .shared import BLANK, attach, cut, packed, shared_folder

HASHES = 2
BITS_PER_ROW = 16
#: log2 of the bits in a block, and the most blocks of one filter, which makes 64 MiB for 33.5
#: million rows; more rows take more ranges.
BLOCK_BITS, MOST_BLOCKS = 16, 1 << 13


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII blanks as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " ")


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and, within it, the bits of each 64-bit hash."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    low = h & np.uint64(0xFFFFFFFFFF)
    bits = np.stack([(low >> np.uint64(20 * i)) & np.uint64((1 << BLOCK_BITS) - 1) for i in range(HASHES)])
    return block.astype(np.int64), bits.astype(np.int64)


def repeated_filter(hashes: DataFrame, blocks: int) -> np.ndarray:
    """The second level as one bit array per block; ``hashes`` has one long column.

    A batch gives, of each block it touches, the bits it set and those it set more than once;
    that is no more than the hashes themselves, and a block is merged from counts, so no task holds
    more than a block's bits.  What comes to the driver is bounded by MOST_BLOCKS.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _places(batch.column(0).to_numpy(), blocks)
            place, n = np.unique(np.concatenate([block << BLOCK_BITS | b for b in bits]), return_counts=True)
            names, starts = np.unique(place >> BLOCK_BITS, return_index=True)
            low, ends = (place & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), [*starts[1:].tolist(), len(place)]
            seen = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=False)]
            again = [low[a:b][n[a:b] > 1].tobytes() for a, b in zip(starts.tolist(), ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(seen, pa.binary()), pa.array(again, pa.binary())], ["block", "seen", "again"])

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
        for part in parts:
            for seen, again in zip(part["seen"], part["again"], strict=True):
                low = np.frombuffer(seen, np.uint16)
                twice[low[once[low]]] = True
                twice[np.frombuffer(again, np.uint16)] = True
                once[low] = True
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(twice).tobytes()]})

    partial = hashes.mapInArrow(rows, "block long, seen binary, again binary")
    merged = partial.groupBy("block").applyInPandas(merge, "block long, bits binary")
    out = np.zeros((blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in merged.toLocalIterator(prefetchPartitions=True):
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out


def blocks_for(n_rows: int) -> int:
    """Blocks in all; a filter holds MOST_BLOCKS of them at most."""
    return max(1, -(-n_rows * BITS_PER_ROW >> BLOCK_BITS))


def _tester(bits: Broadcast, blocks: int):
    @pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        block, places = _places(h.to_numpy(np.int64), blocks)
        found = np.ones(len(block), bool)
        for at in places:
            found &= (bits.value[block, at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pd.Series(found)

    return held


def may_repeat(digests: DataFrame) -> DataFrame:
    """digests (with ``_h``, a 64-bit hash; its lineage cut) with ``_again``: whether a hash may occur again."""
    n_blocks = blocks_for(digests.count())
    ranges = -(-n_blocks // MOST_BLOCKS)
    blocks = -(-n_blocks // ranges)
    ranged = digests.withColumn("_range", F.pmod(F.xxhash64("_h"), F.lit(ranges)).cast("int"))
    if ranges > 1:  # each range is read twice: lay the rows out by range first
        folder = f"{shared_folder(digests.sparkSession)}/digests-{uuid.uuid4().hex}"
        ranged.write.partitionBy("_range").parquet(folder)
        ranged = digests.sparkSession.read.parquet(folder)
    out = f"{shared_folder(digests.sparkSession)}/marked-{uuid.uuid4().hex}"
    for k in range(ranges):
        mine = ranged.filter(F.col("_range") == k).drop("_range")
        bits = digests.sparkSession.sparkContext.broadcast(repeated_filter(mine.select("_h"), blocks))
        mine.withColumn("_again", _tester(bits, blocks)("_h")).write.mode("append").parquet(out)
        bits.destroy()
    return digests.sparkSession.read.schema(digests.withColumn("_again", F.lit(True)).schema).parquet(out)


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of docs.

    Texts are equal when identical after normalising; null counts as empty.  Of equal texts the
    smallest doc_id stays (a null id only among nulls); of rows that repeat that doc_id with an
    equal text one stays.  Extra columns are not read; an empty table gives an empty result.
    """
    digests = cut(
        docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_h", F.xxhash64("text_sha256"))
    )
    marked = may_repeat(digests)
    alone = marked.filter(~F.col("_again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = marked.filter("_again").select("doc_id", "text_sha256", "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first")
    groups = again.groupBy("text_sha256").agg(first, F.count("*").alias("group_size"))
    grouped = attach(again, cut(groups), "text_sha256", "group_size", "inner")
    grouped = grouped.select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first._row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows whose id isn't among the lost ones pass straight through; the others are joined by id
    and digest.  Of rows that repeat an id with an equal text one stays; null ids and texts as in
    :func:`exact_groups`; extra columns pass through whatever they are called; an empty table
    stays one.
    """
    found = cut(exact_groups(docs))
    rows = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    lost = cut(rows.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
    doubled = not rows.filter("kept and rows > 1").isEmpty()
    digest = F.sha2(normalised(F.col("_doc.text")), 256)
    n = lost.count()
    kept = docs
    if n:
        may_hold = id_filter(lost.select(F.xxhash64("_id")), n)
        hashed = F.xxhash64(F.col("doc_id"))
        same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
        looked = packed(docs.filter(may_hold(hashed))).withColumn("_digest", digest).join(lost, same, "left_anti")
        kept = docs.filter(~may_hold(hashed)).unionByName(looked.select("_doc.*"))
    if doubled:
        kept = packed(kept).withColumn("_id", F.col("_doc.doc_id")).withColumn("_digest", digest).dropDuplicates(["_id", "_digest"]).select("_doc.*")
    return kept
