"""A bounded Bloom filter of hashed ids, to keep most texts out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import packed

#: log2 of the most bits: the filter never exceeds 64 MiB; a full one only lets more rows by.
MOST_BITS = 29


def id_filter(hashes: DataFrame, n_rows: int):
    """A test, by a bounded Bloom filter, of which 64-bit hashes may be among these."""
    bits = 1 << max(10, min(MOST_BITS, (16 * max(1, n_rows)).bit_length()))

    def places(h: np.ndarray) -> list[np.ndarray]:
        h = h.view(np.uint64)
        return [((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 32)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(places(batch.column(0).to_numpy())))
            blocks, starts = np.unique(at >> 16, return_index=True)
            low = [part.tobytes() for part in np.split((at & 0xFFFF).astype(np.uint16), starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(low[: len(blocks)], pa.binary())], ["block", "at"])

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << 16, bool)
        for part in parts:
            for at in part["at"]:
                seen[np.frombuffer(at, np.uint16)] = True
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(seen, bitorder="little").tobytes()]})

    blocks = hashes.mapInArrow(parts, "block long, at binary").groupBy("block").applyInPandas(merge, "block long, bits binary")
    table = np.zeros((max(1, bits >> 16), 1 << 13), np.uint8)
    for row in blocks.toLocalIterator():
        table[row.block] = np.frombuffer(row.bits, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table.ravel())

    @pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        table = shared.value
        found = np.ones(len(h), bool)
        for at in places(h.to_numpy(np.int64)):
            found &= (table[at >> 3] >> (at & 7) & 1).astype(bool)
        return pd.Series(found)

    return may_hold


def drop_ids(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ``lost._id`` (distinct, not null; its lineage cut).

    Rows that the filter clears pass straight through; only the others are joined.  Rows with a
    null id stay, repeated rows stay or go together, extra columns pass through whatever they are
    called, and of an empty table nothing stays.
    """
    n = lost.count()
    if not n:
        return docs
    may_hold = id_filter(lost.select(F.xxhash64("_id")), n)
    hashed = F.xxhash64(F.col("doc_id"))
    looked = packed(docs.filter(may_hold(hashed))).join(lost.select("_id"), F.col("_doc.doc_id") == F.col("_id"), "left_anti")
    return docs.filter(~may_hold(hashed)).unionByName(looked.select("_doc.*"))
