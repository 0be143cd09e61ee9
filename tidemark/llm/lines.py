"""Deduplication of lines across documents.

Each distinct long line of a document gives one slim row: a wide hash of its key, the document
and the line's places.  The rows are range-partitioned by hash and document and sorted, the
largest document first, so a line's first occurrence in that order is the one that stays and a
stream over a partition sees the others behind it.  As the document is part of the range, even a
line that a third of all documents share is spread over many partitions; such a line runs over
partition boundaries, and its count is put together from two summary rows per partition.  What
comes back are compressed bitmaps of the lines to keep, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_rows, partitions

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: Sorts before every id: what a null doc_id counts as.
NO_ID = -(1 << 63)
ASCII_BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: str) -> dict[bytes, list[int]]:
    """Places of the lines by the hash of their key, for keys that are long enough."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split("\n")):
        if len(line) >= MIN_CHARS and len(key := line.strip(ASCII_BLANKS)) >= MIN_CHARS:
            found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's identity: its id (null as the smallest) and a hash of its text."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"))


def _occurrences(keyed: DataFrame) -> DataFrame:
    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for text, id_, hashed in each:
            if text:
                n = text.count("\n") + 1
                for key, places in line_keys(text).items():
                    yield key, id_, hashed, n, np.array(places, np.uint32).tobytes()

    return map_rows(keyed.select("text", "_id", "_text"), rows, "key binary, _id long, _text long, n_lines int, places binary")


def _runs(each: Iterator[tuple]) -> Iterator[tuple[bytes, Iterator[tuple]]]:
    return groupby(each, key=lambda row: row[0])


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``_id, _text, n_lines, bitmap`` of the documents that lose lines.

    The bitmap is a zlib-compressed bit array, one bit per line, set where the line stays.
    Documents are told apart by doc_id (null is one of its own, the smallest); rows that repeat
    an id with another text have bitmaps of their own but count as one document.
    """
    n = partitions(docs.sparkSession)
    largest = F.col("_id").desc()
    ordered = cut(_occurrences(_keyed(docs)).repartitionByRange(n, "key", largest).sortWithinPartitions("key", largest, "_text"))

    def summary(each: Iterator[tuple]) -> Iterator[tuple]:
        first = last = None
        for key, run in _runs(each):
            count, before = 0, None
            for _, id_ in run:
                count, before = count + (id_ != before), id_
            if first is None:
                first = (key, count)
            last = (key, count)
        part = TaskContext.get().partitionId()
        if first is not None:
            yield (part, *first)
            if last[0] != first[0]:
                yield (part, *last)

    total: dict[bytes, int] = {}
    starts: dict[bytes, int] = {}
    ends = map_rows(ordered.select("key", "_id"), summary, "part int, key binary, n long").collect()  # two rows a partition at most
    for row in sorted(ends, key=lambda r: r.part):
        key = bytes(row.key)
        total[key] = total.get(key, 0) + row.n
        starts.setdefault(key, row.part)
    edges = docs.sparkSession.sparkContext.broadcast((total, starts))

    def dropped(each: Iterator[tuple]) -> Iterator[tuple]:
        total, starts = edges.value
        part = TaskContext.get().partitionId()
        for key, run in _runs(each):
            known = total.get(key)
            if known is not None and known < min_documents:
                continue
            # Of a key that began in an earlier partition the document that keeps it is there.
            keeper = None if known is None or starts[key] == part else NO_ID - 1
            held: list[tuple] = []
            seen, before = 0, None
            for _, id_, hashed, n_lines, places in run:
                if keeper is None:
                    keeper = id_
                if id_ != before:
                    seen, before = seen + 1, id_
                if id_ != keeper:
                    if known is not None or seen >= min_documents:
                        yield from held
                        held = []
                        yield id_, hashed, n_lines, places
                    else:
                        held.append((id_, hashed, n_lines, places))

    marks = map_rows(ordered, dropped, "_id long, _text long, n_lines int, places binary")
    lists = marks.groupBy("_id", "_text").agg(F.first("n_lines").alias("n_lines"), F.collect_set("places").alias("lists"))

    def bitmaps(each: Iterator[tuple]) -> Iterator[tuple]:
        for id_, hashed, n_lines, lists in each:
            keep = np.ones(n_lines, bool)
            for places in lists:
                keep[np.frombuffer(places, np.uint32)] = False
            yield id_, hashed, n_lines, zlib.compress(np.packbits(keep).tobytes(), 6)

    return map_rows(lists, bitmaps, "_id long, _text long, n_lines int, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    """The lines that stay and how many there were."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return [line for line, stays in zip(lines, keep.tolist(), strict=True) if stays], len(lines)


def with_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, text, bitmap`` of every row of docs (null: nothing to drop)."""
    bitmaps = keep_bitmaps(docs, min_documents).select("_id", "_text", "bitmap").hint("shuffle_hash")
    return _keyed(docs).join(bitmaps, ["_id", "_text"], "left").select("doc_id", "text", "bitmap")


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: each row of docs with the lines that stay.

    A null or empty text is one empty line; an empty table gives an empty result; extra columns
    are not read.  A text that loses all its lines becomes empty.
    """

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, bitmap in each:
            kept, n = kept_lines(text, bitmap)
            yield doc_id, n, n - len(kept), "\n".join(kept)

    return map_rows(with_bitmaps(docs, min_documents), rows, "doc_id long, n_lines long, n_dropped long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """:func:`dedup_lines` with a digest in the text's place."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, bitmap in each:
            kept, n = kept_lines(text, bitmap)
            yield doc_id, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()

    return map_rows(with_bitmaps(docs), rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

