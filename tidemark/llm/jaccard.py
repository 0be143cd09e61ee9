"""Jaccard join of documents on word shingles, by prefix filtering.

1. A sketch counts all shingles of all documents (a fixed number of counters), to put each
   document's shingles in one global order, rare ones first.
2. Documents with the same set of shingles are one class.  Two sets of similarity t or more share
   a shingle among the first ``n - ceil(t * n) + 1`` of each: only these prefixes are joined.
3. The prefix shingles are range-partitioned by (shingle, set size, class) and sorted, so a
   shingle of any frequency spreads over tasks.  Rows of one shingle whose sizes the length
   filter lets through are chained; the chains' components are the candidate clusters: classes in
   different clusters can't be similar.
   The sketch is of fixed size, so with very many shingles it can't tell those of shared passages
   from rare ones, and passages chain clusters together.  The classes of clusters that are too
   large for a task go through this step once more, with their exact frequencies, for which
   their shingles are shuffled; what occurs once there can't match and goes no further.
4. Only clustered classes' whole sets are shuffled, to their cluster.  There the join runs with
   the cluster's own exact frequencies as order and the length, positional and suffix filters,
   verifying each pair once.  A task gives how many rows each class is linked to, and edges that
   connect the linked classes, not the pairs themselves, whose number grows with the square of a
   cluster.  Where only components are asked for, pairs that are already connected are left out.
   A cluster that is still larger than a task should hold is cut into blocks, and each pair of
   blocks is one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bloom import drop_ids, id_filter
from .components import components
from .shared import attach, cut, map_rows, packed, partitions
from .shingles import shingles

#: The similarity, as a fraction of integers so that the comparison is exact.
SIMILAR, OF = 80, 100
SKETCH_BITS, SKETCH_BLOCK = 24, 16
#: Shingles of one cluster that a task should hold (8 bytes each).
TASK_SHINGLES = 2_000_000
SUFFIX_PARTS = 32


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(t * n)"""
    return -(-n * SIMILAR // OF)


def prefix_size(n: int) -> int:
    return n - _least(n) + 1


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of sets of these sizes that are similar."""
    return -(-(a + b) * SIMILAR // (SIMILAR + OF))


def sketch(docs: DataFrame) -> np.ndarray:
    """About how many documents hold each shingle, 255 at most: the count of its hash's leading bits."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            counts[at] += n.astype(np.uint32)
            held.clear()

        for (text,) in each:
            held.append((shingles(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
            size += len(held[-1])
            if size > 1 << 20:
                add()
                size = 0
        if held:
            add()
        for block, part in enumerate(counts.reshape(-1, 1 << SKETCH_BLOCK)):
            if part.any():
                narrow = part.max() < 256
                yield block, narrow, zlib.compress(part.astype(np.uint8 if narrow else np.uint32).tobytes(), 1)

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BLOCK, np.int64)
        for part in parts:
            for narrow, n in zip(part["narrow"], part["n"], strict=True):
                total += np.frombuffer(zlib.decompress(n), np.uint8 if narrow else np.uint32)
        yield pd.DataFrame({"block": [key[0]], "total": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    merged = map_rows(docs.select("text"), rows, "block int, narrow boolean, n binary").groupBy("block").applyInPandas(merge, "block int, total binary")
    out = np.zeros((1 << (SKETCH_BITS - SKETCH_BLOCK), 1 << SKETCH_BLOCK), np.uint8)
    for row in merged.collect():  # a fixed number of counters
        out[row.block] = np.frombuffer(row.total, np.uint8)
    return out.ravel()


def _class_of(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), np.int64)[0])


def members(docs: DataFrame) -> DataFrame:
    """``doc_id, n, class, prefix`` of every row; class and prefix are null without shingles."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs))

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        frequency = counts.value
        for doc_id, text in each:
            found = shingles(text)
            if len(found):
                rare_first = np.argsort(frequency[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                yield doc_id, len(found), _class_of(found), found[rare_first[: prefix_size(len(found))]].tobytes()
            else:
                yield doc_id, 0, None, None

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n long, class long, prefix binary")


def _explode(classes: DataFrame) -> DataFrame:
    """``token, n, class`` of each prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                prefixes = [np.frombuffer(p, np.int64) for p in part.column("prefix").to_pylist()]
                sizes = [len(p) for p in prefixes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(prefixes)), pa.array(np.repeat(part.column("n").to_numpy(), sizes)), pa.array(np.repeat(part.column("class").to_numpy(), sizes))],
                    ["token", "n", "class"],
                )

    return classes.select("prefix", "n", "class").mapInArrow(run, "token long, n long, class long")


def candidate_edges(prefixes: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components hold every similar pair of classes, from ``token, n, class``
    of each prefix shingle."""
    spark = prefixes.sparkSession
    n = partitions(spark)
    ordered = prefixes.select("token", "n", "class").repartitionByRange(n, "token", "n", "class").sortWithinPartitions("token", "n", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        for batch in batches:
            token, size, class_ = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            if first is None:
                first = (token[0], size[0], class_[0])
            else:
                token, size, class_ = (np.concatenate(([x], y)) for x, y in zip(last, (token, size, class_), strict=True))
            last = (token[-1], size[-1], class_[-1])
            near = (token[1:] == token[:-1]) & (size[:-1] >= _least(size[1:])) & (class_[1:] != class_[:-1])
            # A run of neighbours is tied to its first row, which keeps paths short.
            at = np.arange(len(token))
            starts = np.maximum.accumulate(np.where(np.concatenate(([False], near)), 0, at))
            pick = np.flatnonzero(near) + 1
            edges = np.unique(np.stack((class_[starts[pick]], class_[pick])), axis=1)
            yield _edges(edges[0], edges[1], np.zeros(edges.shape[1], np.int64), None, None)
        if first is not None:
            for end, row in ((1, first), (2, last)):
                yield _edges(np.array([row[2]]), np.array([part]), np.array([end]), np.array([row[0]]), np.array([row[1]]))

    def _edges(a, b, end, token, size) -> pa.RecordBatch:
        blank = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, end, blank if token is None else token, blank if size is None else size)], ["a", "b", "end", "token", "n"])

    found = cut(ordered.mapInArrow(run, "a long, b long, end long, token long, n long"))
    # Runs that cross a partition's end: two rows a partition.
    ends = sorted((r.b, r.end, r.token, r.n, r.a) for r in found.filter("end > 0").collect())
    across = [(x[4], y[4]) for x, y in zip(ends, ends[1:], strict=False) if x[1] == 2 and y[1] == 1 and x[2] == y[2] and x[3] >= _least(y[3])]
    edges = found.filter("end = 0").select("a", "b")
    if across:
        edges = edges.unionByName(spark.createDataFrame([(int(a), int(b)) for a, b in across], "a long, b long"))
    return edges


def exact_prefixes(docs: DataFrame, big: DataFrame) -> DataFrame:
    """``token, n, class`` of the prefixes of some classes (``class, n, rep``), by exact frequency
    among them; shingles that only one of them has can't match and are left out.

    Rows of one shingle may lie in two partitions where it is the last or first one: such
    shingles, two a partition at most, come last in the order on either side.
    """
    may_hold = id_filter(big.select(F.xxhash64("rep")), big.count())
    n_parts = partitions(docs.sparkSession)
    last = 1 << 40

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [s for s in map(shingles, batch.column(0).slice(at, 500).to_pylist()) if len(s)]
                if sets:
                    sizes = [len(s) for s in sets]
                    columns = [np.concatenate(sets).view(np.int64), np.repeat([_class_of(s) for s in sets], sizes), np.repeat(sizes, sizes)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "class", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        token, class_, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        new = np.concatenate(([True], token[1:] != token[:-1]))
        run = np.cumsum(new) - 1
        df = np.bincount(run)
        df[[0, -1]] = last
        df = df[run]
        some = df > 1
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, class_, n, df)], ["token", "class", "n", "df"])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        token, class_, n, df = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
        order = np.lexsort((token, df, class_))
        token, class_, n = token[order], class_[order], n[order]
        again = np.concatenate(([False], (token[1:] == token[:-1]) & (class_[1:] == class_[:-1])))
        token, class_, n = token[~again], class_[~again], n[~again]
        starts = np.flatnonzero(np.concatenate(([True], class_[1:] != class_[:-1])))
        sizes = np.diff(np.append(starts, len(class_)))
        place = np.arange(len(class_)) - np.repeat(starts, sizes) + (n - np.repeat(sizes, sizes))
        some = place < n - _least(n) + 1
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, n, class_)], ["token", "n", "class"])

    rows = docs.filter(may_hold(F.xxhash64(F.col("doc_id")))).select("text").mapInArrow(explode, "token long, class long, n long")
    counted = rows.repartitionByRange(n_parts, "token", "class").sortWithinPartitions("token").mapInArrow(count, "token long, class long, n long, df long")
    return counted.repartition(n_parts, "class").mapInArrow(prefix, "token long, n long, class long")


def clusters(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``cluster, class, n, rep, rows, _n``: classes that may be similar to others, by cluster, and the
    cluster's shingles in all."""

    def of(prefixes: DataFrame) -> DataFrame:
        found = components(candidate_edges(prefixes)).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
        found = cut(found.join(classes.select("class", "n", "rep", "rows"), "class"))
        sums = found.groupBy("cluster").agg(F.sum("n").alias("_n"))
        return cut(found.join(sums, "cluster").select("cluster", "class", "n", "rep", "rows", "_n"))

    found = of(_explode(classes))
    big = found.filter(F.col("_n") > TASK_SHINGLES)
    if big.isEmpty():
        return found
    return found.filter(F.col("_n") <= TASK_SHINGLES).unionByName(of(exact_prefixes(docs, big)))


def join_sets(sets: list[np.ndarray], side: list[int] | None = None, rows: list[int] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that connect the similar pairs among some sets of shingles, and how many rows each set
    is linked to, ``rows`` being how many have it; with ``side``, of pairs from different sides
    only.  Without ``rows``, pairs within what is already connected aren't verified nor counted."""
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
    part = rank * SUFFIX_PARTS // max(1, len(tokens))
    spread = np.zeros((len(sets), SUFFIX_PARTS), np.int32)
    np.add.at(spread, (np.repeat(np.arange(len(sets)), sizes), part[inverse]), 1)
    order = np.argsort(sizes, kind="stable")
    sides = np.zeros(len(sets), np.int64) if side is None else np.array(side)
    label = np.arange(len(sets))
    postings: dict[int, list[tuple[int, int]]] = {}
    held = np.zeros(len(tokens), bool)
    edges = []
    linked = np.zeros(len(sets), np.int64)
    weight = None if rows is None else np.array(rows, np.int64)
    for x in order.tolist():
        n, mine = int(sizes[x]), ranked[x]
        p = prefix_size(n)
        hits = [(y, i, j) for i, t in enumerate(mine[:p].tolist()) for y, j in postings.get(t, ())]
        if hits:
            y, i, j = np.array(hits).T
            y, at, shared = np.unique(y, return_index=True, return_counts=True)  # at: the first shared one
            need = overlap_needed(n, sizes[y])
            good = (sizes[y] >= _least(n)) & (1 + np.minimum(n - i[at], sizes[y] - j[at]) - 1 >= need)
            if weight is None:
                good &= label[y] != label[x]
            if side is not None:
                good &= sides[y] != sides[x]
            y, need, shared = y[good], need[good], shared[good]
            if len(y):
                fits = np.minimum(spread[x], spread[y]).sum(axis=1) >= need
                y, need, shared = y[fits], need[fits], shared[fits]
            held[mine] = True
            if weight is not None and len(y):
                both = np.array([np.count_nonzero(held[ranked[k]]) for k in y.tolist()])
                y = y[OF * both >= SIMILAR * (n + sizes[y] - both)]
                linked[x] += weight[y].sum()
                linked[y] += weight[x]
                for other in y[np.unique(label[y], return_index=True)[1]].tolist():
                    if label[other] != label[x]:
                        edges.append((x, other))
                        label[label == label[x]] = label[other]
            for k in np.argsort(-shared, kind="stable").tolist() if weight is None else ():
                other = int(y[k])
                if label[other] != label[x]:
                    both = int(np.count_nonzero(held[ranked[other]]))
                    if OF * both >= SIMILAR * (n + int(sizes[other]) - both):
                        edges.append((x, other))
                        label[label == label[x]] = label[other]
            held[mine] = False
        for i, t in enumerate(mine[:p].tolist()):
            postings.setdefault(t, []).append((x, i))
    return edges, linked


def links(docs: DataFrame, classes: DataFrame, count: bool = True) -> DataFrame:
    """Edges ``a, b`` between similar classes that connect just what all similar pairs connect, with
    0 as ``rows``; and, if ``count``, rows whose a and b are one class, ``rows`` adding up to how
    many rows of other classes that one is linked to."""
    blocks = F.when(F.col("_n") <= TASK_SHINGLES, 1).otherwise(F.ceil(2 * F.col("_n") / TASK_SHINGLES).cast("int"))
    tasks = cut(clusters(docs, classes).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))

    may_hold = id_filter(tasks.select(F.xxhash64("rep")), tasks.count())
    wanted = docs.select("doc_id", "text").filter(may_hold(F.xxhash64(F.col("doc_id"))))

    # Texts are shuffled rather than sets of hashes: they are smaller, and they compress.
    rows = wanted.join(tasks, F.col("doc_id").eqNullSafe(F.col("rep")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = rows.select("cluster", "class", "block", "rows", "text", F.explode(pairs).alias("_t")).select("cluster", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), "class", "block", "rows", "text")
    n = partitions(docs.sparkSession)
    dealt = dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "class")

    def join(each: Iterator[tuple]) -> Iterator[tuple]:
        for (_, i, j), task in groupby(each, key=lambda r: r[:3]):
            held = {}
            for *_, class_, block, rows, text in task:  # an id can be repeated with the same or another text
                if class_ not in held and _class_of(found := shingles(text)) == class_:
                    held[class_] = (block, found, rows)
            names = list(held)
            if len(names) > 1:
                side = None if i == j else [held[c][0] for c in names]
                edges, linked = join_sets([held[c][1] for c in names], side, [held[c][2] for c in names] if count else None)
                for a, b in edges:
                    yield names[a], names[b], 0
                for k in np.flatnonzero(linked).tolist():
                    yield names[k], names[k], int(linked[k])

    return map_rows(dealt, join, "a long, b long, rows long")


def near_duplicates(docs: DataFrame, count: bool = True) -> DataFrame:
    """``doc_id, n_shingles, class, component_id, kept_class, n_links`` for every row of docs.

    component_id is the smallest doc_id that can be reached by links, a link being a similarity
    of 80 % or more; rows with equal sets are always linked.  Null texts and texts without words
    have no shingles and stand alone; null ids count for nothing against others; extra columns
    are not read; an empty table gives an empty result.  kept_class is the class of the component
    that has that doc_id, the smallest if an id is repeated.  n_links is how many other rows a row
    is linked to; without ``count`` it is null, and pairs that are already connected are not verified.
    """
    known = cut(members(docs))
    filled = known.filter("class is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "prefix"))
    classes = cut(filled.groupBy("class").agg(first.alias("f"), F.count("*").alias("rows")).select("class", F.col("f.doc_id").alias("rep"), F.col("f.n").alias("n"), F.col("f.prefix").alias("prefix"), "rows"))
    joined = cut(links(docs, classes, count))
    found = components(joined.filter("a <> b"))
    rooted = classes.select("class", "rep", "rows").join(found.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    if count:
        counted = joined.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("rows").alias("_linked"))
        rooted = rooted.join(counted, "class", "left").withColumn("n_links", F.coalesce("_linked", F.lit(0)) + F.col("rows") - 1)
    else:
        rooted = rooted.withColumn("n_links", F.lit(None).cast("long"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "class")).alias("f"))
    least = least.select("root", F.col("f.rep").alias("component_id"), F.col("f.class").alias("kept_class"))
    facts = cut(rooted.join(least, "root").select("class", "component_id", "kept_class", "n_links", "rows"))
    placed = attach(filled.select("doc_id", "n", "class"), facts, "class", "rows", "inner").select("doc_id", "n", "class", "component_id", "kept_class", "n_links")
    alone = known.filter("class is null").select("doc_id", "n", "class", F.col("doc_id").alias("component_id"), F.col("class").alias("kept_class"), F.lit(0 if count else None).cast("long").alias("n_links"))
    return placed.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "class", "component_id", "kept_class", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates, with all columns: of each component one row of the
    smallest doc_id stays (a null id only where there is no other), and every row without shingles.

    Ids whose rows are all lost are dropped by id.  Where an id is null, or has rows that stay too
    or stay more than once, its rows are told apart by their class.  Null and empty texts stay;
    extra columns pass through whatever they are called; an empty table stays one.
    """
    found = near_duplicates(docs, count=False)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("class").eqNullSafe(F.col("kept_class"))
    found = cut(found.select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"), kept.alias("_kept")))
    whole = cut(found.filter("_id is not null").groupBy("_id").agg(F.max("_kept").alias("_some")).filter("not _some").select("_id"))
    rest = drop_ids(docs, whole)
    rows = found.filter("_class is not null").groupBy("_id", "_class").agg(F.max("_kept").alias("_kept"), F.count("*").alias("rows"))
    odd = cut(rows.filter("not _kept or rows > 1").join(whole, "_id", "left_anti").select("_id", "_class", "_kept"))
    n = odd.count()
    if not n:
        return rest

    @pandas_udf("long")
    def class_of(texts: pd.Series) -> pd.Series:
        found = map(shingles, texts)
        return pd.Series([_class_of(x) if len(x) else None for x in found], dtype="Int64")

    may_hold = id_filter(odd.select(F.xxhash64("_id")), n)
    hashed = F.xxhash64(F.col("doc_id"))
    looked = packed(rest.filter(may_hold(hashed))).withColumn("_own", class_of("_doc.text"))
    looked = looked.join(odd, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_class")), "left")
    once = looked.filter("_kept").withColumn("_of", F.col("_doc.doc_id")).dropDuplicates(["_of", "_own"])
    return rest.filter(~may_hold(hashed)).unionByName(looked.filter("_kept is null").select("_doc.*")).unionByName(once.select("_doc.*"))
