"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every source offers its documents in a shuffled order, over and over up to the most repeats.  A
document's virtual finish time is the number of the source's words up to and with it, divided by
the source's target.  The offers are dealt out by ranges of virtual time and sorted in each, which
sorts them all; prefix sums over the ranges say how many words and documents lie before, and the
queue is cut where the total budget is spent.  Equal widths of virtual time hold equal shares of
the budget, so the ranges are even whatever the sources are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANK, cut, partitions

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Runs into which each source's shuffled order is cut for its running sums: three hexadecimal
#: digits of the hash; a source of any size spreads over so many tasks.
RUN_DIGITS = 3
#: About so many rows to a range of virtual time, of which there are some in any case.
RANGE_ROWS, LEAST_RANGES = 250_000, 64


def word_count(text: Column) -> Column:
    """How many stretches without ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    The weights are dealt out repeating, by the order of the sources' code points, null last.
    Each source gets min(repeats * size, level * weight) with one level for all that spends the
    budget: what sharing the excess again and again by weight among the others comes to.  The
    level is found over the sources sorted by the level at which they are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = sizes.withColumn("_rank", F.row_number().over(order))
    weight = F.array(*map(F.lit, weights))[F.pmod(F.col("_rank") - 1, F.lit(len(weights)))]
    full = ranked.withColumn("weight", weight).withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum(F.col("source_size").cast("double")).over(everything) * share
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = full.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("weight"))
    open_ = found.withColumn("_at", F.row_number().over(by_level)).withColumn("_found", F.min(F.when(F.col("_open"), F.struct("_at", "_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_found._level") * F.col("weight"), F.col("_cap")))
    return open_.select("source", "source_size", "weight", target.alias("target"))


def _order(seed: int) -> Column:
    """A row's place in the shuffle, which tells its id and text apart: a hash that SQL has too."""
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *own))


def _placed(docs: DataFrame, weights: tuple[float, ...], share: float, repeats: int, seed: int) -> DataFrame:
    """Each row of docs without its text: ``_row``, ``size``, its source's size and target, and up
    to which word of its source it reaches (``_end``)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("_order"))
    slim = cut(sized.withColumn("_run", F.substring("_order", 1, RUN_DIGITS)).withColumn("_row", F.monotonically_increasing_id()))
    runs = slim.groupBy("source", "_run").agg(F.sum("size").alias("_size"))
    per_run = Window.partitionBy("source").orderBy("_run")  # 16 ** RUN_DIGITS rows a source at most
    offsets = runs.withColumn("_offset", F.sum("_size").over(per_run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    per_source = targets(runs.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, repeats)
    facts = cut(offsets.alias("o").join(per_source.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "_run", "_offset", "source_size", "target"))
    within = Window.partitionBy("source", "_run").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d._run") == F.col("f._run"))
    return cut(
        slim.withColumn("_upto", F.sum("size").over(within)).alias("d").join(facts.alias("f"), same)
        .select("doc_id", "d.source", "size", "_order", "_row", "source_size", "target", (F.col("_offset") + F.col("_upto")).alias("_end"))
    )


def _queue(placed: DataFrame, share: float, repeats: int) -> DataFrame:
    """``position, _row, _order`` of each copy that the mix takes, position being its place in it."""
    rows, total = placed.agg(F.count("*"), F.sum("size")).first()
    budget, ranges = min(share, repeats) * float(total or 0), max(LEAST_RANGES, rows // RANGE_ROWS)
    rounds = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: (F.col("_end") + r * F.col("source_size")) / F.col("target"))
    offers = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select("source", "_order", "_row", "size", F.posexplode(rounds).alias("_round", "finish"))
    offers = offers.withColumn("_range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)).cast("int"))

    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # a row a range
    sums = offers.groupBy("_range").agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
    sums = sums.select("_range", (F.sum("_words").over(upto) - F.col("_words")).alias("_before"), (F.sum("_rows").over(upto) - F.col("_rows")).alias("_first"))
    sums = sums.filter(F.col("_before") <= budget)
    within = Window.partitionBy("_range").orderBy("finish", F.col("source").asc_nulls_last(), "_round", "_order", "_row")
    sorted_ = offers.join(F.broadcast(sums), "_range").withColumn("_run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # A document is taken if more than half of it lies within the budget.
    taken = sorted_.withColumn("position", F.col("_first") + F.row_number().over(within) - 1).filter(F.col("_before") + F.col("_run") - F.col("size") / 2 <= budget)
    return taken.select("position", "_row", "_order")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` for every row of docs.

    ``times`` says how often the mix takes the document, ``taken`` how many words that makes; the
    order is fixed by the seed, so reruns agree.  Null and empty texts have size 0 and are never
    taken; a null source is one of its own; rows that repeat an id or a text are offered one
    after the other; extra columns are not read; an empty table gives an empty result.
    """
    placed = _placed(docs, weights, share, repeats, seed)
    times = _queue(placed, share, repeats).groupBy("_row").agg(F.count("*").cast("int").alias("times"))
    found = placed.join(times, "_row", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return found.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it, in its order:
    partitions hold ranges of the queue one after the other, and rows are sorted in each.

    Edge cases as in :func:`mix`; of rows that repeat an id with an equal text the copies are dealt
    out in turn; extra columns pass through whatever they are called.
    """
    placed = _placed(docs, weights, share, repeats, seed)
    places = cut(_queue(placed, share, repeats).groupBy("_order").agg(F.array_sort(F.collect_list("position")).alias("positions")))
    repeated = placed.groupBy("_order").count().filter("count > 1").select("_order")
    rows = docs.select(_order(seed).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    if repeated.isEmpty():
        mine = F.col("positions")
    else:
        one = Window.partitionBy("_key").orderBy("_key")
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).withColumn("_i", F.row_number().over(one))
        mine = F.filter("positions", lambda p, i: F.pmod(i, F.col("_n").cast("int")) == F.col("_i") - 1)
    copies = rows.join(places.hint("shuffle_hash"), F.col("_key") == F.col("_order")).select("_doc", F.explode(mine).alias("_position"))
    return copies.repartitionByRange(partitions(docs.sparkSession), "_position").sortWithinPartitions("_position").select("_doc.*")
