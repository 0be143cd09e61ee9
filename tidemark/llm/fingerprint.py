"""Document fingerprints: the digest of a canonical form, in DataFrame functions alone.

The canonical form is NFKC, case folded, with each run of white space as one space and none at
the ends.  Two xxhash64 with different seeds make a 128-bit digest.  Texts with equal digests are
grouped, and within such a group the canonical bytes themselves are compared; a group that holds
different bytes gets a strong digest behind its fingerprints, so that fingerprints are equal
exactly where canonical forms are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

#: Sorts before every id: what a null doc_id counts as.
NO_ID = -(1 << 63)
#: Different texts with the same 128 bits: none by chance, even among 1e15 texts.
MOST_CLASHES = 10_000
#: Groups of copies that hold more than one part in so many of all copies are compared apart.
SHARES = 256
#: What one bitmap_construct_agg holds; bits of the filter for each repeated digest, at least; the
#: fewest and most pieces of it (32 MiB).  Beyond 8 million repeated digests it only lets more through.
PIECE, BITS, FEWEST_PIECES, MOST_PIECES = 8 * 4096, 32, 64, 8192


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding can undo it), white space folded.

    ASCII texts skip the Unicode steps, which wouldn't change them beyond their case.
    """
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    wide = nfkc(fold(nfkc(text)))
    plain = F.octet_length(text) == F.length(text)
    return F.btrim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(wide), r"[\s\x85\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as lowercase hex; xxhash64 of several columns hashes each with the last as seed."""
    halves = (F.xxhash64(F.lit(salt), canon) for salt in (0x5EED, 0xF01D))
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with ``fingerprint``: the digest of each row's text, without the comparison."""
    return docs.withColumn("fingerprint", digest(canonical(F.col("text"))))


def settled(fingerprint: Column, canon: Column, clashing: list[str]) -> Column:
    """The fingerprint, with a strong digest behind it where different texts share it."""
    return F.when(fingerprint.isin(clashing), F.concat(fingerprint, F.lit("-"), F.sha2(canon, 256))).otherwise(fingerprint) if clashing else fingerprint


def repeated(canon: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """The rows of canon whose ``fingerprint`` is one of the n of sizes, and a few others: those
    that a broadcast bitmap of one hash can't tell from them.  Nothing is shuffled but sizes.
    """
    pieces = min(MOST_PIECES, max(FEWEST_PIECES, 1 << (n * BITS // PIECE).bit_length()))
    at = F.pmod(F.xxhash64("fingerprint"), F.lit(pieces * PIECE))
    piece, bit = F.floor(at / PIECE).cast("int").alias("_piece"), (at % PIECE).cast("int").alias("_bit")
    bits = sizes.select(piece, bit).repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    held = canon.select("*", piece, bit).join(F.broadcast(bits), "_piece")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.filter(F.getbit(byte, F.col("_bit") % 8) == 1).select(*canon.columns)


def collisions(docs: DataFrame) -> DataFrame:
    """``fingerprint`` of each group whose members' canonical bytes differ.

    The digests are counted first, and only the texts of groups are compared, least against most:
    a bitmap of the repeated digests leaves out nearly all others before any text is shuffled.
    Members of the few groups that hold more than one part in ``SHARES`` of all members find them
    in a broadcast table, and a partial aggregate leaves one pair of texts per task and group;
    those of the other groups are shuffled, and no task gets more than its small groups.
    """
    sizes = cut(docs.select(digest(canonical(F.col("text"))).alias("fingerprint")).groupBy("fingerprint").count().filter("count > 1"))
    total, n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    large = F.broadcast(sizes.filter(F.col("count") * SHARES > total).select("fingerprint", F.lit(True).alias("_large")))  # fewer than SHARES rows
    canon = docs.select(canonical(F.col("text")).alias("_canon")).withColumn("fingerprint", digest(F.col("_canon")))
    canon = repeated(canon, sizes, n).join(large, "fingerprint", "left")
    small = canon.filter(F.col("_large").isNull()).join(sizes, "fingerprint", "left_semi")
    both = canon.filter("_large").unionByName(small).groupBy("fingerprint").agg(F.min("_canon").alias("_least"), F.max("_canon").alias("_most"))
    return both.filter("_least <> _most").select("fingerprint")


def edited(n_chars: Column, text: Column, next_text: Column) -> Column:
    """The last quarter of the code points replaced by as many from the next document's start."""
    quarter = F.floor(n_chars / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - quarter).cast("int")), F.substring(next_text, F.lit(1), quarter))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` with ``next_text, next_fingerprint`` of the next document by
    ascending doc_id (after the last the first).

    The rows are spread over ranges of doc_id and sorted within each, so no task holds more than
    its range.  The first rows of a range are also sent to the range before it, as its end.
    """
    n = 4 * partitions(docs.sparkSession)
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    ids = docs.select(id_.alias("_id"))
    bounds = ids.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))  # n - 1 at most

    # Binary search in the sorted bounds: how many of them are less than the id.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]) if bounds else F.expr("cast(array() as array<int>)")
    held = F.lit(bounds) if bounds else F.expr("cast(array() as array<bigint>)")
    step = lambda at, by: F.when(F.coalesce(F.get(held, at + by - 1) < F.col("_id"), F.lit(False)), at + by).otherwise(at)
    place = F.aggregate(steps, F.lit(0), step)

    spread = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_.alias("_id")).withColumn("_part", place)
    firsts = ids.withColumn("_part", place).groupBy("_part").agg(F.min("_id").alias("_first"))  # a row per range
    rounds = Window.orderBy("_part")
    before = firsts.withColumn("_before", F.coalesce(F.lag("_part").over(rounds), F.max("_part").over(Window.partitionBy(F.lit(0)))))
    before = before.withColumn("_wraps", F.lag("_part").over(rounds).isNull()).select(F.col("_first").alias("_id"), "_before", "_wraps")
    marked = spread.join(F.broadcast(before), "_id", "left")
    both = F.array(
        F.struct(F.col("_part").alias("part"), F.lit(0).alias("late")),
        F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("part"), F.lit(1).alias("late"))),
    )
    sent = marked.withColumn("_to", F.explode(F.filter(both, lambda x: x.isNotNull()))).select("doc_id", "_id", "text", F.col("_to.part").alias("_part"), F.col("_to.late").alias("_late"))
    sent = sent.withColumn("fingerprint", digest(canonical(F.col("text"))))
    order = Window.partitionBy("_part").orderBy("_late", "_id", "fingerprint", F.xxhash64("text"))
    after = sent.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return after.filter("_late = 0").drop("_late", "_part", "_id")


def edit_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The likeness of two fingerprints is 1 where they are equal and the canonical bytes too, else
    0: the digest is exact.  Null counts as the empty text; of rows that repeat a doc_id the next
    is the one after it in a fixed order; a table of one row follows itself; extra columns are
    not read.
    """
    clashing = [r.fingerprint for r in collisions(docs).limit(MOST_CLASHES + 1).collect()]
    if len(clashing) > MOST_CLASHES:
        raise ValueError("more texts share 128-bit digests than chance allows: change the salts")
    n_chars = F.length("text")
    rows = with_next(docs).withColumn("n_chars", n_chars.cast("long")).withColumn("_edited", edited(n_chars, F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("_edited"))))

    def near(a: Column, b: Column, x: Column, y: Column) -> Column:
        return F.when(F.when(a == b, canonical(x) == canonical(y)).otherwise(F.lit(False)), 1.0).otherwise(0.0)

    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        settled(F.col("fingerprint"), canonical(F.col("text")), clashing).alias("fingerprint"),
        settled(F.col("edited_fingerprint"), canonical(F.col("_edited")), clashing).alias("edited_fingerprint"),
        near(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("text"), F.col("_edited")).alias("near_edited"),
        near(F.col("fingerprint"), F.col("next_fingerprint"), F.col("text"), F.col("next_text")).alias("near_next"),
    )
