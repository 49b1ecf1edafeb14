"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, HOT_SHARE, WORD, hot_join, materialize, numbered, row_number, unit, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: How often what is left of a fraction is filled in order; after that one document may come nearest.
FILLS = 2


def _numbered(sources: DataFrame, n: int) -> DataFrame:
    """sources with `place`, from 0, by code point and null last. Ranges are counted first, so no task has all sources."""
    cut = materialize(sources.repartitionByRange(max(1, n // BUCKET_ROWS), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return cut.join(parts, "part").withColumn("place", F.col("first") + F.row_number().over(inside) - 1).drop("part", "first")


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, n_rows) with `target`.

    The targets add up to share times all sizes, or to what the caps allow. A target that its weight would lift
    above max_epochs times its source's size is clamped there and the excess shared by weight among the others,
    until none is above. A clamped source stays clamped, as the level only rises, so a round needs two sums; only
    such sums reach the driver.
    """
    n = sources.count()
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(_numbered(sources, n).withColumn("weight", weigh), "weights")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    cap, level, full = F.col("source_size") * F.lit(float(max_epochs)), 0.0, -1
    for _ in range(n + 1):
        over = F.col("weight") * F.lit(level) > cap
        now, held, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if now == full or not free:
            break
        full, level = now, max(0.0, (total - max_epochs * (held or 0)) / free)
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if free else cap)


def _bucketed(rows: DataFrame, total: int) -> DataFrame:
    """rows with `bucket`, of about BUCKET_ROWS rows and rising with (u, v).

    u follows the identifier, so one that is null or repeats in a great part of a source would fill one bucket. Such
    identifiers, of more than a thousandth of all rows and so HOT_SHARE at most, have buckets of their own by v.
    """
    least = max(BUCKET_ROWS, -(-total // HOT_SHARE))
    often = rows.groupBy("key", "u").agg(F.count("*").alias("often")).filter(F.col("often") > least)
    often = often.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("u", "often"))).alias("often"))
    marked = rows.join(F.broadcast(often), "key", "left").withColumn("often", F.coalesce("often", F.array().cast("array<struct<u:double,often:bigint>>")))
    mine = F.filter("often", lambda h: h["u"] == F.col("u"))
    before = F.size(F.filter("often", lambda h: h["u"] < F.col("u")))
    part = F.struct(F.floor(F.col("u") * F.col("buckets")).alias("wide"), (2 * before + F.size(mine)).alias("side"), F.floor(F.col("v") * F.ceil(F.coalesce(F.get(mine, F.lit(0))["often"], F.lit(1)) / BUCKET_ROWS)).alias("own"))
    return marked.withColumn("bucket", part).drop("often", "buckets")


def _filled(rows: DataFrame, total: int) -> DataFrame:
    """rows (more, gap) with `more` set for those that come first and fit in what is left of their source's fraction, and
    `gap`, what is left then. A row larger than the whole gap is passed over and doesn't end the filling."""
    fits = ~F.col("more") & (F.col("size") <= F.col("gap"))
    rows = rows.withColumn("fit", F.when(fits, F.col("size")).otherwise(0))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("key", "bucket").agg(F.sum("fit").alias("words")).select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("u", "doc_id", "v", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.join(sums, ["key", "bucket"]).withColumn("upto", F.col("base") + F.sum("fit").over(inside)).withColumn("now", fits & (F.col("upto") <= F.col("gap")))
    ran = materialize(ran.drop("base", "fit"), "ran")
    left = ran.groupBy("key").agg(F.first("n_rows").alias("n"), (F.first("gap") - F.coalesce(F.max(F.when(F.col("now"), F.col("upto"))), F.lit(0))).alias("left"))
    out = hot_join(ran, materialize(left, "left"), ["key"], "n", total)
    return out.withColumn("more", F.col("more") | F.col("now")).withColumn("gap", F.col("left")).drop("n", "left", "upto", "now")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """How often each document enters the mix: doc_id, size, source_size, target, repeats, taken, row_no, which is row_col if that is given.

    A source whose target is e times its size gives every document floor(e) times. The fraction is filled in a seeded
    order: documents come once more as long as they fit, those larger than the whole fraction being passed over; what
    is left is filled in the same way once again, with the documents that fit there; and at last the one document
    whose size is nearest to what is left comes, if that is nearer than none. The running sums of a source, which may
    hold a third of all rows, are taken in buckets of about BUCKET_ROWS rows.

    The size is the number of words; a null or empty text has none, adds nothing and fits in any rest. Null is a source of its own,
    last in the order. Repeated rows are rows like others, also if they are a great part of a source, as are null
    identifiers. An empty table gives an empty result. Other columns are not read.
    """
    rows = materialize(
        docs.select(
            row_number(row_col).alias("row_no"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))),
        "sizes",
    )
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = materialize(
        water_fill(sources, weights, share, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("key", "source_size", "n_rows", "target", F.floor("epochs").alias("whole"), F.ceil(F.col("n_rows") / BUCKET_ROWS).alias("buckets")),
        "plan",
    )
    total = plan.agg(F.sum("n_rows")).first()[0] or 0
    # A seeded order that any engine can compute: 52 bits of an MD5; v orders rows of one identifier.
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)
    joined = hot_join(rows.drop("source"), plan, ["key"], "n_rows", total).withColumn("u", order).withColumn("v", unit(F.col("row_no")))
    # A source at its cap has no fraction, and nothing fits in a gap below nothing.
    gap = F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(-1.0)
    joined = materialize(joined.withColumn("more", F.lit(False)).withColumn("gap", gap), "mixrows")
    ran = materialize(_bucketed(joined, total), "bucketed")
    for _ in range(FILLS):
        ran = materialize(_filled(ran, total), "filled")
    miss = F.abs(F.col("size") - F.col("gap"))
    nearest = ran.filter(~F.col("more") & (miss < F.col("gap"))).groupBy("key").agg(F.min(F.struct(miss.alias("miss"), "u", "doc_id", "v", "row_no")).alias("one"))
    last = nearest.select(F.col("one.row_no").alias("row_no"), F.lit(True).alias("last"))
    repeats = (F.col("whole") + F.when(F.col("more") | F.coalesce("last", F.lit(False)), 1).otherwise(0)).cast("long")
    ran = ran.join(materialize(last, "last"), "row_no", "left")
    return ran.withColumn("repeats", repeats).select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "row_no")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() says. Rows go by number, so identifiers may repeat or be null."""
    columns = docs.columns
    docs, row = numbered(docs)
    again = unused(docs, "times")
    times = mix(docs, row_col=row, **how).filter("repeats > 0").select(F.col("row_no").alias(row), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias(again))
    return docs.join(times, row).select(*[docs[c] for c in columns])
