"""The library store: documents, solution history and settings as tables that operations map to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import scratch

LISTED = ["id", "title", "subject", "grade", "chapter", "semester", "doc_type", "created_at", "updated_at"]


def last_write_wins(rows: DataFrame, key: str, version: str) -> DataFrame:
    """For each key its row of the highest version. The maximum of a struct is combined before the shuffle, so a key with
    very many versions is one row a task."""
    rest = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__best"))
    return best.select(*[F.col(key) if c == key else F.col(f"__best.{c}").alias(c) for c in rows.columns])


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with the rows of incoming in place of those with the same key; incoming has a key once."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def numbered(rows: DataFrame, order: str, name: str, first: Column) -> DataFrame:
    """rows with `name`, counting on from `first` in the order of a column. Rows are cut into ranges and stored, ranges
    are counted, and each is numbered by itself, so no task has all rows."""
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(order)
    return cut.join(F.broadcast(parts), "__part").withColumn(name, first + F.col("__before") + F.row_number().over(inside)).drop("__part", "__before")


def seed_settings(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """Defaults for keys that are not set."""
    return current.unionByName(defaults.join(current, "key", "left_anti"))


def save_documents(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Documents saved: those with an id replace its row but for created_at, those without get the next ids in `seq` order.

    incoming: the store's columns but the two times, and seq. Missing fields get the store's defaults.
    """
    filled = incoming.withColumns({"subject": F.coalesce("subject", F.lit("Vật lý")), "chapter": F.coalesce("chapter", F.lit("")), "semester": F.coalesce("semester", F.lit("")), "doc_type": F.coalesce("doc_type", F.lit(S.OTHER_DOCUMENT))})
    is_new = F.coalesce("id", F.lit(0)) == 0
    top = current.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(filled.filter(is_new).drop("id"), "seq", "id", F.lit(top))
    updates = last_write_wins(filled.filter(~is_new), "id", "seq")
    old = current.select("id", F.col("created_at").alias("__created"))
    changed = updates.join(old, "id").withColumn("created_at", F.col("__created"))
    rows = new.withColumn("created_at", now).unionByName(changed.drop("__created")).withColumn("updated_at", now).select(*current.columns)
    return upsert(current, rows, "id")


def list_documents(documents: DataFrame, grade: int | None = None, doc_type: str | None = None, search: str | None = None) -> DataFrame:
    """The listing without content, newest first, ids breaking ties; a filter that is empty or 0 is none. The search is a
    pattern over title or chapter where % and _ are wildcards; case is folded for all letters."""
    out = documents.select(*LISTED)
    if grade:
        out = out.filter(F.col("grade") == grade)
    if doc_type:
        out = out.filter(F.col("doc_type") == doc_type)
    if search:
        out = out.filter(F.col("title").ilike(f"%{search}%") | F.col("chapter").ilike(f"%{search}%"))
    return out.orderBy(F.desc("updated_at"), F.desc("id"))


def get_document(documents: DataFrame, doc_id: int) -> DataFrame:
    """The row of a document with its content parsed."""
    return documents.filter(F.col("id") == doc_id).withColumn("content", F.from_json(F.coalesce(F.nullif(F.col("content_json"), F.lit("")), F.lit("{}")), S.DOCUMENT))


def delete_documents(documents: DataFrame, history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents (ids: id) and what hangs on them."""
    return documents.join(ids, "id", "left_anti"), history.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*history.columns)


def settings_map(settings: DataFrame) -> DataFrame:
    return settings.select(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def masked_settings(settings: DataFrame) -> DataFrame:
    """Values of keys that hold the word key are hidden unless empty."""
    hide = F.contains(F.col("key"), F.lit("key")) & (F.coalesce("value", F.lit("")) != "")
    return settings.select("key", F.when(hide, F.lit("***")).otherwise(F.col("value")).alias("value"))


def update_settings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """current with incoming values, but an empty or hidden value never replaces that of a key that holds the word key."""
    known = current.select("key", F.col("value").alias("__old"))
    keep_old = F.contains(F.col("key"), F.lit("key")) & (F.coalesce("__old", F.lit("")) != "") & F.col("value").isin("***", "")
    return upsert(current, incoming.join(known, "key", "left").filter(~keep_old).select("key", "value"), "key")


def append_history(history: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """history with new rows (its columns but id and created_at, and seq), numbered on."""
    top = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(rows, "seq", "id", F.lit(top)).withColumn("created_at", now)
    return history.unionByName(new.select(*history.columns))


def latest_history(history: DataFrame, document_id: int | None = None, limit: int = 50) -> DataFrame:
    out = history.filter(F.col("document_id") == document_id) if document_id else history
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def delete_history(history: DataFrame, history_id: int | None = None) -> DataFrame:
    """history without a row, or empty if no id is given."""
    return history.filter(F.col("id") != history_id) if history_id else history.limit(0)


def split_updates(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates (title, content_json) that may be stored, and the others with the reason."""
    content = F.from_json("content_json", S.DOCUMENT)
    reason = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit("no title")).when(F.coalesce(F.size(content["sections"]), F.lit(0)) <= 0, F.lit("no sections"))
    judged = updates.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
