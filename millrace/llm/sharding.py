"""Sharding by fixed virtual slots.

A record's slot is a hash of its id over a number of slots that never changes. Bytes are added up per slot, and a map
from slot to shard is built (heaviest slot first, to the lightest shard) or, later, edited: `rebalance` moves as few
slots as the new loads call for and gives the map a new version. Records are never rehashed.

Edge cases: a null text has no bytes; a text of any length is one record; a null id hashes by its text, so all records
without either are one slot, of which a record is the least part that can move; equal rows are counted and get neighbouring
places; an empty table gives no rows; other columns may have any name, and are kept by `assigned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.native import free_name, quoted, text_of, utf8_bytes
from millrace.session import materialize

#: Slots; thousands, so that one slot is a small part of any shard. Part of the data's layout: never change it.
SLOTS = 4096
#: What each record costs besides its text: its length field.
RECORD_OVERHEAD = 8
#: Number of pieces each slot is dealt into while places are numbered, so that no task holds a whole slot.
PIECES = 16


def slot_of(id_col: Column, text_col: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(id_col.isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col.cast("string"))), F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One slim row per record: id, size, checksum, virtual slot."""
    text = text_of(F.col(quoted(text_col)))
    return docs.select(
        F.col(quoted(id_col)).alias("id"),
        (utf8_bytes(F.col(quoted(text_col))) + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        slot_of(F.col(quoted(id_col)), text, slots).alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _deal(slots: DataFrame, loads: Column, version: int) -> DataFrame:
    """Give each of the listed slots (at most SLOTS rows) to the shard that is lightest when its turn comes."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("virtual_slot"))))

    def step(acc: Column, x: Column) -> Column:
        lightest = F.element_at(acc["loads"], 1)
        grown = F.struct((lightest["load"] - x["neg"]).alias("load"), lightest["shard"].alias("shard"))
        rest = F.slice(acc["loads"], F.lit(2), F.size(acc["loads"]) - 1)
        return F.struct(
            F.array_sort(F.concat(rest, F.array(grown))).alias("loads"),
            F.concat(acc["dealt"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), lightest["shard"].alias("shard")))).alias("dealt"),
        )

    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    start = F.struct(F.array_sort(loads).alias("loads"), none.alias("dealt"))
    dealt = slots.agg(F.aggregate(order, start, step)["dealt"].alias("dealt"))
    return dealt.select(F.inline("dealt")).withColumn("version", F.lit(version))


def build_map(totals: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(virtual_slot, shard, version) for every slot that has rows; at most SLOTS rows whatever the input's size."""
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.lit(0).cast("long").alias("load"), s.alias("shard")))
    return _deal(totals, loads, version)


def rebalance(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Edit a map for new loads or another number of shards, as its next version.

    A slot stays where it is while its shard, filled heaviest slot first, is within an equal share; what is over, new, or
    on a shard that no longer exists goes to the lightest shards.
    """
    was = current.select("virtual_slot", F.col("shard").alias("was"), F.col("version").alias("old"))
    rows = totals.join(was, "virtual_slot", "left")
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / F.lit(shards))
    filled = F.sum("bytes").over(Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", share.alias("share"), filled.alias("filled"))
    stays = F.col("was").isNotNull() & (F.col("was") < shards) & (F.col("filled") <= F.col("share"))
    rows = materialize(rows.withColumn("stays", stays))
    version = (current.agg(F.max("version")).first()[0] or 0) + 1
    kept = rows.where("stays")
    all_shards = kept.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = all_shards.join(kept.groupBy(F.col("was").alias("shard")).agg(F.sum("bytes").alias("load")), "shard", "left")
    listed = loads.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0).cast("long")).alias("load"), "shard"))).alias("l")).first()["l"]
    literal = F.array(*[F.struct(F.lit(x["load"]).cast("long").alias("load"), F.lit(x["shard"]).alias("shard")) for x in listed])
    moved = _deal(rows.where(~F.col("stays")), literal, version)
    return kept.select("virtual_slot", F.col("was").alias("shard"), F.lit(version).alias("version")).unionByName(moved)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Versions are kept side by side: readers of an older layout still find theirs."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == F.lit(version))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every record, and its place in the shard: gapless from 0.

    Records equal in id, size and checksum are counted first. Places are offsets of pieces of slots (at most SLOTS * PIECES
    sums) plus a number inside the piece, so that no shard is ever sorted as a whole, nor are copies.
    """
    units = rows.groupBy("virtual_slot", "id", "crc", "size").agg(F.count("*").alias("copies"))
    units = units.withColumn("piece", F.pmod(F.xxhash64("id", "crc", F.lit("piece")), F.lit(PIECES)).cast("int"))
    sums = units.groupBy("virtual_slot", "piece").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sums.join(F.broadcast(slot_map), "virtual_slot").withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most SLOTS * PIECES rows, whatever the input.
    pieces = F.broadcast(pieces.select("virtual_slot", "piece", "shard", "version", "offset"))
    ahead = Window.partitionBy("virtual_slot", "piece").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("inside", F.coalesce(F.sum("copies").over(ahead), F.lit(0))).join(pieces, ["virtual_slot", "piece"])
    first = F.col("offset") + F.col("inside")
    return units.select("id", "size", "crc", "virtual_slot", "shard", "version", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, crc, virtual_slot, shard, version, slot for every record of docs."""
    rows = materialize(measured(docs, id_col, text_col, slots))
    slot_map = materialize(build_map(slot_bytes(rows), shards))
    return place(rows, slot_map)


def assigned(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs with virtual_slot, shard and map_version: texts are not moved, since the map (SLOTS rows at most) is broadcast.

    A column that docs has under one of these names is kept as input_<name>.
    """
    slot_map = materialize(build_map(slot_bytes(measured(docs, id_col, text_col, slots)), shards))
    at, of_map = free_name(docs, "at"), free_name(docs, "map")
    found = F.struct("shard", "version").alias(of_map)
    keyed = docs.withColumn(at, slot_of(F.col(quoted(id_col)), text_of(F.col(quoted(text_col))), slots))
    joined = keyed.join(F.broadcast(slot_map.select(F.col("virtual_slot").alias(at), found)), at)
    ours = {"virtual_slot": F.col(at), "shard": F.col(of_map)["shard"], "map_version": F.col(of_map)["version"]}
    own = [F.col(quoted(c)).alias(free_name(docs, c, "input_")) if c.lower() in ours else F.col(quoted(c)) for c in docs.columns]
    return joined.select(*own, *(value.alias(name) for name, value in ours.items()))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
