"""Sharding over fixed virtual slots. DataFrame and SQL functions only.

Records are hashed into ``SLOTS`` slots, whose number never changes. Bytes are summed per slot, and a versioned map says which shard
holds which slot: the largest slots first, each to the shard with the fewest bytes so far. When shards are added the map is edited
(``rebalanced``): shards above the new mean hand slots to the new ones, all other slots stay, and the result is the next version.
So shards are near equal in bytes: the law ``bytes``.

What is gathered in one row is the map: ``SLOTS`` entries, whatever the size of the input. Rows of one id spread over slots by their content, so a
common or missing id fills no slot.

Defined cases: a missing text has no bytes and the checksum of an empty one; repeated rows share a slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableward.session import keep

SLOTS = 4096
#: Fixed value: bytes that each record takes besides its text.
RECORD_BYTES = 8


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc, size, text_crc32, virtual_slot) of each record."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = docs.select(F.col(id_col).alias("doc"), (F.octet_length(data) + RECORD_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return own.withColumn("virtual_slot", F.pmod(F.xxhash64("doc", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _greedy(slots: str, loads: str) -> str:
    """SQL: (slot, shard place) of each of ``slots``, in their order, to the place with the least load."""
    return f"""aggregate({slots}, named_struct('loads', {loads}, 'map', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
        (state, s) -> transform(array(cast(array_position(state.loads, array_min(state.loads)) - 1 as int)), k -> named_struct(
            'loads', transform(state.loads, (x, i) -> if(i = k, x + s.bytes, x)),
            'map', concat(state.map, array(named_struct('virtual_slot', s.virtual_slot, 'shard', k)))))[0]).map"""


def _dealt(slots: DataFrame, loads: str) -> DataFrame:
    in_order = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False)
    return slots.agg(in_order.alias("slots")).select(F.explode(F.expr(_greedy("slots", loads))).alias("m")).select("m.*")


def slot_map(totals: DataFrame, shards: int) -> DataFrame:
    """(version, virtual_slot, shard): the first version of the map. ``totals`` is ``slot_bytes``."""
    dealt = _dealt(totals, f"array_repeat(0L, {shards})")
    return dealt.select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of the map with ``shards`` shards, more than before.

    Each old shard keeps its largest slots while at least half of one fits the new mean, and hands on the rest; those are dealt to the
    new shards. Nothing moves between old shards. Slots that held nothing so far are dealt like empty ones.
    """
    before = current.agg((F.max("shard") + 1).alias("n"), F.max("version").alias("v")).first()
    old, version = before["n"], before["v"]
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    mine = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    known = totals.join(current.select("virtual_slot", "shard"), "virtual_slot", "left")
    judged = keep(known.withColumn("stays", F.col("shard").isNotNull() & (F.sum("bytes").over(mine) - F.col("bytes") / 2 <= mean)), "sharding-map")
    moved = _dealt(judged.filter(~F.col("stays")), f"array_repeat(0L, {shards - old})").withColumn("shard", F.col("shard") + old)
    return judged.filter("stays").select("virtual_slot", "shard").unionByName(moved).withColumn("version", F.lit(version + 1)).select("version", "virtual_slot", "shard")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per record: its id, size, text_crc32, virtual_slot, map version, shard and ``slot``, its place in the shard, gapless from 0."""
    records = keep(with_slots(docs, id_col, text_col, slots), "sharding-records")
    totals = keep(slot_bytes(records), "sharding-totals")
    placed = keep(slot_map(totals, shards), "sharding-map").join(totals, "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.select("virtual_slot", "version", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot").orderBy("doc", "text_crc32", "size")
    # the base has one row per slot
    out = records.withColumn("number", F.row_number().over(within)).join(base, "virtual_slot")
    return out.select(F.col("doc").alias(id_col), "size", "text_crc32", "virtual_slot", "version", "shard", (F.col("base") + F.col("number") - 1).alias("slot"))


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    out = shard(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
