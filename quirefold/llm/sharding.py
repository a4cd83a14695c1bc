"""Sharding by fixed virtual slots and a versioned slot-to-shard map, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import cut, small

#: Virtual slots, and how far from the mean the bytes of a shard may be before slots move.
SLOTS, TOLERANCE = 4096, 0.001


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map before any sizes are known: as many slots for each shard, within one."""
    return {v: v * shards // slots for v in range(slots)}


def rebalanced(old: dict[int, int], slot_bytes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The next version of a map: slots move, one at a time, from the fullest shard to the emptiest, until they are within tolerance of the mean.

    Only moves that narrow the gap are made; slots of shards that no longer exist move first. All other slots stay.
    """
    size = lambda v: slot_bytes.get(v, 0)
    load, held = [0] * shards, [[] for _ in range(shards)]
    new = dict(old)
    for v, s in old.items():
        if s < shards:
            load[s] += size(v)
            held[s].append(v)

    def place(v: int, s: int) -> None:
        new[v] = s
        load[s] += size(v)
        held[s].append(v)

    for v in sorted((v for v, s in old.items() if s >= shards), key=lambda v: (-size(v), v)):
        place(v, min(range(shards), key=lambda s: (load[s], s)))
    while True:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [v for v in held[high] if 0 < size(v) < gap]
        if gap <= 2 * tolerance * sum(load) / shards or not fits:
            return new
        v = min(fits, key=lambda v: (abs(size(v) - gap / 2), v))
        held[high].remove(v)
        load[high] -= size(v)
        place(v, low)


def map_frame(spark: SparkSession, placed: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, v, s) for v, s in sorted(placed.items())], "version int, vslot int, shard int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def store_map(spark: SparkSession, path: str, placed: dict[int, int]) -> int:
    """Append placed to the map table at path as its next version, which is returned; older versions stay readable."""
    version = 1 + (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) if _exists(spark, path) else 1
    map_frame(spark, placed, version).coalesce(1).write.mode("append").parquet(path)
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    table = spark.read.parquet(path)
    version = version if version is not None else table.agg(F.max("version")).first()[0]
    return {r["vslot"]: r["shard"] for r in table.where(F.col("version") == version).collect()}  # one row per slot


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with again: the place of a row among those that are equal to it, from 0. Rows that have no equal are not shuffled for it.

    Equal rows are numbered within the parts of the table that they were read in, and each part after the earlier ones, so many tasks share a row that is repeated often.
    """
    same = ["doc_id", "size", "text_crc32"]
    many = cut(rows.groupBy(*same).count().where("count > 1").drop("count"))
    if many.isEmpty():
        return rows.withColumn("again", F.lit(0).cast("long"))
    equal = [rows[c].eqNullSafe(F.col(f"m_{c}")) for c in same]
    renamed = small(many.select(*[F.col(c).alias(f"m_{c}") for c in same]))
    one = rows.join(renamed, equal, "left_anti").withColumn("again", F.lit(0).cast("long"))
    several = rows.join(renamed, equal, "left_semi")
    counts = cut(several.groupBy(*same, "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"m_{c}") for c in (*same, "part")], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = several.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1)
    numbered = numbered.join(counts, [*equal, numbered["part"] == F.col("m_part")])
    return one.unionByName(numbered.select(*rows.columns, (F.col("before") + F.col("nth")).cast("long").alias("again")))


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, placed: dict[int, int] | None = None, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """Every row's shard and its place in it: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    Law `bytes`: virtual slots get whole records by a hash of their key, size and checksum, and of their place among rows equal in these, so that a row repeated often is spread too.
    The map is the last version stored at map_path, or where there is none a map of as many slots for each shard, which is stored as version 1; it is
    edited by moving slots until the shards' bytes are even, and stored as the next version if any moved. A map given as placed is used as it is.
    slot numbers a shard's rows from 0 without gaps: rows are counted within virtual slots, which many tasks share, and start after the
    shard's earlier slots. Null keys and null texts (size 1) are rows like any other, repeated rows get different places. A
    map has one row per virtual slot, however large the input is.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = _told_apart(cut(rows)).drop("part", "row")
    own = F.xxhash64("doc_id", "size", "text_crc32")
    vslot = F.pmod(F.when(F.col("again") == 0, own).otherwise(F.xxhash64(own, "again")), F.lit(slots)).cast("int")
    rows = cut(rows.withColumn("vslot", vslot).drop("again"))
    held = {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}  # slots rows at most
    if placed is None:
        placed = _next_map(spark, map_path, {v: b for v, (b, _) in held.items()}, shards, slots)
    start, entries = [0] * (1 + max(placed.values(), default=0)), []
    for v, s in sorted(placed.items()):
        entries.append((v, s, start[s]))
        start[s] += held.get(v, (0, 0))[1]
    table = spark.createDataFrame(entries, "vslot int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(F.broadcast(table), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


def _next_map(spark: SparkSession, path: str | None, slot_bytes: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """The map for these bytes: the last stored version, edited; each version is stored before it is used."""
    if path is None:
        return rebalanced(even_map(shards, slots), slot_bytes, shards)
    if not _exists(spark, path):
        store_map(spark, path, even_map(shards, slots))
    last = load_map(spark, path)
    edited = rebalanced(last, slot_bytes, shards)
    if edited != last:
        store_map(spark, path, edited)
    return load_map(spark, path)
