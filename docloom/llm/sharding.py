"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents (here: equal texts) should share a shard while shards stay even. The state of a
round is how many documents of each group stand in each shard; members of a group in one shard
are alike, so the state stays small however large a group is. Round by round each group's parts
ask to move to the shard that holds most of the group, and shards accept as far as their quota and
what asks to leave them make room, so full shards swap. What is still split after the last round
goes to the shard that holds most of it. The documents are then laid out shard by shard, each group
in one stretch between unlinked documents, and cut at the exact quotas: whatever the labels, a
border splits one group at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

N_SHARDS = 8
#: Rounds of propagation at most; the layout makes whole what they leave split.
MAX_ROUNDS = 10
#: Requests to one shard are accepted in this many pseudorandom lots, so no shard's requests meet in one task.
LOTS = 256
#: Documents of one bucket of the layout.
BUCKET_ROWS = 10_000


def _share(key: Column, n: int | Column) -> Column:
    return F.pmod(key, F.lit(n) if isinstance(n, int) else n).cast("int")


def propagate(parts: DataFrame, total: int, n_shards: int, kept: Kept) -> DataFrame:
    """(grp, shard, n) after moves that make groups whole, as far as shards have or free room.

    Every move takes a part to the shard with most of its group, so groups only get less split;
    rounds end when nothing moves. A shard that frees less than it was asked to is over its quota
    for a round, and takes in nothing until it is below again.
    """
    quota = -(-total // n_shards)
    state = parts
    for round_no in range(MAX_ROUNDS):
        best = Window.partitionBy("grp").orderBy(F.desc("n"), F.xxhash64("grp", "shard"))
        want = state.withColumn("to", F.first("shard").over(best))  # at most n_shards rows a group
        load = state.groupBy("shard").agg(F.sum("n").alias("load"))
        asks = want.filter("shard <> to").withColumn("lot", _share(F.xxhash64("grp", F.lit(round_no)), LOTS))
        # small groups first: they are made whole with the fewest documents moved
        asks = asks.withColumn("class", F.ceil(F.log2(F.col("n") + 1)).cast("int"))
        lots = asks.groupBy("to", "class", "lot").agg(F.sum("n").alias("sum"))
        so_far = Window.partitionBy("to").orderBy("class", "lot").rowsBetween(Window.unboundedPreceding, -1)
        lots = lots.withColumn("before", F.coalesce(F.sum("sum").over(so_far), F.lit(0)))
        leaving = asks.groupBy("shard").agg(F.sum("n").alias("leaving"))
        load = load.join(leaving, "shard", "left").withColumn("load", F.col("load") - F.coalesce("leaving", F.lit(0)))
        lots = lots.join(F.broadcast(load.select(F.col("shard").alias("to"), "load")), "to", "left")
        room = F.greatest(F.lit(0), quota - F.coalesce("load", F.lit(0)) - F.col("before"))
        # a lot that fits only in part is accepted in that proportion
        lots = lots.select("to", "class", "lot", F.least(F.lit(1.0), room / F.col("sum")).alias("part")).filter("part > 0")
        # at most n_shards * LOTS * 64 rows whatever the input
        moved = asks.join(F.broadcast(lots), ["to", "class", "lot"]).withColumn("go", F.floor(F.col("n") * F.col("part")))
        moved = kept(moved.filter("go > 0").select("grp", "shard", "to", "go"))
        if moved.isEmpty():
            break
        change = moved.select("grp", F.col("to").alias("shard"), F.col("go").alias("n")).unionByName(
            moved.select("grp", "shard", (-F.col("go")).alias("n"))
        )
        new = state.unionByName(change).groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        state = kept(new)
    return state


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``.

    Law ``rows``: counts of any two shards differ by one at most. Size is the text's UTF-8 bytes
    plus 1. Documents with equal texts are linked, a null text with none (size 1, CRC32 of the
    empty text). A group goes into one shard; one that outgrows a shard fills whole shards, and at
    most one group is split at each border between shards, also where all rows are linked. slot counts from 0 within a shard.
    Repeated rows are rows like others, null doc_ids come first. An empty table gives no rows.
    """
    kept = Kept(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = kept(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5("text").alias("grp"),
        F.xxhash64("doc_id").alias("h"),
    ))
    total = rows.count()
    parts = rows.filter("grp IS NOT NULL").groupBy("grp", _share(F.col("h"), n_shards).alias("shard")).agg(F.count("*").alias("n"))
    size = parts.groupBy("grp").agg(F.sum("n").alias("members")).filter("members > 1")
    parts = kept(parts.join(size.select("grp"), "grp"))
    state = propagate(parts, total, n_shards, kept)
    most = F.struct("n", F.xxhash64("grp", "shard"))
    homes = kept(state.groupBy("grp").agg(F.max_by("shard", most).alias("home"), F.sum("n").alias("members")))
    placed = rows.join(homes, "grp", "left")
    linked = F.col("members").isNotNull()
    load = {r["shard"]: r["n"] for r in homes.groupBy(F.col("home").alias("shard")).agg(F.sum("members").alias("n")).collect()}  # n_shards rows
    room = [max(0, -(-total // n_shards) - load.get(t, 0)) for t in range(n_shards)]
    spot, label_alone, sum_room = _share(F.col("h"), max(1, sum(room))), F.lit(n_shards - 1), sum(room)
    for t in reversed(range(n_shards)):
        sum_room -= room[t]
        label_alone = F.when(spot < sum_room, label_alone).otherwise(t)
    label = F.when(linked, F.col("home")).otherwise(label_alone)
    # a bucket is a run of the layout: a large group has its own, cut by hash, small groups share
    n_buckets = 1 + total // BUCKET_ROWS
    shared = _share(F.xxhash64("grp"), n_buckets)
    large = F.col("members") > BUCKET_ROWS
    placed = placed.select(
        "doc_id", "size", "text_crc32", "grp", "h", label.alias("label"),
        # unlinked documents stand at both ends of a shard, where the exact borders will fall
        F.when(linked, 1).otherwise(2 * _share(F.shiftright("h", 8), 2)).alias("alone"),
        F.when(linked, shared).otherwise(_share(F.shiftright("h", 16), n_buckets)).alias("bucket"),
        F.when(large, F.col("grp")).alias("own"),
        F.when(large, _share(F.shiftright("h", 32), (F.col("members") / BUCKET_ROWS).cast("int") + 1)).otherwise(0).alias("sub"),
    )
    run = ["label", "alone", "bucket", "own", "sub"]
    counts = placed.groupBy(*run).agg(F.count("*").alias("n"))
    before = _running(counts, total)
    within = Window.partitionBy(*run).orderBy("grp", "doc_id", "h")
    nth = placed.withColumn("nth", F.row_number().over(within) - 1)
    same = [nth[c].eqNullSafe(before[c]) for c in run]
    laid = nth.join(before, same).select(nth["doc_id"], "size", "text_crc32", (F.col("before") + F.col("nth")).alias("at"))
    shard = F.floor(F.col("at") * n_shards / F.lit(total)).cast("int")
    first = F.ceil(F.col("shard") * F.lit(total) / n_shards).cast("long")
    return laid.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _running(counts: DataFrame, total: int) -> DataFrame:
    """Documents before each run of the layout: per shard first, then within it, so one task holds one shard's runs."""
    order = [F.col("alone"), F.col("bucket"), F.col("own").asc_nulls_first(), F.col("sub")]
    shards = counts.groupBy("label").agg(F.sum("n").alias("all"))
    up_to = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.select("label", F.coalesce(F.sum("all").over(up_to), F.lit(0)).alias("base"))
    inside = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = counts.join(F.broadcast(shards), "label")
    return joined.select("label", "alone", "bucket", "own", "sub", (F.col("base") + F.col("inside")).alias("before"))
