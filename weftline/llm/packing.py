"""Texts into containers of fixed capacity by planning over the histogram of lengths.

Sizes are counted, best fit runs over counts (so its work depends on the number
of different sizes, at most the capacity, not of documents), and each document
takes the planned slot of its rank among the documents of its size. Ranks are
counted in parts by hash, the more the more rows there are, so that a size that a third of all documents share is
no single task's work.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPACITY = 8_192
#: The documents of one size are ranked in parts, as many as the table has so many rows, and at least LEAST_PARTS.
PART_ROWS, LEAST_PARTS = 250_000, 16
#: Slots of a plan up to which it is broadcast (24 bytes each); a longer plan is joined in SALTS parts.
BROADCAST_SLOTS, SALTS = 1_000_000, 64


def byt5_size(text: Column) -> Column:
    """ByT5 tokens of a text: its UTF-8 bytes and one end token."""
    return F.octet_length(text) + 1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (size, first rank, last rank, first container, items of the size in each container) by best fit over counts, largest size first.

    Containers with the same content are kept as one group; a group splits when
    only some of its containers get another item.
    """
    open_groups: dict[int, list[list[int]]] = {}
    spaces: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in open_groups:
                open_groups[space] = []
                bisect.insort(spaces, space)
            open_groups[space].append([first, count])

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):
                each = capacity // size
                full, rest = divmod(left, each)
                for count, per in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        slots.append((size, rank, rank + count * per - 1, made, per))
                        put(capacity - per * size, made, count)
                        made, rank, left = made + count, rank + count * per, left - count * per
                continue
            space = spaces[at]
            group = open_groups[space].pop()
            if not open_groups[space]:
                del open_groups[space]
                spaces.pop(at)
            per = min(space // size, left)
            used = min(group[1], left // per)
            slots.append((size, rank, rank + used * per - 1, group[0], per))
            put(space - per * size, group[0], used)
            put(space, group[0] + used, group[1] - used)
            rank, left = rank + used * per, left - used * per
    return slots


def pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, n_tokens): each document whole as piece 0, or cut into full containers and a rest if it exceeds the capacity.

    A null text counts as empty (one end token); rows without an id are left out, repeated ids once with their longest text.
    """
    size = F.coalesce(byt5_size(F.col("text")), F.lit(1))
    sized = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(size).cast("long").alias("size"))
    last = F.ceil(F.col("size") / capacity).cast("int") - 1
    return sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "doc_id", "piece_no", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_no").cast("long") * capacity).alias("n_tokens"))


def packed(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id): every piece with its container; no container holds more than the capacity."""
    spark = documents.sparkSession
    parts = max(LEAST_PARTS, documents.count() // PART_ROWS)
    items = pieces(documents, capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    counts = items.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("n_tokens", "part", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("n")).alias("offset"))
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}
    rows = plan(histogram, capacity) or [(0, 0, 0, 0, 1)]
    slots = spark.createDataFrame(rows, "n_tokens long, low long, high long, container long, per long").groupBy("n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("low", "high", "container", "per"))).alias("slots"))
    rank = (F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece_no")) - 1 + F.col("offset")).alias("rank")
    ranked = items.join(offsets, ["n_tokens", "part"]).select("doc_id", "piece_no", "n_tokens", rank, F.pmod("part", F.lit(SALTS)).alias("salt"))
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") <= s["high"]))[0]
    if len(rows) <= BROADCAST_SLOTS:
        placed = ranked.join(F.broadcast(slots), "n_tokens")
    else:
        placed = ranked.join(slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["n_tokens", "salt"])
    return placed.withColumn("slot", slot).select(
        "doc_id", "piece_no", "n_tokens", (F.col("slot.container") + F.floor((F.col("rank") - F.col("slot.low")) / F.col("slot.per"))).cast("long").alias("container_id"))


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs for that many tokens, and the share filled."""
    total = assigned.agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    return total.select("n_containers", "n_pieces", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
                        F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity).alias("filled"))
