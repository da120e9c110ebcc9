"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows stand in a pseudo-random order and are cut into blocks. A period of the mix has ``sum(weights)`` slots;
a source of weight w releases its block j of a period at floor(j * slots / w), due by ceil((j + 1) * slots / w), and the earliest
deadline among released blocks takes each slot. One processor at full load meets all such deadlines, so at every slot
each source has had its share of blocks to within less than one block.

When a source ends, the remaining ones keep their proportions: a period's composition is what its sources have left, at
most their weights, so there are at most two more compositions than ends of sources, and only these few periods are
scheduled (by a fold over an array). Every row then finds its slot by arithmetic and one join with that bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlake.session import cut_lineage

BLOCK_ROWS = 64
BUCKET_ROWS = 20_000  # rows that are ranked together, about
MOST_SLOTS = 10_000
HOT = 4  # times the usual rows of a bucket: only rows that share an id can be so many
SPLIT_BITS = 12
MOST_BROADCAST = 1_000_000  # rows of a plan, by its bound, up to which it is sent to all tasks


def _edf(q: Column, slots: Column) -> Column:
    """The picks of a period, one for each slot: which stream, and its how-manieth block. ``q``: blocks of each stream."""

    def ceiling(a: Column, b: Column) -> Column:
        return F.floor((a + b - 1) / b)

    def step(state: Column, slot: Column) -> Column:
        waiting = F.transform(
            q,
            lambda n, i: F.when(
                (state["served"][i] < n) & (F.floor(state["served"][i] * slots / F.greatest(n, F.lit(1))) <= slot),
                F.struct(ceiling((state["served"][i] + 1) * slots, n).alias("due"), i.alias("stream")),
            ),
        )
        pick = F.array_min(F.filter(waiting, lambda x: x.isNotNull()))["stream"]
        served = F.transform(state["served"], lambda n, i: n + (i == pick).cast("long"))
        picks = F.concat(state["picks"], F.array(F.struct(pick.cast("int").alias("stream"), state["served"][pick].alias("nth"))))
        return F.struct(served.alias("served"), picks.alias("picks"))

    start = F.struct(F.transform(q, lambda n: F.lit(0).cast("long")).alias("served"), F.expr("cast(array() as array<struct<stream:int,nth:bigint>>)").alias("picks"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step, lambda state: state["picks"])


def schedule(counts: DataFrame, weights: list[int], block_rows: int) -> DataFrame:
    """Where each block of each kind of period stands. ``counts``: stream (number), n (rows).

    stream, nth (block of the period), low and high (the periods of the kind, high excluded), first (slot of the first
    of them), slots (of each), at (slot in the period). At most (2 * streams + 1) * sum(weights) rows.
    """
    n = F.map_from_entries(F.collect_list(F.struct("stream", "n")))
    blocks = F.array(*[F.ceil(F.coalesce(F.col("n")[F.lit(k)], F.lit(0)) / F.lit(block_rows)).cast("long") for k in range(len(weights))])
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    ends = F.zip_with("blocks", w, lambda b, x: F.floor(b / x))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), ends, F.transform(ends, lambda x: x + 1))))
    one = counts.agg(n.alias("n")).select(blocks.alias("blocks")).select("blocks", bounds.alias("bounds"))
    kinds = one.select("blocks", "bounds", F.posexplode("bounds").alias("k", "low")).where(F.col("k") < F.size("bounds") - 1)
    q = F.zip_with("blocks", w, lambda b, x: F.greatest(F.lit(0).cast("long"), F.least(x, b - F.col("low") * x)))
    kinds = kinds.select("low", F.element_at("bounds", F.col("k") + 2).alias("high"), q.alias("q"))
    kinds = kinds.withColumn("slots", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)).where("slots > 0")
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("first", F.coalesce(F.sum((F.col("high") - F.col("low")) * F.col("slots")).over(before), F.lit(0)))
    picks = kinds.select("low", "high", "first", "slots", F.posexplode(_edf(F.col("q"), F.col("slots"))).alias("at", "pick"))
    return picks.select("low", "high", "first", "slots", "at", "pick.stream", "pick.nth")


def mix(docs: DataFrame, weights: dict[str, int], *, other: int = 1, id_column: str = "doc_id", source_column: str = "source",
        block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """row (a struct of the input's columns), stream, block (of its stream), slot and place: the mix is by (slot, place).

    ``weights`` are whole numbers; sources they do not name, and null, form one stream of weight ``other``. Every input row
    comes out once: repeated rows too, in any order among themselves. Rows of a stream stand by a hash of their id (of the
    whole row if it is null), then id, then row hash; where repeated ids fill a bucket, it stands by parts of the row hash
    first. An empty table gives an empty result. The struct keeps columns of
    any name apart from the added ones.
    """
    if not all(isinstance(x, int) and x > 0 for x in [other, *weights.values()]) or sum(weights.values()) + other > MOST_SLOTS:
        raise ValueError(f"weights must be positive whole numbers with a sum of at most {MOST_SLOTS}")
    names = sorted(weights)
    all_weights = [*(weights[x] for x in names), other]
    number = F.lit(len(names))
    for k, name in enumerate(names):
        number = F.when(F.col(source_column) == name, F.lit(k)).otherwise(number)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), whole.cast("string")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), number.alias("stream"), key.alias("key"), F.col(id_column).alias("id"), whole.alias("whole"))
    total = rows.count()
    bits = max(0, (max(1, total) // bucket_rows).bit_length())
    bucket = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(1 << bits) / F.lit(float(1 << 32))
    rows = rows.withColumn("bucket", F.floor(bucket) * F.lit(1 << SPLIT_BITS))
    sizes = cut_lineage(rows.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n")))
    hot = sizes.where(F.col("n") > HOT * bucket_rows)
    if not hot.isEmpty():  # the rows of one id are many: such a bucket is split by row hash
        fine = F.when(F.col("n").isNotNull(), F.pmod("whole", F.lit(1 << SPLIT_BITS))).otherwise(F.lit(0))
        rows = rows.join(hot, ["stream", "bucket"], "left").withColumn("bucket", F.col("bucket") + fine).drop("n")
        sizes = cut_lineage(rows.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stream", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("stream", "bucket").orderBy("key", "id", "whole")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["stream", "bucket"])
    rank = F.col("rank") + F.col("offset")
    w = F.array(*[F.lit(x).cast("long") for x in all_weights])[F.col("stream")]
    block = F.floor(rank / block_rows)
    ranked = ranked.select("row", "stream", block.alias("block"), (rank % block_rows).cast("int").alias("place"))
    ranked = ranked.withColumn("period", F.floor(F.col("block") / w)).withColumn("nth", F.col("block") % w)
    plan = schedule(sizes.groupBy("stream").agg(F.sum("n").alias("n")), all_weights, block_rows)
    bound = (2 * len(all_weights) + 1) * sum(all_weights)  # rows of the plan, by the weights alone
    plan = F.broadcast(plan) if bound <= MOST_BROADCAST else plan
    found = ranked.join(plan, ["stream", "nth"]).where("period >= low and period < high")
    slot = F.col("first") + (F.col("period") - F.col("low")) * F.col("slots") + F.col("at")
    return found.select("row", "stream", "block", slot.alias("slot"), "place")


def in_mixed_order(docs: DataFrame, weights: dict[str, int], **how) -> DataFrame:
    """The input's rows and columns, range-partitioned and sorted by their place in the mix."""
    return mix(docs, weights, **how).orderBy("slot", "place").select("row.*")


#: For DuckDB: the same mix of ``documents`` with ids that are never null. {names}, {weights}, {block} are filled in.
SQL = """
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce(nullif(list_position({names}, source), 0), len({names}) + 1) AS stream FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stream ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rnk FROM keyed
), streams AS (
  SELECT s.stream, {weights}[s.stream] AS w, CAST(ceil(coalesce(c.n, 0) / CAST({block} AS DOUBLE)) AS BIGINT) AS blocks
  FROM (SELECT unnest(range(1, len({weights}) + 1)) AS stream) s
  LEFT JOIN (SELECT stream, count(*) AS n FROM keyed GROUP BY stream) c USING (stream)
), bounds AS (
  SELECT DISTINCT unnest([0, blocks // w, blocks // w + 1]) AS low FROM streams
), kinds AS (
  SELECT low, high, list(greatest(0, least(w, blocks - low * w)) ORDER BY stream) AS q,
         CAST(sum(greatest(0, least(w, blocks - low * w))) AS BIGINT) AS slots
  FROM (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM bounds) b, streams WHERE high IS NOT NULL GROUP BY low, high
), placed AS (
  SELECT *, coalesce(sum((high - low) * slots) OVER (ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM kinds WHERE slots > 0
), picks AS (
  SELECT low, -1 AS spot, list_transform(q, lambda x: 0) AS served, 0 AS stream, 0 AS nth FROM placed
  UNION ALL
  SELECT low, spot, list_transform(range(1, len(served) + 1), lambda i: served[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, served[pick]
  FROM (
    SELECT p.low, p.spot + 1 AS spot, p.served, list_min(list_filter(list_transform(range(1, len(k.q) + 1), lambda i: CASE
        WHEN p.served[i] < k.q[i] AND p.served[i] * k.slots // k.q[i] <= p.spot + 1
        THEN {{'due': ((p.served[i] + 1) * k.slots + k.q[i] - 1) // k.q[i], 'stream': i}} END), lambda x: x IS NOT NULL)).stream AS pick
    FROM picks p JOIN placed k USING (low) WHERE p.spot + 1 < k.slots
  )
)
SELECT r.doc_id, r.source, r.rnk // {block} AS block,
       CAST(k.first + (r.rnk // {block} // {weights}[r.stream] - k.low) * k.slots + p.spot AS BIGINT) AS slot, CAST(r.rnk % {block} AS INTEGER) AS place
FROM ranked r
JOIN placed k ON r.rnk // {block} // {weights}[r.stream] >= k.low AND r.rnk // {block} // {weights}[r.stream] < k.high
JOIN picks p ON p.low = k.low AND p.stream = r.stream AND p.spot >= 0 AND p.nth = r.rnk // {block} % {weights}[r.stream]
"""


def oracle(weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> str:
    names = sorted(weights)
    return SQL.format(names="[" + ", ".join(f"'{x}'" for x in names) + "]", weights="[" + ", ".join(str(x) for x in [*(weights[n] for n in names), other]) + "]", block=block_rows)
