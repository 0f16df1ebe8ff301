"""Balanced label propagation: documents move towards the shards of documents with the same text.

Documents with equal texts are linked. Members of one group within one shard are alike, so the
state is a table (group, shard, count), which aggregates before it shuffles: a group with a
third of all rows is at most 16 rows of it. Each iteration joins every group's rows with the
group's strongest shard that has room, and moves them under quotas: the demand for each pair of
shards is summed per hash bucket, and buckets are admitted as long as the target's room allows.
When moves cease, positions within shards are laid out, what exceeds a shard's capacity is split
off into free places, and documents without links fill up the rest. Law `rows`: counts of any
two shards differ by one at most.

All steps are DataFrame expressions. The driver sees sums per shard, and per pair of shards and
bucket: a fixed number of rows at any size. Ranks are taken in buckets and offset by the counts
of the buckets before, so no window holds a whole group.

Defined results: a null text counts as empty, of size 1; empty texts are equal texts; repeated
rows are placed each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanframe.llm.common import materialize, text_or_empty

SHARDS = 16
ITERATIONS = 4
BUCKETS = 64  # of groups, for quotas
SALTS = 16


def _by_shard(values: list[int], shard: str = "shard") -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(shard))


def _loads(state: DataFrame) -> list[int]:
    got = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("cnt")).collect()}
    return [got.get(k, 0) for k in range(SHARDS)]


def _start(groups: DataFrame) -> DataFrame:
    """Spread each group evenly from a shard that its hash picks."""
    step = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(SHARDS)) - 1)).alias("j")
    rows = groups.select("k", "n", step)
    cnt = F.floor(F.col("n") / SHARDS) + (F.col("j") < F.col("n") % SHARDS).cast("long")
    return rows.select("k", ((F.pmod("k", F.lit(SHARDS)) + F.col("j")) % SHARDS).cast("int").alias("shard"), cnt.cast("long").alias("cnt"))


def _quotas(demand: list, room: list[int]) -> dict[tuple[int, int], int]:
    """For each pair of shards the bucket before which moves are admitted."""
    wanted: dict[int, int] = {}
    for _, t, _, n in demand:
        wanted[t] = wanted.get(t, 0) + n
    limit: dict[tuple[int, int], int] = {}
    for s, t in sorted({(s, t) for s, t, _, _ in demand}):
        own = sorted((bucket, n) for a, b, bucket, n in demand if (a, b) == (s, t))
        left = room[t] * sum(n for _, n in own) // wanted[t]
        for bucket, n in own:
            left -= n
            if left < 0:
                break
            limit[s, t] = bucket + 1
    return limit


def propagate(state: DataFrame, capacity: list[int], iterations: int = ITERATIONS) -> DataFrame:
    """Move rows of (k, shard, cnt) to their groups' strongest shards with room."""
    for it in range(iterations):
        room = [max(0, c - n) for c, n in zip(capacity, _loads(state), strict=True)]
        # A shard is a target if it has room; ties go round by the group's hash, so that no shard draws them all.
        score = F.when(_by_shard(room) > 0, F.struct(F.col("cnt"), ((F.pmod(F.hash("k"), F.lit(SHARDS)) + F.col("shard")) % SHARDS).alias("tie"), F.col("shard").alias("to")))
        best = F.max(score).over(Window.partitionBy("k"))
        wish = state.select("*", best["to"].alias("to"), best["cnt"].alias("there"), F.pmod(F.hash("k"), F.lit(BUCKETS)).alias("bucket"))
        moving = (F.col("to") != F.col("shard")) & (F.col("there") >= F.col("cnt"))
        wish = wish.withColumn("to", F.when(moving, F.col("to")))
        demand = wish.filter("to is not null").groupBy("shard", "to", "bucket").agg(F.sum("cnt")).collect()
        limit = _quotas(demand, room)
        if not limit:
            break
        pair = F.col("shard") * SHARDS + F.col("to")
        table = F.create_map(*[F.lit(x) for (s, t), b in limit.items() for x in (s * SHARDS + t, b)])
        go = F.col("to").isNotNull() & (F.col("bucket") < F.coalesce(F.element_at(table, pair), F.lit(0)))
        moved = wish.select("k", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard"), "cnt")
        state = materialize(moved.groupBy("k", "shard").agg(F.sum("cnt").alias("cnt")), f"propagation {it}")
    return state


def _before(rows: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows before within `keys`; prefix sums of buckets, then within buckets."""
    rows = rows.withColumn("p", F.pmod(F.hash("k"), F.lit(1024)))
    part = rows.groupBy(*keys, "p").agg(F.sum(amount).alias("all"))
    part = part.select(*[F.col(k).alias(f"x_{k}") for k in keys], F.col("p").alias("x_p"), (F.sum("all").over(Window.partitionBy(*keys).orderBy("p")) - F.col("all")).alias("off"))
    own = F.sum(amount).over(Window.partitionBy(*keys, "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"x_{k}") for k in [*keys, "p"]])
    return rows.withColumn("own", own).join(part, on).withColumn(name, F.col("own") + F.col("off")).drop("own", "off", "p", *[f"x_{k}" for k in [*keys, "p"]])


def _segments(state: DataFrame, capacity: list[int]) -> tuple[DataFrame, list[int]]:
    """(k, segments): for ranks within a group the shard and first slot; and the places of each shard that they take.

    What lies beyond a shard's capacity goes to free places of other shards.
    """
    loads = _loads(state)
    over = [max(0, n - c) for c, n in zip(capacity, loads, strict=True)]
    free = [max(0, c - n) for c, n in zip(capacity, loads, strict=True)]
    over_at = [sum(over[:k]) for k in range(SHARDS)]
    free_at = [sum(free[:k]) for k in range(SHARDS)]
    rows = _before(state, ["shard"], ["k"], "cnt", "at")
    cap = _by_shard(capacity)
    inside = F.greatest(F.lit(0), F.least(F.col("cnt"), cap - F.col("at")))
    first = _by_shard(over_at) + F.greatest(F.lit(0), F.col("at") - cap)
    last = first + F.col("cnt") - inside
    parts = [F.struct(F.col("shard"), F.col("at").alias("slot"), inside.alias("cnt"))]
    for t in range(SHARDS):
        if free[t]:
            a = F.greatest(first, F.lit(free_at[t]))
            b = F.least(last, F.lit(free_at[t] + free[t]))
            parts.append(F.struct(F.lit(t).alias("shard"), (a - free_at[t] + loads[t]).cast("long").alias("slot"), F.greatest(b - a, F.lit(0)).cast("long").alias("cnt")))
    split = rows.select("k", F.explode(F.array(*[p.cast("struct<shard:int,slot:long,cnt:long>") for p in parts])).alias("x")).select("k", "x.*").filter("cnt > 0")
    # A group has few segments: at most those of its 16 rows.
    w = Window.partitionBy("k").orderBy("shard", "slot")
    ranked = split.withColumn("till", F.sum("cnt").over(w))
    listed = ranked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("till", "shard", (F.col("slot") - F.col("till") + F.col("cnt")).alias("shift")))).alias("segments"))
    gone = sum(over)
    taken = [min(loads[k], capacity[k]) + min(max(gone - free_at[k], 0), free[k]) for k in range(SHARDS)]
    return listed, taken


def shard_documents(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("h"))
    rows = materialize(rows, "sharding rows")
    total = rows.count()
    capacity = [total // SHARDS + (k < total % SHARDS) for k in range(SHARDS)]
    groups = materialize(rows.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("n")).filter("n > 1"), "sharding groups")
    state = propagate(materialize(_start(groups), "sharding start"), capacity, iterations)
    segments, taken = _segments(state, capacity)

    # Which documents have links: groups are repeated over the salts of the rows.
    buckets = 64 + total // 50_000
    salted = groups.select("k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    known = rows.withColumn("salt", F.col("b") % SALTS).join(salted, (F.col("h") == F.col("k")) & (F.col("salt") == F.col("g_salt")), "left").select("doc_id", "size", "text_crc32", F.coalesce("k", F.lit(0)).alias("k"), F.col("k").isNotNull().alias("linked"), "b")
    known = materialize(known, "sharding links")
    keys = ["linked", "k", "b"]
    part = known.groupBy(*keys).agg(F.count("*").alias("n"))
    part = part.withColumn("off", F.sum("n").over(Window.partitionBy("linked", "k").orderBy("b")) - F.col("n"))
    part = part.join(segments.withColumn("is", F.lit(True)).withColumnRenamed("k", "s_k"), (F.col("linked") == F.col("is")) & (F.col("k") == F.col("s_k")), "left")
    part = part.select(*[F.col(c).alias(f"x_{c}") for c in keys], "off", "segments")
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "size", "text_crc32")).cast("long") - 1)
    ranked = ranked.join(part, (F.col("linked") == F.col("x_linked")) & (F.col("k") == F.col("x_k")) & (F.col("b") == F.col("x_b"))).withColumn("r", F.col("r") + F.col("off"))
    # Documents without links fill what is left.
    rest = [c - n for c, n in zip(capacity, taken, strict=True)]
    fill = F.array(*[F.struct(F.lit(sum(rest[: k + 1])).cast("long").alias("till"), F.lit(k).alias("shard"), F.lit(taken[k] - sum(rest[:k])).cast("long").alias("shift")) for k in range(SHARDS)])
    of = F.get(F.filter(F.when(F.col("linked"), F.col("segments")).otherwise(fill), lambda x: F.col("r") < x["till"]), F.lit(0))
    return ranked.withColumn("x", of).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("x.shard").alias("shard"), (F.col("r") + F.col("x.shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
