"""Sharding by balanced label propagation [DataFrame operations only; the driver handles a matrix of shard loads]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import identified, discard, materialize, offsets, splittable

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def flows(demand: list[list[float]], loads: list[float], capacity: float) -> list[list[float]]:
    """How much of each demand (from, to) may move so that no shard ends above capacity; a move out makes room for one in.

    Starts from all demands and cuts the inflow of overloaded shards until none is. Cuts only ever lower flows, so it ends.
    """
    n = len(loads)
    f = [row[:] for row in demand]
    for _ in range(200):
        over = 0.0
        for j in range(n):
            come = sum(f[i][j] for i in range(n))
            gone = sum(f[j])
            excess = loads[j] + come - gone - capacity
            if excess > 0.5 and come > 0:
                keep = max(0.0, 1 - excess / come)
                for i in range(n):
                    f[i][j] *= keep
                over = max(over, excess)
        if over <= 0.5:
            break
    return f


def propagate(linked: DataFrame, edges: DataFrame, n_shards: int, capacity: float, rounds: int, taken: list[int]) -> DataFrame:
    """linked (rid, hub, n) with the shard that label propagation finds, where taken places of each shard are given away.

    Each round, the documents of each hub of edges (rid, hub, w) are counted by shard; every document adds up its neighbours over all its hubs, each hub
    with weight w, prefers, of the shards with room, the one where most are, and moves there as far as the quotas of (from, to) allow. The
    documents of linked's hub, a document's first, are admitted together; one that a full shard blocks prefers another in the next round.
    capacity is a twentieth above the even share, so that neighbours can gather; place() then cuts to the exact sizes.
    """
    u = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 20)) / float(1 << 20)
    now = materialize(linked.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(n_shards)).cast("int")))
    # Documents whose only hub is the first need no sum over hubs, nor a shuffle by document.
    several = materialize(edges.join(linked.select("rid", F.col("hub").alias("first")), "rid").where("not (hub <=> first)").select("rid").distinct())
    some = several.limit(1).count() > 0
    for step in range(rounds):
        loads = [float(x) for x in taken]
        for r in now.groupBy("shard").agg(F.count("*").alias("c")).collect():
            loads[r["shard"]] += r.c
        # Every other round, full shards may be wished for as well: what moves out of them makes room.
        room = F.element_at(F.array(*[F.lit(step % 2 == 0 or x < capacity) for x in loads]), F.col("shard") + 1)
        counts = now.groupBy("hub", "shard").agg(F.count("*").alias("c"))
        order = F.struct(room.alias("room"), "c", F.xxhash64("hub", "shard").alias("h"), "shard")
        best = counts.groupBy("hub", splittable("hub")).agg(F.max(order).alias("best")).select("hub", F.col("best.shard").alias("to"))
        wish = now.join(best, "hub")
        if some:
            at = edges.join(now.select("rid", "shard"), "rid").groupBy("hub", "shard").agg(F.sum("w").alias("c"))
            rows = edges.join(several, "rid", "left_semi").join(at.groupBy("hub", splittable("hub")).agg(F.collect_list(F.struct("shard", "c")).alias("near")).select("hub", "near"), "hub")
            rows = rows.select("rid", F.explode("near").alias("x")).groupBy("rid", F.col("x.shard").alias("shard")).agg(F.sum("x.c").alias("c"))
            order = F.struct(room.alias("room"), "c", F.xxhash64("rid", "shard").alias("h"), "shard")
            own = rows.groupBy("rid").agg(F.max(order).alias("best")).select("rid", F.col("best.shard").alias("own_to"))
            # All documents of a first hub go the way of most of them.
            votes = wish.join(own, "rid", "left").groupBy("hub", F.coalesce("own_to", "to").alias("to")).agg(F.count("*").alias("c"))
            most = votes.groupBy("hub", splittable("hub")).agg(F.max(F.struct("c", "to")).alias("m")).select("hub", F.col("m.to").alias("to"))
            wish = now.join(most, "hub")
        wish = materialize(wish)
        demand = [[0.0] * n_shards for _ in range(n_shards)]
        for r in wish.groupBy("shard", "to").agg(F.count("*").alias("c")).collect():  # n_shards^2 rows at most
            if r.to != r["shard"]:
                demand[r["shard"]][r.to] = float(r.c)
        if not any(map(any, demand)):
            discard(wish)
            break
        allowed = flows(demand, loads, capacity)
        shares = [F.lit(allowed[i][j] / demand[i][j] if demand[i][j] else 0.0) for i in range(n_shards) for j in range(n_shards)]
        part = F.element_at(F.array(*shares), F.col("shard") * n_shards + F.col("to") + 1)
        moved = materialize(wish.select("rid", "hub", "n", F.when(u("hub", F.lit(step)) < part, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        discard(now, wish)
        now = moved
    discard(several)
    return now


def fit(hubs: list[tuple], free: list[int]) -> list[tuple]:
    """(hub, shard) for the hubs (hub, n) that fit whole into free places, largest first, each where it leaves least; free is lowered."""
    out = []
    for hub, n in sorted(hubs, key=lambda x: (-x[1], x[0])):
        if some := [s for s in range(len(free)) if free[s] >= n]:
            s = min(some, key=lambda s: (free[s], s))
            free[s] -= n
            out.append((hub, s))
    return out


def ends(hubs: DataFrame, group: list[str], buckets: list[str]) -> DataFrame:
    """hubs (hub, n) with end, the running sum of n within group in the order of buckets, then hub; summed in buckets, like numbered()."""
    before = offsets(hubs.groupBy(*group, *buckets).agg(F.sum("n").alias("_c")), group, buckets, "_c", "_before")
    inside = F.sum("n").over(Window.partitionBy(*group, *buckets).orderBy("hub").rowsBetween(Window.unboundedPreceding, 0))
    return hubs.withColumn("_inside", inside).join(before, [*group, *buckets]).withColumn("end", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def place(linked: DataFrame, edges: DataFrame, target: list[int], rounds: int, rows_per_bucket: int) -> DataFrame:
    """(hub, shard) of the hubs that get into one shard whole, for linked (rid, hub, n); no shard gets more than its target.

    Hubs of more than an eighth of a shard, few, are fitted by the driver first. Label propagation brings the others together; those
    that a shard's exact size or a quota keeps out are laid into the free places of all shards in turn, larger ones first, and the
    few that would lie across the end of a shard are fitted by the driver. What is left fits nowhere whole.
    """
    n_shards, free = len(target), target[:]
    large = max(1, target[-1] // 8)
    name = linked.schema["hub"]
    big = [(r.hub, r.n) for r in linked.where((F.col("n") > large) & (F.col("n") <= max(target))).select("hub", "n").distinct().collect()]  # at most 8 a shard, as each holds an eighth of one
    by_driver = fit(big, free)
    placed = propagate(linked.where(F.col("n") <= large), edges, n_shards, max(1.0, 1.05 * target[-1]), rounds, [t - f for t, f in zip(target, free, strict=True)])
    b1 = F.pmod(F.xxhash64("hub"), F.lit(max(1, sum(target) // rows_per_bucket)))
    hubs = materialize(placed.groupBy("hub", "n").agg(F.min("shard").alias("shard"), F.max("shard").alias("hi")).withColumn("b1", b1))
    discard(placed)
    size_of = F.element_at(F.array(*[F.lit(x) for x in free]), F.col("shard") + 1)
    together = ends(hubs.where("shard = hi"), ["shard"], ["b1"])
    settled = materialize(together.where(F.col("end") <= size_of).select("hub", "n", "shard"))

    def lower(done: DataFrame) -> None:
        for r in done.where("shard is not null").groupBy("shard").agg(F.sum("n").alias("c")).collect():
            free[r["shard"]] -= r.c

    lower(settled)
    left = hubs.join(settled.select("hub"), "hub", "left_anti").select("hub", "n", "b1", F.lit(0).alias("g"), (-F.floor(F.log2("n"))).alias("b0"))
    left = ends(left, ["g"], ["b0", "b1"])
    at, into = 0, F.lit(None).cast("int")
    for s in range(n_shards):
        into = F.when((F.col("end") - F.col("n") >= at) & (F.col("end") <= at + free[s]), F.lit(s)).otherwise(into)
        at += free[s]
    packed = materialize(left.select("hub", "n", into.alias("shard")))
    lower(packed)
    by_driver += fit([(r.hub, r.n) for r in packed.where("shard is null").select("hub", "n").collect()], free)  # fewer than n_shards
    out = settled.select("hub", "shard").union(packed.where("shard is not null").select("hub", "shard"))
    return out.union(linked.sparkSession.createDataFrame(by_driver, T.StructType([name, T.StructField("shard", T.IntegerType())])))


def numbered(rows: DataFrame, group: list[str], buckets: list[str], by: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 within group, in the order of buckets, then by.

    Rows are numbered within (group, buckets), and the counts of the buckets before are added, so a group need not meet in one task.
    """
    before = offsets(rows.groupBy(*group, *buckets).agg(F.count("*").alias("_c")), group, buckets, "_c", "_before")
    inside = F.row_number().over(Window.partitionBy(*group, *buckets).orderBy(*by)) - 1
    return rows.withColumn("_inside", inside).join(before, [*group, *buckets]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


def shard(vertices: DataFrame, links: DataFrame, *, n_shards: int = 16, rounds: int = 5, rows_per_bucket: int = 250) -> DataFrame:
    """(rid, shard, slot) for vertices (rid) and links (rid, hub): documents of a hub are linked with each other.

    Counts of the shards are at most one apart; slots are gapless from 0 in each. Linked documents are placed by label
    propagation over all their links under capacity quotas; the documents of a document's first hub (the smallest), if it fits into
    a shard, go whole; the documents of hubs that fit nowhere, hub by hub, and those without links fill the places left. Hubs of one document
    link nothing; in a hub of n documents, each pair counts 1/(n - 1), so that long hubs don't drown short ones.
    """
    total = vertices.count()
    links = links.where("hub is not null").select("rid", "hub").distinct()
    sizes = links.groupBy("hub", splittable("hub")).agg(F.count("*").alias("m")).where("m > 1").select("hub", (1 / (F.col("m") - 1)).alias("w"))
    edges = materialize(links.join(sizes, "hub").select("rid", "hub", "w"))
    one = edges.groupBy("rid").agg(F.min("hub").alias("hub"))
    groups = one.groupBy("hub", splittable("hub")).agg(F.count("*").alias("n")).select("hub", "n")
    linked = materialize(one.join(groups, "hub").select("rid", "hub", "n"))
    base, more = divmod(total, n_shards)
    target = [base + (s < more) for s in range(n_shards)]
    whole = materialize(place(linked, edges, target, rounds, rows_per_bucket))
    placed = linked.where(F.col("n") <= max(target)).join(whole, "hub")
    n_buckets = max(1, total // (n_shards * rows_per_bucket))
    spread = F.when(F.col("n") > rows_per_bucket, F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / float(rows_per_bucket)))).otherwise(F.lit(0))
    ranked = numbered(placed.withColumns({"b1": F.pmod(F.xxhash64("hub"), F.lit(n_buckets)), "b2": spread}), ["shard"], ["b1", "b2"], ["hub", "rid"], "slot")
    kept = materialize(ranked.select("rid", "shard", "slot"))
    have = {r["shard"]: r.c for r in kept.groupBy("shard").agg(F.count("*").alias("c")).collect()}
    pool = vertices.select("rid").join(kept.select("rid"), "rid", "left_anti")
    pool = pool.join(linked.select("rid", "hub"), "rid", "left")
    # Documents of one hub lie in neighbouring buckets, by the hub's hash; those without links are dealt by their own.
    n_hubs, spread = 1024, F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(max(1, total // rows_per_bucket)))
    pool = pool.select("rid", F.lit(0).alias("g"), F.when(F.col("hub").isNull(), F.lit(n_hubs)).otherwise(F.pmod(F.xxhash64("hub"), F.lit(n_hubs))).alias("h"), spread.alias("b"))
    pool = numbered(pool, ["g"], ["h", "b"], ["rid"], "p")
    at, into, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(n_shards):
        free = target[s] - have.get(s, 0)
        inside = (F.col("p") >= at) & (F.col("p") < at + free)
        into = F.when(inside, F.lit(s)).otherwise(into)
        slot = F.when(inside, F.col("p") - at + have.get(s, 0)).otherwise(slot)
        at += free
    return kept.unionByName(pool.select("rid", into.alias("shard"), slot.cast("long").alias("slot")))


def shard_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """docs (key and the columns of keep) with size, text_crc32, law, shard, slot and grown_shard; equal texts are linked.

    law is `rows`. Null texts have size 1 and the checksum of an empty text and link with nothing; empty texts link like any other;
    repeated rows are documents of their own; an empty table gives an empty result; kept columns named like a result are replaced.
    """
    kept = [key, *[c for c in keep or [] if c != key and c.lower() not in MADE]]
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.when(F.col(f"`{text}`").isNotNull(), F.md5(body)).alias("hub"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    rows = materialize(rows)  # from here on the numbers of the rows are data
    placed = shard(rows.select("rid"), rows.select("rid", "hub"), n_shards=n_shards)
    return rows.join(placed, "rid").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_in_order(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_shards: int = 16, rows_per_bucket: int = 250) -> DataFrame:
    """All of docs' columns with size, text_crc32, law, shard, slot and grown_shard, as shard_documents gives them, but for the slots: in each shard
    these follow the order in which docs was written, by file and row, and the result is laid out by shard and slot.

    So what was sorted by training position before comes in that order from every shard, and a document that was taken twice keeps a slot, with its text,
    for each. Only places and 16 bytes of the texts are sharded; the documents are joined to their slots by place, so no key is hot. Columns named like a result are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in MADE]
    rows = identified(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]))
    body = F.coalesce(F.col(f"_c{names.index(text)}"), F.lit("")).cast("binary")
    hub = F.when(F.col(f"_c{names.index(text)}").isNotNull(), F.md5(body))
    # Files are named by the number of their task, in the order of the rows; a bucket is a stretch of a file's rows.
    task = F.coalesce(F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    bucket = task * F.lit(1 << 20) + F.floor(F.col("_row") / (n_shards * rows_per_bucket))
    slim = rows.select(F.monotonically_increasing_id().alias("rid"), "_file", "_row", bucket.alias("b"), hub.alias("hub"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    slim = materialize(slim)
    placed = materialize(shard(slim.select("rid"), slim.select("rid", "hub"), n_shards=n_shards, rows_per_bucket=rows_per_bucket).select("rid", "shard"))
    slots = numbered(slim.join(placed, "rid").drop("rid", "hub"), ["shard"], ["b"], ["_file", "_row"], "slot")
    slots = materialize(slots.select("_file", "_row", "size", "text_crc32", "shard", "slot"))
    discard(slim, placed)
    made = [F.col("size"), F.col("text_crc32"), F.lit("rows").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard")]
    out = rows.join(slots.hint("shuffle_hash"), ["_file", "_row"]).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *made)
    return out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
