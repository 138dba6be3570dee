"""Shards of near equal bytes by balanced label propagation over linked documents. DataFrame operations only.

Documents are linked through a shared key (here: equal texts), so an edge never needs to be listed: a document's
neighbours in a shard are the rows of its key there. The rows of a key are dealt by hash into at most PARTS atoms, whatever their
number, and the atoms of all keys start spread over all shards. In a round every atom asks for the shard that
holds most of its key. Two shards admit as many bytes from each other as both ask for, and more where a shard has room,
the largest gains first (then by hash); rounds end when nothing moves in two of them.
After the last round the documents without links fill what is left, large ones first, in even shares.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import buckets_for, hash_bucket, running_total, table, text_key
from terrane.session import Stored

SHARDS = 8
PARTS = 256           # atoms of a key: the rows of a small one, this share of a large one
ROUNDS = 12
GAINS, DRAWS = 8, 64   # admission levels: gain classes, then hash
LEVELS = (32, 512, 8192)  # unlinked documents above these parts of a shard are placed first


def _choice(names: list[int], values: list, by: Column) -> Column:
    """A literal table of at most a shard count of entries as one expression."""
    return reduce(lambda c, kv: F.when(by == kv[0], F.lit(kv[1])).otherwise(c), zip(names, values), F.lit(None))


def _loads(df: DataFrame, shards: int, size: str) -> list[int]:
    got = {r.shard: r.load for r in df.where("shard is not null").groupBy("shard").agg(F.sum(size).alias("load")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def cut_edges(state: DataFrame) -> float:
    """Pairs of linked rows in different shards, from (link, shard, n)."""
    by_shard = state.groupBy("link", "shard").agg(F.sum("n").alias("n"))
    by_link = by_shard.groupBy("link").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("same"))
    return float(by_link.agg(F.sum((F.col("n") ** 2 - F.col("same")) / 2)).first()[0] or 0.0)


def spread(atoms: DataFrame, shards: int) -> DataFrame:
    """Where the atoms start: over all shards by hash."""
    return atoms.withColumn("shard", hash_bucket(shards, "link", "atom").cast("int"))


def admitted(asked: list[tuple[int, int, int, int]], room: list[float]) -> dict[tuple[int, int], int]:
    """The last level that may move from one shard to another, from (from, to, level, bytes).

    No shard gains more bytes than it has room for: what two shards ask of each other cancels out.
    """
    levels: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for here, to, level, size in sorted(asked):
        levels.setdefault((here, to), []).append((level, size))
    total = {p: sum(n for _, n in v) for p, v in levels.items()}
    surplus = {(a, b): total[a, b] - total.get((b, a), 0) for a, b in total}
    spare = [max(r, 0.0) for r in room]
    taken = {}
    for (a, b), more in sorted(surplus.items(), key=lambda x: -x[1]):
        extra = min(max(more, 0), spare[b])
        spare[b] -= extra
        sums = accumulate(n for _, n in levels[a, b])
        taken[a, b] = sum(x <= min(total[a, b], total.get((b, a), 0)) + extra for x in sums)
    while True:
        moved = {p: sum(n for _, n in levels[p][:k]) for p, k in taken.items()}
        net = [sum(x if b == s else -x if a == s else 0 for (a, b), x in moved.items()) for s in range(len(room))]
        over = [s for s in range(len(room)) if net[s] > max(room[s], 0.0)]
        if not over:
            return {p: levels[p][k - 1][0] for p, k in taken.items() if k}
        # levels are whole, so the two directions of a pair may differ: give back the smallest gain
        worst = max((p for p, k in taken.items() if k and p[1] in over), key=lambda p: levels[p][taken[p] - 1])
        taken[worst] -= 1


def propagate(atoms: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> Stored:
    """``atoms``: link, atom, n, bytes. Adds ``shard``; each round is one join of atoms with their key's shards."""
    state = Stored(spread(atoms, shards))
    idle = 0
    for number in range(rounds):
        room = [capacity - x for x in _loads(state.table, shards, "bytes")]
        held = state.table.groupBy("link", "shard").agg(F.sum("n").alias("held"))
        # one map for each key, of at most a shard count of entries
        held = held.groupBy("link").agg(F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("held"))
        a = state.table.join(held, "link")
        stay = F.col("held")[F.col("shard")] - F.col("n")
        # every second round only shards with room are asked, which ends a standstill before full ones
        roomy = [s for s in range(shards) if number % 2 == 0 or room[s] > 0] or [-1]
        offers = F.transform(F.filter(F.map_keys("held"), lambda s: (s != F.col("shard")) & s.isin(roomy)), lambda s: F.struct(
            (F.col("held")[s] - stay).alias("gain"), F.xxhash64("link", s).alias("tie"), s.alias("to")))
        best = F.array_max(offers)
        a = a.select("link", "atom", "n", "bytes", "shard", stay.alias("stay"), best.alias("best"), F.col("held")[F.col("shard")].alias("here"))
        # equal pulls go one way only: to the shard with the larger hash
        there = F.col("best.gain") + F.col("stay")
        better = (there > F.col("here")) | ((there == F.col("here")) & (F.col("best.tie") > F.xxhash64("link", "shard")))
        a = a.withColumn("to", F.when((F.col("best.gain") > 0) & better, F.col("best.to")))
        level = (F.lit(GAINS) - F.least(F.lit(GAINS), F.col("best.gain").cast("int"))) * DRAWS + hash_bucket(DRAWS, "link", "atom").cast("int")
        a = Stored(a.select("link", "atom", "n", "bytes", "shard", "to", level.alias("level")))
        # at most shards x shards x levels rows
        asked = a.table.where("to is not null").groupBy("shard", "to", "level").agg(F.sum("bytes").alias("bytes")).collect()
        last = admitted([(r.shard, r.to, r.level, int(r.bytes)) for r in asked], room)
        pair = F.col("shard") * shards + F.col("to")
        go = F.coalesce(F.col("level") <= _choice([x * shards + z for x, z in last], list(last.values()), pair), F.lit(False))
        new = Stored(a.table.select("link", "atom", "n", "bytes", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard"), go.alias("moved")),
                     {"moved": F.sum(F.col("moved").cast("long"))})
        state.drop()
        a.drop()
        state = new
        idle = 0 if new.measures["moved"] else idle + 1
        if idle == 2:
            break
    return state


def even_shares(loads: list[int], amount: int) -> list[float]:
    """How much of ``amount`` each shard takes so that the fullest levels are as low as they can be."""
    ordered = sorted(loads)
    for k in range(len(ordered), 0, -1):
        top = (sum(ordered[:k]) + amount) / k
        if top >= ordered[k - 1]:
            break
    return [max(0.0, top - x) for x in loads]


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    Size is UTF-8 bytes plus 1 (a null text: 1). Equal texts are linked, null texts are not. Rows of a
    key that is larger than a shard's room are split over shards. Slots of a shard run from 0 without
    gaps. Rows equal in id and text share an atom and are placed one by one; an empty table gives no rows. Only doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_key("text").alias("link"))
    rows = Stored(rows, {"n": F.count(F.lit(1)), "bytes": F.sum("size")})
    n, total = rows.measures["n"] or 0, rows.measures["bytes"] or 0
    capacity = total / shards
    buckets = buckets_for(n)
    key = ["doc_id", "text_crc32", "size"]
    dealt = hash_bucket(buckets, *key)

    linked = rows.table.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marked = Stored(rows.table.join(linked, "link", "left").withColumn("atom", F.when(F.col("copies") > 1, hash_bucket(PARTS, *key))).drop("copies"))
    atoms = marked.table.where("atom is not null").groupBy("link", "atom").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    state = propagate(atoms, shards, capacity)
    # a shard that started above its capacity gives the atoms beyond it back
    placed = running_total(state.table.drop("moved", "n"), hash_bucket(buckets, "link", "atom"), ["link", "atom"], F.col("bytes"), "before", by=["shard"])
    placed = placed.select("link", "atom", F.when(F.col("before") + F.col("bytes") <= F.lit(float(capacity)), F.col("shard")).alias("shard"))
    all_rows = Stored(marked.table.join(placed, ["link", "atom"], "left").drop("link", "atom")).table

    done = all_rows.where("shard is not null")
    free = all_rows.where("shard is null").drop("shard")
    loads = _loads(all_rows, shards, "size")
    cuts = [float("inf"), *[capacity / x for x in LEVELS], 0.0]
    for high, low in zip(cuts, cuts[1:]):
        level = free.where((F.col("size") > F.lit(low)) & (F.col("size") <= F.lit(high)))
        amount = int(level.agg(F.sum("size")).first()[0] or 0)
        if not amount:
            continue
        ends = list(accumulate(even_shares(loads, amount)))
        middle = F.col("_before") + F.col("size") / 2
        share = sum([(middle >= F.lit(e)).cast("int") for e in ends[:-1]], F.lit(0))
        level = running_total(level, dealt, key, F.col("size"), "_before").withColumn("shard", share.cast("int")).drop("_before")
        level = Stored(level).table
        loads = [a + b for a, b in zip(loads, _loads(level, shards, "size"))]
        done = done.unionByName(level)
    out = running_total(done, dealt, key, F.lit(1), "slot", by=["shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = balanced_shards(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
