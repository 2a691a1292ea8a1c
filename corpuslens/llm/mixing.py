"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in a seeded order, are cut into blocks of `block_rows`. The weights are taken exactly, as fractions a/L
(integers that sum to L). The j-th block of a source (from 0) is released at slot floor(j * L / a) and due before slot
ceil((j + 1) * L / a). In every slot the released block with the earliest deadline goes, so after t slots a source has had
less than one block more or less than t * a / L. That schedule repeats every L slots. It is made once, on the driver, from
the weights and counts alone: for one round of L slots, or for the whole phase (see below) where that is shorter. A block's
slot is its round times L plus the place of its turn in the round. The turns are a table of at most one row a block.

All rows are put out. When a source has no block left, its last one ends a phase: the other sources go on with their weights
scaled up, by a new schedule. There is one phase for each source at most, and what is gathered from the table is one
count for each source.

Rows are numbered without putting a source into one task: the seeded hash deals them into ranges, ranges are counted, and
numbers within a range are added to the counts before it.

Defined results: a null source is a source; rows of one id and text are ordered by a hash of all their columns, and rows that
are repeated exactly take neighbouring places; very long texts are only hashed; sources with weight
0 or none come after all others; an empty table gives an empty result; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, stored, table, text_key

#: A deadline beyond 64 bits (of a source with a tiny weight) is put out as this.
LAST_SLOT = 2**63 - 1
#: Rows of a range that is numbered by one window, on average.
RANGE_ROWS = 20_000
LEAST_RANGES = 64


def shares(weights: Mapping, slots: int) -> dict:
    """Integers that sum to `slots`, in proportion to the weights, 1 at least (largest remainders): rounded, so not for a mix."""
    total = sum(weights.values())
    exact = {s: w * slots / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    k = 0
    while (left := slots - sum(out.values())) != 0:
        s = order[k % len(order)]
        if left > 0 or out[s] > 1:
            out[s] += 1 if left > 0 else -1
        k += 1
    return out


def exact_shares(weights: Mapping) -> dict:
    """The least integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: a // common for s, a in out.items()}


def schedule(share: Mapping, left: Mapping | None = None) -> list:
    """The source of each slot of a round: of the released blocks, the one that is due first.

    left: blocks of each source; the schedule ends with the last block of one of them if that is before the round's end.
    """
    slots, order = sum(share.values()), sorted(share, key=str)
    waiting = [(0, i, 0) for i in range(len(order))]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // share[order[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a block missed its deadline")
        out.append(order[i])
        if left is not None and j + 1 == left[order[i]]:
            break
        if (j + 1) * slots // share[order[i]] < slots:
            heapq.heappush(waiting, ((j + 1) * slots // share[order[i]], i, j + 1))
    return out


def phases(counts: Mapping, weights: Mapping, block_rows: int) -> list[dict]:
    """For each phase and source: first and one-past-last block, slot of the phase's start, the exact weight (share of
    length), the slots of its turns from the phase's start, after how many slots they come again (0: never), and by how many
    rows the blocks before the phase fall short of full ones."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n}
    short = {s: -n % block_rows for s, n in counts.items()}
    done = dict.fromkeys(left, 0)
    out, start, missing = [], 0, 0
    while left:
        weighted = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        share = exact_shares(weighted)
        length = sum(share.values())
        round_ = schedule(share, left)
        places: dict = {s: [] for s in weighted}
        for t, s in enumerate(round_):
            places[s].append(t)
        again = length if len(round_) == length else 0
        if again:
            last = {s: (left[s] - 1) // share[s] * length + places[s][(left[s] - 1) % share[s]] for s in weighted}
            ends = min(weighted, key=lambda s: last[s])
            slots = last[ends] + 1
        else:
            ends, slots = round_[-1], len(round_)
        for s in weighted:
            n = slots // length * share[s] + sum(t < slots % length for t in places[s])
            out.append({"source": s, "is_null": s is None, "first": done[s], "last": done[s] + n, "start": start, "again": again, "places": places[s], "missing": missing, "share": share[s], "length": length})
            done[s] += n
            left[s] -= n
        start += slots
        missing += short[ends]  # the source's last block, which ends the phase, is the only one that isn't full
        left = {s: n for s, n in left.items() if n}
    return out


def turns(plan: list[dict]) -> pa.Table:
    """id (in plan), turn, slot, release, deadline: a row for each turn, slots from the phase's start."""
    ids, turn, slot, release, deadline = [], [], [], [], []
    for i, p in enumerate(plan):
        share, length, places = p["share"], p["length"], p["places"]
        ids += [i] * len(places)
        turn += range(len(places))
        slot += places
        release += [k * length // share for k in range(len(places))]
        deadline += [min(-(-(k + 1) * length // share), LAST_SLOT - p["start"]) for k in range(len(places))]
    columns = {"id": ids, "turn": turn, "slot": slot, "release": release, "deadline": deadline}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def temperature(counts: Mapping, alpha: float) -> dict:
    """Weights n ** alpha: between the sources' own shares (1) and equal ones (0)."""
    return {s: n**alpha for s, n in counts.items()}


def numbered(docs: DataFrame, source: str, seed: int, names: list[str]) -> tuple[DataFrame, dict]:
    """docs with, for each row, its number within its source from 0 in a seeded order (column names[0]); rows by source.

    names: free column names to use; all but the first are dropped again.
    """
    number, key, part, before, tie = names
    hashed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), text_key()))
    n = docs.count()
    ranges = max(LEAST_RANGES, -(-n // RANGE_ROWS))
    # the hash's upper 31 bits, scaled to the number of ranges: ordered as the hash is
    hashed = hashed.withColumn(part, F.floor((F.shiftright(key, 33) + F.lit(2**30)) * F.lit(ranges) / F.lit(2**31)).cast("int"))
    sizes = hashed.groupBy(F.col(source).alias("s"), F.col(part).alias("p")).agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("b", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "ranges")
    counts = {r.s: r.n for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    sizes = sizes.select(F.col("s").alias(f"{before}_s"), F.col("p").alias(f"{before}_p"), F.col("b").alias(before))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    within = Window.partitionBy(source, part).orderBy(key, "doc_id", tie)
    rows = hashed.withColumn(tie, F.xxhash64(*(docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()))).withColumn(number, F.row_number().over(within).cast("long") - 1)
    joined = rows.join(sizes, rows[source].eqNullSafe(sizes[f"{before}_s"]) & (rows[part] == sizes[f"{before}_p"]))
    return joined.withColumn(number, F.col(number) + F.col(before)).drop(key, part, before, tie, f"{before}_s", f"{before}_p"), counts


def mixed(docs: DataFrame, weights: Mapping | None = None, *, source: str = "source", block_rows: int = 100, seed: int = 7, alpha: float = 0.5) -> DataFrame:
    """docs with one more column, the last: a struct of block (of its source, from 0), release, deadline and slot of the
    block (within the whole mix), and position of the row in the mix (from 0).

    weights: source -> weight; None: the sources' counts to the power alpha.
    """
    names = fresh(docs, "number_", "key_", "part_", "before_", "tie_", "mix")
    rows, counts = numbered(docs, source, seed, names[:5])
    number, mix = names[0], names[5]
    plan = phases(counts, temperature(counts, alpha) if weights is None else weights, block_rows)
    spark = docs.sparkSession
    schema = "array<struct<id:bigint,source:string,is_null:boolean,first:bigint,last:bigint,start:bigint,again:bigint,n_turns:bigint,missing:bigint>>"
    # a row for each phase and source, from the counts: at most the number of sources squared
    sent = [{k: p[k] for k in ("is_null", "first", "last", "start", "again", "missing")} | {"id": i, "n_turns": max(1, len(p["places"])), "source": None if p["source"] is None else str(p["source"])} for i, p in enumerate(plan)]
    table_ = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(sent)), schema)))
    plan_col, turn_col = fresh(rows, "plan_", "turn_")
    table_ = table_.select(F.struct("*").alias(plan_col))
    table_ = F.broadcast(table_) if len(sent) <= BROADCAST_ROWS else table_
    turn_table = turns(plan)
    turn_rows = stored(spark.createDataFrame(turn_table), "turns").select(F.struct("*").alias(turn_col))
    turn_rows = F.broadcast(turn_rows) if len(turn_table) <= BROADCAST_ROWS else turn_rows
    p, turn, block = F.col(plan_col), F.col(turn_col), F.floor(F.col(number) / F.lit(block_rows))
    match = F.col(source).cast("string").eqNullSafe(p["source"]) & (block >= p["first"]) & (block < p["last"])
    j = block - p["first"]
    k = F.pmod(j, p["n_turns"])
    since = p["start"] + F.floor((j - k) / p["n_turns"]) * p["again"]
    slot = since + turn["slot"]
    row = F.struct(
        block.alias("block"),
        (since + turn["release"]).alias("release"),
        (since + turn["deadline"]).alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.pmod(F.col(number), F.lit(block_rows)) - p["missing"]).alias("position"),
    )
    return rows.join(table_, match).join(turn_rows, (p["id"] == turn["id"]) & (k == turn["turn"])).withColumn(mix, row).drop(plan_col, turn_col, number)


def in_mixed_order(docs: DataFrame, weights: Mapping | None = None, **options) -> DataFrame:
    """The rows of docs, with their columns as they were, dealt into ranges of the mix and sorted within them."""
    out = mixed(docs, weights, **options)
    mix = out.columns[-1]
    return out.withColumn(mix, F.col(mix)["position"]).repartitionByRange(mix).sortWithinPartitions(mix).select(*(out[c] for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", "mix.*")
