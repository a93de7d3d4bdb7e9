"""Keeping hot keys from becoming one task.

A single visitor, session, address or tracking id may hold a third of all rows.
Plain aggregates cope, as Spark combines rows before the shuffle. Two shapes do
not: windows over a key, and joins of a fact table to a unique-key table. Both
are handled here, the first in :func:`along`, the second in :func:`lookup`.

Both start with one counting job over the key columns (combined before the
shuffle, so cheap even when skewed). Without hot keys the plan that follows is
the plain one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from visitlens.session import new_folder

HOT_ROWS = 2_000_000
BROADCAST_KEYS = 100_000
#: Slices a hot key is cut into at most, and cuts looked through at once.
MOST_SLICES, STEP = 1024, 32


@dataclass
class Hot:
    """Hot keys with their row counts ``_n``, how many keys there are, and slices to cut the largest into."""
    keys: DataFrame
    count: int
    slices: int


def heavy_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> Hot | None:
    """Keys with at least ``hot_rows`` rows, or None when there are none.

    There are at most ``rows / hot_rows`` of them: 100,000 for 2e11 events.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found, most = counted.agg(F.count_if(F.col("_n") >= hot_rows), F.max("_n")).first()
    if not found:
        return None
    return Hot(counted.filter(F.col("_n") >= hot_rows), found, min(MOST_SLICES, most // hot_rows + 2))


def _mark_hot(df: DataFrame, keys: list[str], hot: Hot) -> DataFrame:
    """Add ``_n``: the row count of a hot key, null for the rest.

    The keys are broadcast while their counted number is small; beyond that the
    join is left to the planner.
    """
    renamed = hot.keys.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_n")
    if hot.count <= BROADCAST_KEYS:
        renamed = F.broadcast(renamed)
    match = None
    for k in keys:
        same = df[k].eqNullSafe(renamed[f"_hot_{k}"])
        match = same if match is None else match & same
    return df.join(renamed, match, "left").drop(*[f"_hot_{k}" for k in keys])


def _places(cuts: Column, coarse: Column, value: Column) -> Column:
    """How many of some sorted cuts are at most a value; ``coarse`` holds every ``STEP``-th cut."""
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= value)) - 1, F.lit(0)) * STEP
    return block + F.size(F.filter(F.slice(cuts, block + 1, STEP), lambda c: c <= value))


def _sliced(df: DataFrame, keys: list[str], order: list[str], hot: Hot) -> DataFrame:
    """Add ``_n`` (null but for hot keys) and ``_slice``, which rises along a key's rows.

    Cuts are quantiles of a hot key's times, so slices are alike in rows, not in hours. A time
    that takes up more than a slice is cut further by quantiles of ``order[1]``. The cuts
    are written, as a quantile sketch may come out otherwise when it is computed again.
    """
    spark = df.sparkSession

    def kept(rows: DataFrame, label: str) -> DataFrame:
        path = new_folder(spark, label)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    def matching(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        out = None
        for k in names:
            same = left[k].eqNullSafe(right[f"_cut_{k}"])
            out = same if out is None else out & same
        return out

    def every_step(name: str) -> Column:
        return F.filter(F.transform(name, lambda c, i: F.when(i % STEP == 0, c)), lambda c: c.isNotNull())

    fractions = [i / hot.slices for i in range(1, hot.slices)]
    marked = _mark_hot(df, keys, hot).withColumn("_at", F.unix_micros(order[0]))
    own = marked.filter(F.col("_n").isNotNull()).select(*keys, "_at", F.col(order[1]).cast("long").alias("_tie"))
    quantiles = own.groupBy(*keys).agg(F.percentile_approx("_at", fractions, 20 * hot.slices).alias("_q"))
    quantiles = quantiles.select(*[F.col(k).alias(f"_cut_{k}") for k in keys],
                                 F.array_sort(F.array_distinct("_q")).alias("_cuts"), F.array_distinct(F.filter(
                                     "_q", lambda c, i: F.get("_q", i + 1).eqNullSafe(c))).alias("_full"))
    cuts = kept(quantiles.withColumn("_coarse", every_step("_cuts")), "slice-cuts")
    full = cuts.select(*[c for c in cuts.columns if c.startswith("_cut_")], F.explode("_full").alias("_cut__at"))
    ties = own.join(F.broadcast(full) if hot.count * hot.slices <= BROADCAST_KEYS else full,
                    matching(own, full, [*keys, "_at"]))
    ties = ties.groupBy(*[c for c in full.columns]).agg(
        F.array_sort(F.array_distinct(F.percentile_approx("_tie", fractions, 20 * hot.slices))).alias("_ties"))
    ties = kept(ties.withColumn("_coarse_ties", every_step("_ties")), "slice-ties")
    if hot.count * hot.slices <= BROADCAST_KEYS:
        cuts, ties = F.broadcast(cuts), F.broadcast(ties)
    out = marked.join(cuts, matching(marked, cuts, keys), "left").drop(*[f"_cut_{k}" for k in keys])
    out = out.join(ties, matching(out, ties, [*keys, "_at"]), "left").drop(*[f"_cut_{k}" for k in [*keys, "_at"]])
    part = _places(F.col("_cuts"), F.col("_coarse"), F.col("_at"))
    tie = _places(F.col("_ties"), F.col("_coarse_ties"), F.col(order[1]).cast("long"))
    # Rows behind a time that is cut further come after all of its parts.
    within = F.when(F.col("_ties").isNotNull(), tie).when(
        F.array_contains("_full", F.get("_cuts", F.col("_part") - 1)), MOST_SLICES).otherwise(0)
    out = out.withColumn("_part", part).withColumn("_slice", F.when(
        F.col("_n").isNotNull(), F.col("_part") * (MOST_SLICES + 1) + within).otherwise(0).cast("long"))
    return out.drop("_at", "_cuts", "_full", "_coarse", "_ties", "_coarse_ties", "_part")


@dataclass
class Previous:
    """Value of the row before this one."""
    value: Column


@dataclass
class Following:
    """Value of the row after this one."""
    value: Column


@dataclass
class RunningSum:
    """Sum up to and including this row."""
    value: Column


@dataclass
class RunningMax:
    """Greatest value up to this row, or up to the row before it."""
    value: Column
    before: bool = False


@dataclass
class Trailing:
    """Array of the values of the last ``n`` rows before this one; no nulls."""
    value: Column
    n: int


def along(df: DataFrame, keys: list[str], order: list[str], steps: dict[str, object],
          hot: Hot | None = None) -> DataFrame:
    """Add columns computed along each key's rows in order.

    ``order[0]`` is the timestamp, ``order[1]`` an integer that breaks ties. ``hot`` comes
    from :func:`heavy_keys`. With hot keys, their rows are cut into slices of about as
    many rows, so the window of one key runs in many tasks. What must cross a slice border
    (last value, sum so far, ...) is taken from one summary row per slice.
    """
    sliced = hot is not None
    if sliced:
        df = _sliced(df, keys, order, hot)
    parts = keys + (["_slice"] if sliced else [])
    rows = W.partitionBy(*parts).orderBy(*order)
    so_far = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    until = rows.rowsBetween(W.unboundedPreceding, -1)

    # Inputs become columns first, so main plan and summaries agree on them.
    for name, step in steps.items():
        df = df.withColumn(f"_in_{name}", step.value)
    local: dict[str, Column] = {}
    for name, step in steps.items():
        value = F.col(f"_in_{name}")
        if isinstance(step, Previous):
            local[name] = F.lag(value).over(rows)
        elif isinstance(step, Following):
            local[name] = F.lead(value).over(rows)
        elif isinstance(step, RunningSum):
            local[name] = F.coalesce(F.sum(value).over(so_far), F.lit(0))
        elif isinstance(step, RunningMax):
            local[name] = F.max(value).over(until if step.before else so_far)
        elif isinstance(step, Trailing):
            local[name] = F.collect_list(value).over(rows.rowsBetween(-step.n, -1))
        else:
            raise TypeError(f"unknown step {step!r}")
    inputs = [f"_in_{n}" for n in steps]
    if not sliced:
        return df.withColumns(local).drop(*inputs)

    carried = _carried(df.filter(F.col("_n").isNotNull()), keys, order, steps)
    out = df.withColumns({
        **{f"_own_{n}": c for n, c in local.items()},
        "_first": F.row_number().over(rows) == 1,
        "_last": F.lead(F.lit(1)).over(rows).isNull(),
    })
    carried = carried.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_slice").alias("_c_slice"),
        *[f"_carry_{n}" for n in steps])
    match = out["_slice"] == carried["_c_slice"]
    for k in keys:
        match = match & out[k].eqNullSafe(carried[f"_c_{k}"])
    out = out.join(carried, match, "left")
    final: dict[str, Column] = {}
    for name, step in steps.items():
        own, carry = F.col(f"_own_{name}"), F.col(f"_carry_{name}")
        if isinstance(step, Previous):
            final[name] = F.when(F.col("_first"), carry).otherwise(own)
        elif isinstance(step, Following):
            final[name] = F.when(F.col("_last"), carry).otherwise(own)
        elif isinstance(step, RunningSum):
            final[name] = own + F.coalesce(carry, F.lit(0))
        elif isinstance(step, RunningMax):
            final[name] = F.greatest(own, carry)
        else:
            both = F.concat(F.coalesce(carry, F.slice(own, 1, 0)), own)
            final[name] = F.slice(both, F.greatest(F.size(both) - step.n, F.lit(0)) + 1, step.n)
    helpers = (inputs + [f"_own_{n}" for n in steps] + [f"_carry_{n}" for n in steps]
               + [f"_c_{k}" for k in keys] + ["_c_slice", "_first", "_last", "_n", "_slice"])
    return out.withColumns(final).drop(*helpers)


def _carried(hot_rows: DataFrame, keys: list[str], order: list[str],
             steps: dict[str, object]) -> DataFrame:
    """Per slice of a hot key, what the slices before (or after) it hand over."""
    place = F.struct(*order)
    parts = keys + ["_slice"]
    aggs = []
    for name, step in steps.items():
        value = F.col(f"_in_{name}")
        if isinstance(step, Previous):
            aggs.append(F.max_by(F.struct(value.alias("v")), place).alias(f"_sum_{name}"))
        elif isinstance(step, Following):
            aggs.append(F.min_by(F.struct(value.alias("v")), place).alias(f"_sum_{name}"))
        elif isinstance(step, RunningSum):
            aggs.append(F.sum(value).alias(f"_sum_{name}"))
        elif isinstance(step, RunningMax):
            aggs.append(F.max(value).alias(f"_sum_{name}"))
    summary = hot_rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    for name, step in steps.items():
        if isinstance(step, Trailing):
            newest = W.partitionBy(*parts).orderBy(*[F.desc(c) for c in order])
            tail = (hot_rows.withColumn("_rank", F.row_number().over(newest))
                    .filter(F.col("_rank") <= step.n)
                    .groupBy(*parts)
                    .agg(F.sort_array(F.collect_list(F.struct(
                        place.alias("p"), F.col(f"_in_{name}").alias("v")))).alias("_t"))
                    .withColumn(f"_sum_{name}", F.transform("_t", lambda e: e["v"]))
                    .drop("_t"))
            same = summary["_slice"] == tail["_slice"]
            for k in keys:
                same = same & summary[k].eqNullSafe(tail[k])
            summary = summary.join(tail, same, "left").select(
                summary["*"], tail[f"_sum_{name}"])
    slices = W.partitionBy(*keys).orderBy("_slice")
    earlier = slices.rowsBetween(W.unboundedPreceding, -1)
    carries = []
    for name, step in steps.items():
        total = F.col(f"_sum_{name}")
        if isinstance(step, Previous):
            c = F.lag(total).over(slices)["v"]
        elif isinstance(step, Following):
            c = F.lead(total).over(slices)["v"]
        elif isinstance(step, RunningSum):
            c = F.sum(total).over(earlier)
        elif isinstance(step, RunningMax):
            c = F.max(total).over(earlier)
        else:
            # Every slice has a row, so the last n rows lie in the last n slices.
            c = F.flatten(F.collect_list(total).over(slices.rowsBetween(-step.n, -1)))
        carries.append(c.alias(f"_carry_{name}"))
    return summary.select(*parts, *carries)


def lookup(facts: DataFrame, table: DataFrame, key: str, spread_by: str,
           how: str = "left", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Join facts to a table that is unique on ``key``.

    Facts of a hot key are salted by ``spread_by`` over as many parts as they
    fill, and only the table rows of hot keys are repeated. Facts without a key
    match nothing and are spread without a bound, else they would all meet in one task. Finding hot keys
    is a job; a caller that knows there are none, as the table is small, gives no ``hot_rows``.
    """
    hot = heavy_keys(facts.filter(F.col(key).isNotNull()), [key], hot_rows) if hot_rows else None
    if hot is None:
        parts = F.lit(1)
    else:
        facts = _mark_hot(facts, [key], hot)
        table = _mark_hot(table, [key], hot)
        parts = F.coalesce(F.ceil(F.col("_n") / F.lit(hot_rows)), F.lit(1)).cast("long")
    salt = F.when(F.col(key).isNull(), F.xxhash64(spread_by))
    if hot is None:
        salted = table.withColumn("_salt", F.lit(0).cast("long"))
        salt = salt.otherwise(F.lit(0))
    else:
        salted = table.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n")
        salt = salt.otherwise(F.pmod(F.xxhash64(spread_by), parts))
    facts = facts.withColumn("_salt", salt.cast("long")).drop("_n")
    return facts.join(salted, [key, "_salt"], how).drop("_salt")
