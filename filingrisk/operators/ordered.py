"""Ordered computations that stay distributed when one group is huge.

A plain window over a group puts the whole group into one task. The helpers
here split a group into order-preserving cells, add up the small per-cell
totals, and keep every row-level window inside one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingrisk.functions.numeric import order_cell

#: Cells of the rows of one score that is ranked row by row, and quantiles of the ids between which they lie.
TIE_CELLS, TIE_QUANTILES = 1024, 32
BLOCK_ROWS = 4096
#: Parts into which rows equal in their order columns are dealt at least.
SLOTS = 64


def running_totals(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    descending: bool = False,
) -> DataFrame:
    """Exclusive running sums per group over distinct order values.

    `df` holds one row per (part, order), as a grouping leaves it. Adds
    `<value>_before` (sum over earlier rows) and `<value>_total` (group sum).
    """
    part = list(part)
    cell = order_cell(F.col(order))
    celled = df.where(F.col(order).isNotNull()).withColumn("_cell", -cell if descending else cell)
    keys = [*part, "_cell"]
    sums = celled.groupBy(*keys).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    # One row per touched cell: bounded by the grid, not by the data.
    group = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(group).alias(f"{v}_total") for v in values],
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    local = (
        Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        celled.join(offsets, keys)
        .withColumns(
            {
                f"{v}_before": F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(local), F.lit(0))
                for v in values
            }
        )
        .drop("_cell", *[f"_o_{v}" for v in values])
    )


def order_statistics(
    df: DataFrame, part: Sequence[str], value: str, ranks: Callable[[Column], Column]
) -> DataFrame:
    """The values at chosen ascending ranks of each group, without sorting the group.

    `ranks` maps the group size to an array of structs (tag, r), r counted from
    1. A grid histogram finds the cell that holds each rank; only the rows of
    those cells are looked at again. Returns (part, tag, value).
    """
    part = list(part)
    celled = df.where(F.col(value).isNotNull()).select(*part, value)
    celled = celled.withColumn("_cell", order_cell(F.col(value)))
    keys = [*part, "_cell"]
    group = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        celled.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(group))
    )
    wanted = cells.withColumn("_q", F.explode(ranks(F.col("_total")))).where(
        (F.col("_q.r") > F.col("_before")) & (F.col("_q.r") <= F.col("_before") + F.col("_n"))
    )
    targets = wanted.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("_q.tag").alias("tag"), (F.col("_q.r") - F.col("_before")).alias("r"))).alias("_want")
    )
    inside = Window.partitionBy(*keys).orderBy(value)
    found = (
        celled.join(targets.select(*keys), keys, "left_semi")
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(targets, keys)
        .withColumn("_hit", F.explode("_want"))
        .where((F.col("_hit.r") <= F.col("_upto")) & (F.col("_hit.r") > F.col("_upto") - F.col("_n")))
    )
    return found.select(*part, F.col("_hit.tag").alias("tag"), value)


def exact_medians(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Exact median per group (mean of the two middle values); NULLs are skipped."""

    def middle(n: Column) -> Column:
        return F.array(
            F.struct(F.lit("low").alias("tag"), F.floor((n + 1) / 2).cast("long").alias("r")),
            F.struct(F.lit("high").alias("tag"), (F.floor(n / 2) + 1).cast("long").alias("r")),
        )

    stats = order_statistics(df, part, value, middle)
    return stats.groupBy(*part).agg(F.avg(value).alias("median"))


def tie_key(df: DataFrame, row_id: str) -> Column:
    """A long to order equal scores by: numeric ids as they are, others hashed."""
    if isinstance(df.schema[row_id].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return F.col(row_id).cast("long")
    return F.xxhash64(row_id)


def tie_cells(tied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of equal scores with `_cell`, which rises with `_tie`.

    Cells lie between quantiles of the ids and cut these ranges evenly, so a
    cell has a small share of the rows however the ids lie. `_tmin` and `_tmax`
    are the least and the greatest `_tie` of the group.
    """
    shares = [i / TIE_QUANTILES for i in range(1, TIE_QUANTILES)]
    quantiles = tied.groupBy(*keys).agg(F.percentile_approx("_tie", shares, 4 * TIE_QUANTILES).alias("_q"))
    at = F.size(F.filter("_q", lambda q: q <= F.col("_tie")))
    placed = tied.join(quantiles, list(keys)).withColumn("_at", at)
    bounds = F.concat(F.array(F.col("_tmin").cast("long")), "_q", F.array(F.col("_tmax").cast("long")))
    low, high = (F.get(bounds, F.col("_at") + i).cast("double") for i in (0, 1))
    share = (F.col("_tie").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    cell = F.col("_at").cast("long") * TIE_CELLS + F.floor(share * F.lit(TIE_CELLS // TIE_QUANTILES))
    return placed.withColumn("_cell", cell).drop("_at", "_q")


def cumulative_at_ranks(
    df: DataFrame,
    part: Sequence[str],
    score: str,
    hit: str,
    row_id: str,
    cuts: Callable[[Column], Column],
    *,
    descending: bool,
) -> DataFrame:
    """Row count, hits and score sum among the first r rows of each group.

    Rows are ordered by score, equal scores by row id. `cuts` maps the group
    size to an array of structs (cut, r). Whole scores are read off the running
    totals of distinct scores; only a score that a cut divides is ranked row by
    row, in cells of its id range. Returns (part, cut, r, n_total, hits_total,
    hits, score_sum, n_scores).
    """
    part = list(part)
    tie = tie_key(df, row_id)
    base = df.where(F.col(score).isNotNull()).select(
        *part, F.col(score), F.col(hit).cast("long").alias("_y"), tie.alias("_tie"), F.col(row_id).alias("_id")
    )
    distinct = (
        base.groupBy(*part, score)
        .agg(
            F.count("*").alias("n"),
            F.sum("_y").alias("hits"),
            F.min("_tie").alias("_tmin"),
            F.max("_tie").alias("_tmax"),
        )
        .withColumn("psum", F.col("n") * F.col(score))
        .withColumn("scores", F.lit(1).cast("long"))
    )
    totals = running_totals(
        distinct, part, score, ["n", "hits", "psum", "scores"], descending=descending
    )
    edges = (
        totals.withColumn(
            "_c",
            F.explode(
                F.filter(
                    cuts(F.col("n_total")),
                    lambda c: (c["r"] > F.col("n_before"))
                    & (c["r"] <= F.col("n_before") + F.col("n")),
                )
            ),
        )
        .withColumn("cut", F.col("_c.cut"))
        .withColumn("r", F.col("_c.r"))
        .withColumn("_take", F.col("r") - F.col("n_before"))
        .drop("_c")
    )
    divided = (F.col("_take") < F.col("n")) & (F.col("hits") > 0) & (F.col("hits") < F.col("n"))

    # At most one divided score per cut and group.
    split = (
        edges.where(divided)
        .groupBy(*part, score)
        .agg(
            F.first("_tmin").alias("_tmin"),
            F.first("_tmax").alias("_tmax"),
            F.collect_list(F.struct("cut", "_take")).alias("_cuts"),
        )
    )
    tied = tie_cells(base.join(split, [*part, score]), [*part, score])
    keys = [*part, score, "_cell"]
    before = (
        Window.partitionBy(*part, score)
        .orderBy("_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tied.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    ranked = tied.join(offsets, keys).withColumn(
        "_rank",
        F.col("_off") + F.row_number().over(Window.partitionBy(*keys).orderBy("_tie", "_id")),
    )
    partial = (
        ranked.where(F.col("_y") == 1)
        .withColumn(
            "_c", F.explode(F.filter("_cuts", lambda c: F.col("_rank") <= c["_take"]))
        )
        .groupBy(*part, F.col("_c.cut").alias("cut"))
        .agg(F.count("*").alias("_tied_hits"))
    )
    within = (
        F.when(F.col("_take") == F.col("n"), F.col("hits"))
        .when(F.col("hits") == 0, F.lit(0))
        .when(F.col("hits") == F.col("n"), F.col("_take"))
        .otherwise(F.coalesce("_tied_hits", F.lit(0)))
    )
    return edges.join(partial, [*part, "cut"], "left").select(
        *part,
        "cut",
        "r",
        "n_total",
        "hits_total",
        (F.col("hits_before") + within).alias("hits"),
        (F.col("psum_before") + F.col("_take") * F.col(score)).alias("score_sum"),
        F.col("scores_total").alias("n_scores"),
    )


def with_previous_rows(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    row_id: str,
    columns: Callable[[Window], dict[str, Column]],
    *,
    depth: int,
) -> DataFrame:
    """Window columns that look back at most `depth` rows within a key.

    Rows are numbered per key from counts per order slot, cut into blocks of
    BLOCK_ROWS, and the last `depth` rows of a block are repeated at the head
    of the next one. So a key of any size spreads over many tasks. `order`
    holds integer columns (NULL last); rows equal in all of them are ordered by
    a hash of the id. Rows without a key get NULL.
    """
    has_key = F.col(key).isNotNull()
    late = F.lit(2**31 - 1)
    slots = {f"_o{i}": F.coalesce(c.cast("int"), late) for i, c in enumerate(order)}
    # Rows equal in all order columns are dealt by the last bits of their hash, very many also by as many
    # of the first bits as their number asks for.
    slots["_oh"] = F.pmod(F.xxhash64(row_id), F.when(has_key, F.lit(SLOTS)).otherwise(F.lit(1 << 20)))
    marked, same = df.withColumns(slots), list(slots)[:-1]
    many = marked.where(has_key).groupBy(key, *same).agg(F.count("*").alias("_n")).where(F.col("_n") > SLOTS * BLOCK_ROWS)
    many = many.select(key, *same, F.least(F.lit(40), F.ceil(F.log2(F.col("_n") / (SLOTS * BLOCK_ROWS)))).cast("int").alias("_bits"))
    marked = marked.join(many, [key, *same], "left").withColumn("_h", F.xxhash64(row_id))
    marked = marked.withColumn("_ot", F.when(F.col("_bits") > 0, F.expr("shiftright(_h, 64 - _bits)")).otherwise(F.lit(0))).drop("_bits", "_h")
    names = [*same, "_oh", "_ot"]
    counts = marked.where(has_key).groupBy(key, *names).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, *names, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    in_slot = Window.partitionBy(key, *names).orderBy(F.xxhash64(row_id), row_id)
    numbered = marked.join(offsets, [key, *names], "left").withColumn(
        "_idx", F.coalesce("_off", F.lit(0)) + F.row_number().over(in_slot) - 1
    )
    block = F.when(has_key, F.floor(F.col("_idx") / BLOCK_ROWS)).otherwise(F.col("_oh"))
    is_tail = has_key & (F.col("_idx") % BLOCK_ROWS >= BLOCK_ROWS - depth)
    repeated = numbered.withColumn("_home", block).withColumn(
        "_block",
        F.explode(
            F.when(is_tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
                F.array(F.col("_home"))
            )
        ),
    )
    window = Window.partitionBy(key, "_block").orderBy("_idx")
    added = {n: F.when(has_key, c) for n, c in columns(window).items()}
    return (
        repeated.withColumns(added)
        .where(F.col("_block") == F.col("_home"))
        .drop(*names, "_off", "_idx", "_home", "_block")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in `order`.

    The rank filter is pushed below the shuffle by Spark, so each task sends at
    most one row per key however many copies it holds.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")
