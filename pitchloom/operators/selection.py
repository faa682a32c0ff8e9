"""Exact order statistics of large groups, without a task that holds a group's values.

A rank is sought in an open interval that narrows: approximate percentiles of what lies in
it give two pivots close to the rank, an exact count says on which side of which pivot the
rank lies. Both are aggregations with partial sums. A round leaves about a fraction
``8 / ACCURACY`` of the interval's values (values equal to a pivot leave it at once, so
that ties cannot stop it); what is left at the end, at most ``LEFT`` values, is sorted.
"""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of an interval that are taken at once, and the accuracy of the pivots.
LEFT, ACCURACY = 10_000, 10_000


def order_statistics(df: DataFrame, value: str, group: str | None, wanted: list[tuple[Hashable, int]], left: int = LEFT, accuracy: int = ACCURACY) -> dict[tuple[Hashable, int], float]:
    """For every wanted ``(group, rank)`` the value with so many others before it, null and NaN left out.

    Ranks must be below the group's number of values. Groups are few: their intervals are
    in the driver. With ``group`` None all rows are the group None. ``df`` is read twice a
    round, so what is costly to make should be stored.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), (F.col(group) if group else F.lit(None).cast("int")).alias("g"))
    member = lambda g: F.col("g").eqNullSafe(F.lit(g))
    found: dict[tuple[Hashable, int], float] = {}
    # (lower, upper, values up to the lower end, values inside), both ends open; None is unbounded.
    names = sorted({g for g, _ in wanted}, key=str)
    sizes = dict(zip(names, rows.agg(*[F.count_if(member(g)) for g in names]).first())) if names else {}
    open_ = {t: (None, None, 0, sizes[t[0]]) for t in wanted}
    if any(not 0 <= rank < sizes[g] for g, rank in wanted):
        raise ValueError("a rank lies beyond its group")
    inside = lambda t: member(t[0]) & (F.lit(True) if open_[t][0] is None else F.col("x") > open_[t][0]) & (F.lit(True) if open_[t][1] is None else F.col("x") < open_[t][1])
    slack = 2.0 / accuracy
    while open_:
        small = [t for t in open_ if open_[t][3] <= left]
        for t in small:
            held = sorted(r["x"] for r in rows.where(inside(t)).select("x").collect())  # at most ``left``
            found[t] = held[t[1] - open_[t][2]]
            del open_[t]
        if not open_:
            break
        todo = list(open_)
        share = {t: (t[1] - open_[t][2] + 0.5) / open_[t][3] for t in todo}
        near = rows.agg(*[F.percentile_approx(F.when(inside(t), F.col("x")), [max(0.0, share[t] - slack), min(1.0, share[t] + slack)], accuracy).alias(f"p{k}") for k, t in enumerate(todo)]).first()
        counts = []
        for k, t in enumerate(todo):
            a, b = near[f"p{k}"]
            counts += [F.count_if(inside(t) & (F.col("x") < a)), F.count_if(inside(t) & (F.col("x") == a)), F.count_if(inside(t) & (F.col("x") > a) & (F.col("x") < b)), F.count_if(inside(t) & (F.col("x") == b))]
        told = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts)]).first()
        for k, t in enumerate(todo):
            (a, b), (low, at_a, between, at_b) = near[f"p{k}"], told[4 * k : 4 * k + 4]
            lower, upper, before, size = open_[t]
            rank = t[1] - before
            if rank < low:
                open_[t] = (lower, a, before, low)
            elif rank < low + at_a:
                found[t] = a
                del open_[t]
            elif rank < low + at_a + between:
                open_[t] = (a, b, before + low + at_a, between)
            elif a < b and rank < low + at_a + between + at_b:
                found[t] = b
                del open_[t]
            else:
                past = low + at_a + (between + at_b if a < b else 0)
                open_[t] = (b, upper, before + past, size - past)
    return found


def medians(df: DataFrame, value: str, group: str | None = None, groups: list | None = None, left: int = LEFT, accuracy: int = ACCURACY) -> dict[Hashable, float | None]:
    """The exact median of each of ``groups`` (few), None where a group has no values."""
    groups = [None] if group is None else list(groups or [])
    x = F.col(value).cast("double")
    valid = x.isNotNull() & ~F.isnan(x)
    sizes = dict(zip(groups, df.agg(*[F.count_if(valid & (F.col(group) == g if group else F.lit(True))) for g in groups]).first()))
    wanted = sorted({(g, r) for g, n in sizes.items() if n for r in ((n - 1) // 2, n // 2)}, key=str)
    at = order_statistics(df, value, group, wanted, left, accuracy)
    return {g: (at[g, (n - 1) // 2] + at[g, n // 2]) / 2 if n else None for g, n in sizes.items()}
