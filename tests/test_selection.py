"""Exact order statistics against sorting."""

import random
import statistics

import pytest

from pitchloom.operators import selection, stats


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "wide", "equal"])
def test_ranks_equal_sorting(spark, kind):
    rnd = random.Random(kind)
    make = {"spread": lambda: rnd.gauss(0, 1), "ties": lambda: float(rnd.randrange(4)), "two": lambda: rnd.choice([5.0, 7.0]), "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300), "equal": lambda: 3.0}[kind]
    values = {"a": [make() for _ in range(3000)], "b": [make() for _ in range(2001)]}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("a", None), ("b", float("nan")), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5).cache()
    wanted = [("a", 0), ("a", 1499), ("a", 1500), ("a", 2999), ("b", 1000), ("b", 7)]
    got = selection.order_statistics(df, "x", "g", wanted, left=50, accuracy=100)
    assert got == {(g, k): sorted(values[g])[k] for g, k in wanted}
    assert selection.medians(df, "x", "g", ["a", "b", "none"], left=50, accuracy=100) == {"a": statistics.median(values["a"]), "b": statistics.median(values["b"]), "none": None}


def test_a_rank_beyond_its_group_is_refused(spark):
    with pytest.raises(ValueError, match="beyond"):
        selection.order_statistics(spark.range(3), "id", None, [(None, 3)])


def test_median_of_an_empty_reference(spark):
    one = stats.above_median(spark.createDataFrame([("a", 2.0)], "g string, x double"), "x", "g", "a", "b").first()
    assert (one["reference_median"], one["target_median"], one["beats"]) == (None, 2.0, 0)
