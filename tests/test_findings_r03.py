"""Small cases of the third review's findings."""

import math
import tempfile
import time
import tracemalloc
import zipfile

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pitchloom.functions import names
from pitchloom.llm import common, packing
from pitchloom.operators import evaluate, quality, resolutions, stats
from pitchloom.plans import registry
from pitchloom.sources import archives

SF = "/root/testdata/sf0.01"


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join " in line]


def fine(spark):
    return resolutions.fine_runs(registry._folded(spark, SF)).persist()


def test_scores_of_resolutions_leave_no_join_to_size_estimates(spark):
    """Tables of clips look small as stored files and large as rows: none may be broadcast by its estimate."""
    found = joins(evaluate.sweep_bins(resolutions.scores(fine(spark), (36, 48, 60), registry.P), registry.P, 3))
    assert found and all("strategy=" in line for line in found)


def test_a_sweep_of_weights_leaves_no_join_to_size_estimates(spark):
    params = spark.createDataFrame(registry._SWEEP, "param string, pcd_w double, dyad_w double, strict double, least double")
    found = joins(evaluate.sweep(params, resolutions.scores(fine(spark), (12, 24, 36), registry.P), ("n_bins",)))
    assert found and all("strategy=" in line for line in found)


def test_cells_that_are_not_broadcast_give_the_same_sweep(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, registry.queries()["sweep_bins_weights_margins"](spark, SF).collect()))
    told = rows()
    monkeypatch.setattr(resolutions, "HELD", 0)
    assert rows() == told and len(told) == 21


def test_percent_rounds_by_the_exact_value_as_sql_does(spark):
    shares = [0.0025, 0.0035, 0.00125, 0.0045, 0.00149999, -0.0004, -0.0, 0.999951, 123456.78125, 1e20, float("nan"), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(x,) for x in shares], "x double")
    for digits in (0, 1, 2):
        told = [r[0] for r in rows.select(names.percent(F.col("x"), digits)).collect()]
        assert told == [duckdb.execute(f"SELECT printf('%.{digits}f%%', ?::DOUBLE * 100)", [x]).fetchone()[0] for x in shares]


def test_draws_are_the_distribution_function_s_and_take_no_loop_over_numbers_drawn():
    rng = np.random.default_rng(0)
    for total, marked in ((50, 1), (60, 2), (400, 30), (7, 7), (90, 85)):
        drawn, u = rng.integers(0, total + 1, 300), rng.random(300)
        got = stats.hypergeometric(total, marked, drawn, u)
        for m, x, y in zip(drawn.tolist(), u.tolist(), got.tolist()):
            upto = lambda k: sum(math.comb(marked, i) * math.comb(total - marked, m - i) for i in range(k + 1) if 0 <= m - i <= total - marked) / math.comb(total, m)
            assert upto(y) > x - 1e-12 and (y == 0 or upto(y - 1) <= x + 1e-12)
    many = np.arange(40_000, 60_000)
    began = time.process_time()
    for _ in range(20):
        stats.hypergeometric(100_000, 3, many, rng.random(len(many)))
    assert time.process_time() - began < 4  # 20,000 different numbers drawn: over 10 s, one by one


def test_a_single_value_is_drawn_by_a_comparison_as_in_sql():
    left = np.arange(0, 5001)
    u = np.random.default_rng(1).random(len(left))
    began = time.process_time()
    assert (stats.hypergeometric(5000, 1, left, u) == (u >= 1 - left / 5000)).all()
    assert time.process_time() - began < 0.05


def test_draws_of_few_marked_ones_are_summed_no_further_than_needed(monkeypatch):
    """As numbers drawn from few marked ones are small, the table over all possible numbers is not made; results are its own."""
    rng, places, k = np.random.default_rng(2), np.arange(5, 37), np.arange(2000, 3000)
    rows = stats.uniforms(3, 1, places, k)
    assert rows.shape == (32, 1000) and all((row == stats.uniforms(3, 1, int(p), k)).all() for p, row in zip(places, rows))
    cases = [(100_000, n, rng.integers(9_800, 10_200, 1000)) for n in (2, 9, 40, 300)] + [(40, 5, rng.integers(0, 36, 1000)), (9, 4, rng.integers(0, 10, 1000))]
    fast = lambda: [stats.hypergeometric(total, n, drawn, rows[0]) for total, n, drawn in cases]
    told = fast()
    began = time.process_time()
    for _ in range(40):
        stats.hypergeometric(*cases[2], rows[1])
    short = time.process_time() - began
    monkeypatch.setattr(stats, "MARKED", 0)
    assert all((a == b).all() for a, b in zip(told, fast()))
    began = time.process_time()
    for _ in range(40):
        stats.hypergeometric(*cases[2], rows[1])
    assert short < time.process_time() - began


def test_short_names_are_sought_by_their_whole_length(spark):
    """Numbers share all their short runs; no pairs of names may be made from these."""
    staged = spark.range(3000).select(F.format_string("Customer#%09d.mp3", "id").alias("path"))
    existing = spark.range(0, 3000, 2).select(F.format_string("Customer#%09d", "id").alias("base"))
    found = quality.not_extracted(staged, existing)
    assert {r[0] for r in found.collect()} == {f"Customer#{k:09d}.mp3" for k in range(1, 3000, 2)}
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_archives_are_written_as_rows_come():
    """Python's own reader takes them, beyond 65,535 entries too; what is held does not grow with the entries."""
    files = [(f"a/é{k}.mp3", k % 3000) for k in range(70_000)] + [("big", 3 << 20)]
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as held:
        tracemalloc.start()
        assert archives.written(iter(files), out, held) == len(files)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        with zipfile.ZipFile(out) as z:
            assert [(x.filename, x.file_size) for x in z.infolist()] == files
            assert z.read("big") == bytes(3 << 20) and z.read(files[4321][0]) == bytes(1321)
    assert peak < 8 << 20


def test_workers_keep_nothing_after_their_tasks(spark):
    """There may be more workers than cores; each that has encoded texts would keep its vocabulary and words."""
    common.known_to_workers(spark)
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("the house and the garden").alias("text")).repartition(16)
    assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 64

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sys.modules["pitchloom.llm.tokens"]._ENCODERS) if "pitchloom.llm.tokens" in sys.modules else 0])], ["n"])

    assert spark.range(0, 64, 1, 32).mapInArrow(held, "n long").agg(F.sum("n")).first()[0] == 0


def test_small_tables_start_no_python_workers(spark):
    rows = [("a", 1, 0.5), ("b", 2, None)]
    df = common.small(spark, rows, {"lang": "string", "l": "int32", "share": "double"})
    assert df.dtypes == [("lang", "string"), ("l", "int"), ("share", "double")] and sorted(map(tuple, df.collect())) == rows
    assert "RDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_batches_for_python_are_bounded_in_bytes_while_tables_are_written(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"])

    texts = spark.range(0, 10_000, 1, 1).select(F.expr("repeat('x', if(id = 7, 9000000, 1000))").alias("text"))
    out = common.stored(texts.mapInArrow(sizes, "n long, b long"), "sizes").agg(F.sum("n"), F.sum((F.col("b") > 5_000_000).cast("int")), F.count("n")).first()
    assert out[0] == 10_000 and out[1] == 1 and out[2] > 2 and spark.conf.get(key) == before
