"""A sample of the registered queries against their oracles, and the entry points."""

import duckdb
import pytest

from pitchloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = ["pcd_by_clip", "tonic_by_clip", "stability_gate", "transitions_directed", "transitions_variant_b", "raga_models", "excluded_ragas", "score_mean_sub", "note_energy", "dedup_best", "ngram_recall", "source_inventory", "cohens_d"]


def shown(v):
    return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, duck, name):
    a = registry.queries()[name](spark, SF).toPandas()
    b = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(a) == key(b)


def test_metadata_of_the_whole_table(spark, duck):
    rows = {tuple(r) for r in registry.queries()["metadata_first_match"](spark, SF).collect()}
    assert rows == set(duck.sql(registry.oracle_sql()["metadata_first_match"]).fetchall())
    assert len(rows) == duck.sql("SELECT count(*) FROM part").fetchall()[0][0]


def test_permutation_p_does_all_shuffles(spark):
    p = registry.queries()["permutation_p"](spark, SF).first()["p"]
    assert abs(p * 50_001 - round(p * 50_001)) < 1e-6 and abs(p * 2001 - round(p * 2001)) > 1e-6


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and {r["confidence_tier"] for r in rows} <= {"HIGH", "MODERATE", "UNKNOWN"}
