"""Every query of the engine's own operators against its SQL, on the small tables."""

import os

import duckdb
import pytest

from quillmill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def as_set(rows):
    plain = lambda v: round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = cur.fetchall()
    got = df.select(*(f"`{c}`" for c in cols)).collect()
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("name", ["split_601030", "sample_stratified", "batch_mix", "history_pairs", "fewshot_prompts"])
def test_partitioning_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(as_set(registry.QUERIES[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_typos_differ_and_are_new(spark):
    rows = registry.QUERIES["typo_augment"](spark, SF).collect()
    assert rows and len({r.text_md5 for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
