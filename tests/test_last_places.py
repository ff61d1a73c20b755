"""allele_count_posterior gives the rows of DuckDB where expected numbers lie next to halves of the ninth place: the kernel adds and multiplies in the
order of the SQL, and rounds as it does."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.plans import queries as q

#: Likelihoods (a byte each) of sites, found among random ones.
NEAR = [
    bytes.fromhex("020e670e1c3b802a3824341d724c79455411531b0315205694904e2b3a770c6595115a65533b717938366976631b5d5b932921434b33060161375e674e79803f"),
    bytes.fromhex("534b717d05956833292d0c954e4c709262002d149220490e1519132c2e3d063b5008444a0b75620657273e1b582a807c2347776d5a660f1a91688850568b7f0b"),
    bytes.fromhex("6c891d496135540b84802c318155270b5c7400632e2a67137e4f2c5d533c3e8b6d06423e26600f1f272b4728468f6c5b8973338628682a6761005c831f3a7b21"),
    bytes.fromhex("1b23898f056693652b0c1f7371312112440a5c7c407f11811793872a50552f686c4f6d4c529436753d5828593c088b4f043a842d15312127846c63621b372161"),
    bytes.fromhex("7676852972027331897c7a3e2a77038e6d7b0a1b0a73055775561c81138f04211e08443e2982244282827c526a78667f9007887957323a01138b71191f711f2b"),
    bytes.fromhex("210640296628775c7a0b70095c658d6b15613c6c432a37191a00207a526c41038242646e2b2b45254a823606743224895a351d2b050935872e7536230b5d766f"),
]


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("near"))
    rows = [(k, [float(np.float32(x / 600)) for x in v], 0) for k, v in enumerate(NEAR)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    return d, duck


def test_expected_numbers_match_sql(spark, near):
    d, duck = near
    got = sorted(tuple(r) for r in q.QUERIES["allele_count_posterior"](spark, d).select("site", "p_ref", "ac").collect())
    assert got == sorted(duck.sql(q.ORACLES["allele_count_posterior"]).select("site, p_ref, ac").fetchall())


@pytest.mark.parametrize("digits", [6, 9])
def test_rounds_as_sql(spark, digits):
    duck = duckdb.connect()
    x = [float(v) for v in (np.floor(np.random.default_rng(1).random(20_000) * 40 * 10.0**digits) + 0.5) / 10.0**digits] + [0.0, -0.25, float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, x double")
    got = [r["x"] for r in q._rounded(df, "x", digits=digits).orderBy("k").collect()]
    duck.execute("create table t as select unnest(?::bigint[]) as k, unnest(?::double[]) as x", [list(range(len(x))), x])
    want = [r[0] for r in duck.sql(f"select round(x, {digits}) from t order by k").fetchall()]
    assert got == want
    assert [r["x"] for r in df.withColumn("x", F.round("x", digits)).orderBy("k").collect()] != want
