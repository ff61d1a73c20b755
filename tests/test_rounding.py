"""Queries over likelihoods give the rows of DuckDB where components times 600 are halves: as floats they are, as doubles they lie beside."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.plans import projections as P
from strandframe.plans import queries as q
from strandframe.plans import record_queries  # noqa: F401

NAMES = ["allele_count_interval", "allele_count_posterior", "bcf_cat", "bcf_roundtrip", "beagle_likelihoods", "likelihood_gaps", "likelihoods_scaled", "pair_llr", "vcf_roundtrip", "vcf_sample_maxima", "ten_likelihoods", "sites_cat"]


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("halves"))
    rows = [(k, [((k * 17 + i * 29) % 150 + 0.5) / 600 * (-1) ** i for i in range(64)], k % 3) for k in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    return d, duck


def test_likelihoods_round_as_floats(spark, halves):
    x = np.array([((k * 17 + i * 29) % 150 + 0.5) / 600 for k in range(24) for i in range(64)], np.float32)
    want = np.floor((x * np.float32(600)).astype(float) + 0.5)
    assert (want != np.floor(x.astype(float) * 600 + 0.5)).any()
    spread = lambda k, v: [max(c) - min(c) for c in zip(*[iter([*v, 0, 0])] * 3, strict=True)]  # noqa: E731, ARG005
    got = {r["site"]: r["s"] for r in P.likelihoods(spark, halves[0]).select("site", F.transform("pl", F.array_max).alias("s")).collect()}
    assert got == {k: spread(k, v) for k, v in enumerate(want.reshape(24, 64).tolist())}


@pytest.mark.parametrize("name", NAMES)
def test_halves_match_sql(spark, halves, name):
    d, duck = halves
    got, want = q.QUERIES[name](spark, d).toArrow(), duck.sql(q.ORACLES[name]).to_arrow_table()
    rows = lambda t: sorted(repr(tuple(r[n] for n in sorted(t.column_names))) for r in t.to_pylist())
    assert rows(got) == rows(want)
