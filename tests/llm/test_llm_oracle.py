"""The rows that DuckDB gives for the SQL of this subpackage, on the test tables and on awkward rows."""

import duckdb
import pytest

from lodestar.llm import queries
from test_base import ROWS


def rows_match(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet/*.parquet')" if sf_dir.startswith("/tmp") else f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr) and got


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_match(spark, sf, name):
    rows_match(spark, sf, name)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(r[0], r[1], r[2]) for r in ROWS] + [(None, "x " * 40, None), (None, "x " * 40, "de"), (3, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, k / 50.0], k % 3 or None) for k in range(60)] + [(99, None, 1), (98, [0.0, 0.0], 1), (97, [float("nan"), 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    chats = [(None, 1, "u", "x"), (0, None, None, None), (0, 2, "u", "b"), (0, 1, "a", "a"), (100, 1, "u", "c"), (-5, 3, "u", "d")] + [(k, t, "u", f"é{t} {k % 3}") for k in range(1, 30) for t in (2, 1, 1, None)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_awkward_rows_match(spark, awkward, name):
    rows_match(spark, awkward, name)
