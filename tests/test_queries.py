import os

import duckdb
import pytest

from askmill.jobs import registry
from tests.oracle import SMALL, connect, rows


def test_each_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = connect().execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def null_texts(tmp_path_factory):
    """The small tables, where some of the nearest neighbours of both questions have a null text: of the first's one of two, of the second's all, and it has none itself."""
    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(SMALL):
        if name not in ("documents.parquet", "embeddings.parquet"):
            os.symlink(f"{SMALL}/{name}", folder / name)
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when doc_id not in (7, 9, 100) then text end as text) from '{SMALL}/documents.parquet') to '{folder}/documents.parquet'")
    con.execute(f"""copy (select v.* replace (coalesce(x.embedding, v.embedding) as embedding) from '{SMALL}/embeddings.parquet' v
        left join '{SMALL}/embeddings.parquet' x on x.vec_id = case when v.vec_id in (7, 8) then 0 when v.vec_id = 9 then 100 end) to '{folder}/embeddings.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["build_prompts", "context_per_query"])
def test_null_texts(spark, null_texts, name):
    got = registry.queries()[name](spark, null_texts).toPandas()
    assert rows(got) == rows(connect(null_texts).execute(registry.oracle_sql()[name]).df())
