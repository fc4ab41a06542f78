import os

import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.edge import ROWS, frame, prose
from weftline.llm import queries


def agree(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' * os.path.isdir(f'{folder}/{t}.parquet')}')")
    got = entry.queries()[name](spark, folder).toPandas()
    want = c.sql(queries.SQL[name]).df()[list(got.columns)]
    text = lambda x: "" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)
    plain = lambda df: sorted(tuple(map(text, r)) for r in df.astype(object).values.tolist())
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, data, name):
    agree(spark, data, name)


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op3_warc"}))
def test_sql_agrees_on_edges(spark, tmp_path, name):
    lines = [(100 + k, line, "en", "a", 1) for k, line in enumerate(["Cookies! " * 3, "We bake cookies on Sundays and the whole street comes to eat them. " * 4, "all rights\u00a0reserved x y z", "home\u00a0| menu | login", "© 2024 a b\n" + prose(8, 40)])]
    frame(spark, [*ROWS, *lines], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, str(tmp_path), name)


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "best_fit_packing"]
    made = corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    held = entry.queries()["op7_source_mix"](spark, data)
    rows = corpus_pipeline.run(spark, data).collect()
    assert held.count() == docs.count()  # a run deletes no tables but its own
    assert rows and max(r.offset + r.length for r in rows) <= 2048


@pytest.mark.parametrize("rows", [[], [r for r in ROWS if r[1] is None], ROWS, [(None, prose(1, 400_000), None, None, None), (None, "x" * 3_000_000 + " " + prose(2, 60), "en", None, 1)]], ids=["empty", "null", "edges", "long"])
def test_pipeline_stages_on_edges(spark, tmp_path, rows):
    """Every stage takes what its predecessor gives and returns the columns of documents, extra ones with clashing names included."""
    docs = frame(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{tmp_path}/{k}")
    texts = [r[1] for r in rows if r[1]]
    assert docs.isEmpty() if not texts else not docs.isEmpty()
