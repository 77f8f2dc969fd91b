import os

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# A cross-section; tools/check_oracle.py compares all of them.
CHECKED = (
    "search_filtered_rerank", "search_without_hits", "best_chunks_per_paper", "triplet_mining", "merge_full_outer",
    "merge_extracted_text", "text_fallback", "chunk_context", "reference_section", "summary_cut", "result_cleanup",
    "ghost_users", "requests_in_progress", "density_outliers", "catalogue_refresh",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def test_every_check_names_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.oracle_sql()) > 150


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want
