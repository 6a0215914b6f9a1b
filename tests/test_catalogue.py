"""Some queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

from lexiloom.plans import catalogue, files, reports  # noqa: F401  (the last two add to the catalogue)

SF = "/root/testdata/sf0.001"
NAMES = ["group_advantage", "lr_schedule", "prep_accounting", "lang_codes", "span_ids", "prep_token_shards", "panel_combined", "contamination_matches", "choice_examples", "composed_words", "source_jsonl_groups", "source_csv_pairs", "source_jsonl_budget", "sink_by_lang", "sink_vocabulary", "rate_limited_counts", "sql_shingles"]
NAMES += ["tok_eval_by_lang", "byte_parity", "truncate_bytes", "dedup_exact", "word_budget", "shard_assignment", "vocab_topk", "spearman", "kruskal_h", "worst_quartile", "best_threshold", "token_f1", "leaderboard", "taxonomy_cascade", "stream_dedup"]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    show = lambda df: sorted(tuple(round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert show(mine) == show(theirs)
