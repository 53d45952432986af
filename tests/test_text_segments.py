"""Texts that begin with the sync byte and are as long as packets: queries on text segments leave them as they are."""

import duckdb
import pytest

from bytesieve.plans import catalog
from compare import compare


def conversations(spark, path):
    rows = [(10, 0, "user", "first"), (10, 1, "user", ("G" + "ood day to you. " * 30)[:2 * 188 - 4]),
            (10, 2, "user", "G \n" + "x" * (188 - 7)), (12, 0, "user", "other")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(path))


@pytest.mark.parametrize("name", ["filter_segment", "clean_stream_hls", "clean_dispatch", "hls_output"])
def test_text_is_not_repaired(spark, tmp_path, name):
    conversations(spark, tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    msg, _, _, rows = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path))
    assert not msg and rows
