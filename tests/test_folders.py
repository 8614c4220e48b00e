"""Streams over tables that are folders of files say the same as over tables that are one file."""

import os

import pytest

from codeharbor.catalog import all_queries
from codeharbor.streaming import streams

STREAMS = ["t1_analyze_stream", "t1_changed_analysis_stream", "t1_changed_refs_stream", "t1_ref_history_stream", "t1_table_refs_stream"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same 60 documents as one file and as a folder of three."""
    top = tmp_path_factory.mktemp("tables")
    documents = spark.range(60).selectExpr(
        "id AS doc_id", "concat('text of ', id, '\\nspark.table(\"main.raw.t', id, '\")') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "20L AS n_chars")
    documents.repartition(3, "doc_id").write.parquet(str(top / "folder" / "documents.parquet"))
    documents.coalesce(1).write.parquet(str(top / "made"))
    (top / "file").mkdir()
    part = next(p for p in (top / "made").iterdir() if p.suffix == ".parquet")
    os.rename(part, top / "file" / "documents.parquet")
    assert sum(p.suffix == ".parquet" for p in (top / "folder" / "documents.parquet").iterdir()) == 3
    return top


@pytest.mark.parametrize("name", STREAMS)
def test_a_folder_streams_as_one_file(spark, tables, rows, name):
    told = [rows(all_queries()[name](spark, str(tables / kind))) for kind in ("file", "folder")]
    assert told[0] == told[1] and told[0]


def test_files_that_arrive_in_a_folder_are_read_once(spark, tmp_path):
    folder, out, cp = tmp_path / "t.parquet", str(tmp_path / "out"), str(tmp_path / "cp")
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(folder))
        stream = streams.table_stream(spark, f"{tmp_path}/", "t.parquet", spark.range(0).schema)
        streams.append_stream(stream, out, cp).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
