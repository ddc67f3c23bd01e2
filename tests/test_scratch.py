"""Tables that are built once a session follow their inputs."""

import os
import shutil

import pyarrow.parquet as pq
import pytest

from ledgerlark.plans import corpus, sales
from ledgerlark.sources import scratch


def test_index_follows_a_rewritten_table(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    for n in (3, 9, 9, 2):
        spark.range(n).selectExpr("id AS doc_id", "concat('text ', id, ' of the table') AS text", "'en' AS lang", "'s' AS source").coalesce(1).write.mode("overwrite").parquet(path)
        assert corpus.a18(spark, str(tmp_path)).first().n_chunks == n
        assert corpus.s12(spark, str(tmp_path)).select("chunk_id").distinct().count() == n
        assert corpus.a17(spark, str(tmp_path)).where("term = 'table'").first().df == n


def test_clean_table_follows_a_rewritten_file(spark, sf_dir, tmp_path):
    for t in ("lineitem", "orders", "supplier", "nation", "region", "part"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    all_rows = sales.lines_of(spark, str(tmp_path)).count()
    again = sales.lines_of(spark, str(tmp_path))
    half = pq.read_table(f"{sf_dir}/lineitem.parquet", filters=[("l_orderkey", "<", 700)])
    os.remove(f"{tmp_path}/lineitem.parquet")
    pq.write_table(half, f"{tmp_path}/lineitem.parquet")
    assert again.count() == all_rows
    fewer = sales.lines_of(spark, str(tmp_path))
    assert 0 < fewer.count() < all_rows
    assert fewer.inputFiles() != again.inputFiles()


def test_a_table_that_was_made_again_takes_no_room(spark, tmp_path):
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    first = scratch.built_once(spark, ("t", str(tmp_path)), "a", lambda: build(5))
    assert scratch.built_once(spark, ("t", str(tmp_path)), "a", lambda: build(6)).count() == 5 and made == [5]
    folder = first.inputFiles()[0].rsplit("/", 1)[0]
    assert scratch.built_once(spark, ("t", str(tmp_path)), "b", lambda: build(7)).count() == 7
    assert spark.read.schema(first.schema).parquet(folder).count() == 0


@pytest.mark.parametrize("change", ["length", "time"])
def test_state_names_files_as_they_are(spark, tmp_path, change):
    file = tmp_path / "x.bin"
    file.write_bytes(b"abc")
    before = scratch.files_state(spark, [str(tmp_path)])
    assert scratch.files_state(spark, [str(tmp_path)]) == before
    if change == "length":
        file.write_bytes(b"abcd")
    else:
        os.utime(file, (1, 1))
    assert scratch.files_state(spark, [str(tmp_path)]) != before
