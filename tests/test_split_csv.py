"""The CSV reader that divides files by byte ranges."""
import os
import random

import pytest
from pyspark.sql import functions as F

from petrel.sources import readers as R
from petrel.sources import writers as W
from petrel.sources.split_csv import file_lines

SCHEMA = "doc_id long, data string, lang string"


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of a few hundred bytes."""
    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


PIECES = ['"', '""', "\n", "\n\n", "\r\n", ",", "a", "word ", "é", "한글", '"\n"', '","', "'", "\\", "\\n", " ", "x" * 50]


def rows(seed, n):
    rng = random.Random(seed)
    out = [(i, "".join(rng.choices(PIECES, k=rng.randint(0, 12))) if i % 7 else None, rng.choice(["en", "de", "", None])) for i in range(n)]
    return out + [(n, "line\n" * 400, "en"), (n + 1, '"' * 31 + "\n" * 31, "en"), (n + 2, "", ""), (n + 3, None, None)]


@pytest.mark.parametrize("size", [64, 200, 333, 1 << 20])
def test_one_file_by_byte_ranges(spark, tmpdir_path, small_ranges, size):
    df = spark.createDataFrame(rows(size, 300), SCHEMA)
    path = os.path.join(tmpdir_path, "one")
    W.write_corpus_csv(df.coalesce(1), path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    want = sorted(R.read_corpus(spark, path, SCHEMA, split=False).collect(), key=str)
    small_ranges(size)
    got = R.read_corpus(spark, path, SCHEMA)
    assert sorted(got.collect(), key=str) == want
    assert sorted((r.doc_id, r.data or "") for r in want) == sorted((i, t or "") for i, t, _ in rows(size, 300))
    if size < 1000:
        tasks = got.where("doc_id < 300").select(F.spark_partition_id().alias("p")).groupBy("p").count()
        assert file_lines(spark, path).rdd.getNumPartitions() >= 8 and tasks.count() >= 8


def test_several_files_and_windows_line_ends(spark, tmpdir_path, small_ranges):
    df = spark.createDataFrame([(i, f'a "{i}"\nb', "en") for i in range(200)], SCHEMA)
    path = os.path.join(tmpdir_path, "many")
    W.write_corpus_csv(df.repartition(5), path)
    with open(os.path.join(path, "part-9.csv"), "wb") as f:
        f.write(b'doc_id,data,lang\r\n900,"x\r\ny",de\r\n\r\n901,"he said ""no""",\r\n902,,en')
    small_ranges(100)
    got = {r.doc_id: (r.data, r.lang) for r in R.read_corpus(spark, path, SCHEMA).collect()}
    assert len(got) == 203 and got[7] == ('a "7"\nb', "en")
    assert got[900] == ("x\r\ny", "de") and got[901] == ('he said "no"', None) and got[902] == (None, "en")


def test_a_quote_that_is_not_closed_fails(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.csv")
    with open(path, "w") as f:
        f.write('doc_id,data,lang\n1,"open,en\n2,b,en\n')
    with pytest.raises(Exception, match="not closed"):
        R.read_corpus(spark, path, SCHEMA).collect()


def test_null_tokens_and_bad_values(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "n.csv")
    with open(path, "w") as f:
        f.write("doc_id,data,lang\n1,NA,en\n")
    assert R.read_corpus(spark, path, SCHEMA, null_tokens=["NA"]).first()["data"] is None
    with open(os.path.join(tmpdir_path, "m.csv"), "w") as f:
        f.write("doc_id,data,lang\none,b,en\n")
    with pytest.raises(Exception):
        R.read_corpus(spark, os.path.join(tmpdir_path, "m.csv"), SCHEMA).collect()
