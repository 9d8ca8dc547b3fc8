"""Row marks stay the same however a later scan splits the files."""

import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, cuckoo


@pytest.mark.parametrize("files", [1, 3])
def test_marks_do_not_follow_the_splits(spark, tmp_path, files):
    path, key = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.repartition(files).write.option("parquet.block.size", 1 << 14).parquet(path)
    docs, old = spark.read.parquet(path), spark.conf.get(key)
    marked = common.with_row(docs)
    try:
        seen = []
        for size in ("1g", "16k"):
            spark.conf.set(key, size)
            again = marked.select("*")
            seen.append(({r.doc_id: r[common.ROW] for r in again.collect()}, again.rdd.getNumPartitions()))
    finally:
        spark.conf.set(key, old)
    assert seen[0][1] != seen[1][1]
    assert seen[0][0] == seen[1][0] and len(set(seen[0][0].values())) == 4000


def test_marks_of_a_table_that_is_not_stored(spark, tmp_path):
    docs = spark.range(100).select((F.col("id") % 10).alias("doc_id"), F.expr("concat('t', id % 7)").alias("text"))
    docs = docs.union(docs).repartition(5)
    assert not common._stored(docs)
    marked = common.with_row(docs)
    assert marked.select(common.ROW).distinct().count() == 200
    assert sorted(r.text for r in cuckoo.deduplicated(docs).collect()) == [f"t{i}" for i in range(7)]
