"""Small results are checkpointed in few files, whatever the number of shuffle partitions."""

from shotloom.llm import _graph


def test_a_checkpoint_of_few_files_keeps_all_rows(spark):
    most = _graph.FILES * spark.sparkContext.defaultParallelism
    got = _graph.durable(spark.range(1000).repartition(3 * most), few=True)
    assert got.rdd.getNumPartitions() <= most
    assert sorted(r.id for r in got.collect()) == list(range(1000))
