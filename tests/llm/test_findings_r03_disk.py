"""pipeline on check_h: a loop over few links writes few files, however many partitions a shuffle has."""

from quadrille.llm import graph


def test_components_of_few_edges_write_few_files(spark, monkeypatch):
    cuts = []
    real = graph.cut

    def counted(df):
        out = real(df)
        cuts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # chains of nine, a reversed and a repeated link, a link to itself and a null
        rows = [(i, i + 1) for i in range(200) if i % 10 < 8] + [(5, 4), (4, 5), (7, 7), (None, 3)]
        got = dict(map(tuple, graph.components(spark.createDataFrame(rows, "a long, b long")).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 10 for i in range(200) if i % 10 < 9}
    assert max(cuts[1:]) <= spark.sparkContext.defaultParallelism


def test_more_edges_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 10)
    df = spark.range(1000, numPartitions=50)
    assert graph._packed(df, 300).rdd.getNumPartitions() == 31
    assert graph._packed(df, 3000).rdd.getNumPartitions() == 50
