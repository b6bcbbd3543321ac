def test_partitions_of_a_large_training_frame_are_bounded_in_rows(spark, monkeypatch):
    from propwise import session

    many = spark.range(4_000)
    for _ in range(9):
        many = many.unionByName(spark.range(4_000))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(session, "DEALT_ROWS", 500, raising=False)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        sizes = session.dealt(many, ["id"]).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert sum(sizes) == 40_000 and len(sizes) == 80 > 4 * spark.sparkContext.defaultParallelism and max(sizes) < 1_000
