import os

from pyspark.sql import functions as F

from conftest import SF001
from propwise import fixtures as fx
from propwise.sources import registry as REG
from propwise.streaming import events as EV
from propwise.streaming import jobs as SJ


def _write_parts(df, root, n):
    """Split a table into n JSON files (the file-source twin of a topic)."""
    df = df.withColumn("_p", F.pmod(F.col("event_id"), F.lit(n)))
    for i in range(n):
        df.filter(F.col("_p") == i).drop("_p").coalesce(1).write.mode("overwrite").json(os.path.join(root, f"part{i}"))


def test_audit_stream_dedup_and_restart(spark, scratch):
    ev = fx.prediction_events(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    staging = os.path.join(scratch, "staging")
    _write_parts(ev, staging, 3)
    # repeated deliveries: part0 again
    ev.filter(F.pmod("event_id", F.lit(3)) == 0).coalesce(1).write.json(os.path.join(staging, "dup"))
    import glob
    import shutil

    def move(name):
        for f in glob.glob(os.path.join(staging, name, "*.json")):
            shutil.copy(f, os.path.join(src, f"{name}-{os.path.basename(f)}"))

    move("part0")
    move("dup")
    sink, ck = os.path.join(scratch, "audit"), os.path.join(scratch, "ck")
    q = SJ.audit_stream(SJ.read_event_stream(spark, src), sink, ck)
    q.awaitTermination()
    first = SJ.audit_log(spark.read.parquet(sink)).count()
    move("part1")
    move("part2")
    q = SJ.audit_stream(SJ.read_event_stream(spark, src), sink, ck)   # restart from the checkpoint
    q.awaitTermination()
    out = SJ.audit_log(spark.read.parquet(sink))
    batch = EV.audit_rows(EV.parse_prediction_event(SJ.file_events(ev.withColumn("event_id", F.col("event_id").cast("string")))))
    assert first == ev.filter(F.pmod("event_id", F.lit(3)) == 0).count()
    assert out.count() == batch.count() == out.select("event_id").distinct().count()
    assert sorted(out.select("event_id", "cache_key").collect()) == sorted(batch.select("event_id", "cache_key").collect())


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cache_table_equals_batch_form_after_restart(spark, scratch):
    ev = fx.prediction_events(spark, SF001).withColumn("ts", F.date_trunc("millisecond", F.col("ts").cast("timestamp"))).withColumn(
        "event_id", F.col("event_id").cast("string")).persist()  # JSON files hold milliseconds
    src, root, ck = (os.path.join(scratch, d) for d in ("src", "cache", "ck"))
    parts = ev.withColumn("_p", F.pmod(F.xxhash64("event_id"), F.lit(4)))  # no order of time

    def deliver(p):
        parts.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").json(src)
        SJ.cache_stream(SJ.read_event_stream(spark, src), root, ck).awaitTermination()

    batch = EV.audit_rows(EV.parse_prediction_event(SJ.file_events(parts))).withColumn("output_json", F.to_json("output"))
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    for p in range(4):  # a restart from the checkpoint each time
        deliver(p)
        part = EV.audit_rows(EV.parse_prediction_event(SJ.file_events(parts.filter(F.col("_p") <= p)))).withColumn(
            "output_json", F.to_json("output"))
        want = SJ.latest_per_key(part, now=now, ttl_seconds=10 ** 9)
        assert _rows(SJ.cached(spark, root, now, 10 ** 9)) == _rows(want)
    some = SJ.latest_per_key(batch, now=now, ttl_seconds=3600)
    assert _rows(SJ.cached(spark, root, now)) == _rows(some) and some.count() < want.count()
    # one row for each key, in buckets; only the files of the last version are read
    files = SJ.cached(spark, root, now).inputFiles()
    held = set(SJ.cache_log(spark, root).load()[1]["buckets"].values())
    assert files and all(any(f"/{h}/" in f for h in held) for f in files)
    SJ.vacuum_cache(spark, root)
    assert _rows(SJ.cached(spark, root, now)) == _rows(some)
    ev.unpersist()


def test_a_replayed_fold_changes_nothing(spark, scratch):
    root = os.path.join(scratch, "cache")
    rows = spark.createDataFrame([("k1", 1, "a"), ("k2", 5, "b"), (None, 9, "c")], "cache_key string, s long, event_id string").select(
        "cache_key", F.timestamp_seconds("s").alias("ts"), "event_id", F.lit("{}").alias("output_json"))
    late = rows.withColumn("ts", F.col("ts") - F.expr("interval 1 second"))
    for b, batch in ((0, rows), (0, rows), (1, late), (0, late), (2, rows.limit(0))):
        SJ.fold_cache(batch, b, root, "s0")
        assert [(r["cache_key"], r["event_id"]) for r in SJ.cached(spark, root, F.timestamp_seconds(F.lit(6))).orderBy("cache_key").collect()] \
            == [("k1", "a"), ("k2", "b")]
    assert SJ.cache_log(spark, root).load()[0] == 3


def test_feedback_stream_triggers_once_per_batch(spark, scratch):
    fb = fx.feedback(spark, SF001)
    value = F.to_json(F.struct("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi",
                               "harga_prediksi", "harga_asli", "sumber"))
    rows = fb.select(F.col("feedback_id").alias("event_id"), F.col("created_at").cast("timestamp").alias("created_at"),
                     value.alias("value"))
    src = os.path.join(scratch, "src")
    rows.withColumn("_p", F.pmod("event_id", F.lit(4))).write.partitionBy("_p").json(src)
    root = os.path.join(scratch, "fb")
    calls = []

    def retrain(sp, ids, r):
        calls.append(ids.count())
        return 1.0

    stream = spark.readStream.schema(SJ.FEEDBACK_ROW).option("maxFilesPerTrigger", 1).json(src)
    q = SJ.feedback_stream(stream, root, os.path.join(scratch, "ck"), threshold=50, retrain=retrain)
    q.awaitTermination()
    stored = SJ.stored_feedback(spark, root)
    valid_batch = fb.join(rows.select(F.col("event_id").alias("feedback_id")), "feedback_id")
    from propwise.operators import cleaning as C
    expected_valid = C.split_valid(C.validate_feedback(valid_batch))[0].count()
    assert stored.count() == expected_valid
    assert calls and all(c >= 50 for c in calls)
    status = SJ.run_status(spark.read.parquet(os.path.join(root, "ledger"))).collect()
    assert all(r["status"] == "success" for r in status) and len(status) == len(calls)
    done = spark.read.parquet(os.path.join(root, "processed_ids"))
    assert done.count() == done.select("feedback_id").distinct().count() == sum(calls)


def test_registry_promote_and_metadata(spark, scratch):
    v1 = REG.register_version(spark, scratch, "price", {"mape": 10.0})
    v2 = REG.register_version(spark, scratch, "price", {"mape": 9.0})
    REG.promote(spark, scratch, "price", v1)
    REG.promote(spark, scratch, "price", v2)
    assert (v1, v2) == (1, 2)
    assert REG.current_version(spark, scratch, "price") == 2
    stages = {r["version"]: r["stage"] for r in REG.versions(spark, scratch).collect()}
    assert stages == {1: "Archived", 2: "Production"}
    REG.write_model_metadata(spark, scratch, "price", 2, {"batas_segmen": 1.2e9})
    assert REG.read_model_metadata(spark, scratch, "price") == {"batas_segmen": 1.2e9}


def test_two_writers_never_share_a_version(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: REG.register_version(spark, scratch, "price", {"i": i}), range(8)))
    assert sorted(got) == list(range(1, 9))
    rows = REG.versions(spark, scratch).collect()
    assert sorted(r["version"] for r in rows) == list(range(1, 9)) and {r["stage"] for r in rows} == {"None"}


def test_a_ledger_that_cannot_be_read_is_no_empty_ledger(spark, scratch):
    REG.register_version(spark, scratch, "price", {})
    for path, _, names in os.walk(os.path.join(scratch, "model_events")):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(path, name), "wb") as f:
                    f.write(b"no parquet")
            elif name.endswith(".crc"):
                os.unlink(os.path.join(path, name))
    import pytest
    with pytest.raises(Exception):
        REG.current_version(spark, scratch, "price")


def _log(spark, root):
    from propwise.sources import log as L

    def fold(state, entry):
        state["sum"] = state.get("sum", 0) + entry["n"]
        state.setdefault("seen", {})[entry["who"]] = entry["n"]
    return L.CommitLog(spark, root, fold)


def test_ten_thousand_commits_list_few_files(spark, scratch):
    from propwise.sources import log as L
    log = _log(spark, scratch)
    # a log as long as it gets, written as the log writes it
    base = 9_950
    L.write_once(spark, log._path(base, "state"), '{"sum": %d, "seen": {"a": %d}}' % (sum(range(1, base + 1)), base))
    for n in range(base + 1, 10_121):
        assert log.append({"n": n, "who": "a"})[0] == n
        if n % 20 == 0:
            assert len(L.names(spark, scratch)) <= 2 * log.every + 3
    version, state = log.load()
    assert version == 10_120 and state == {"sum": sum(range(1, 10_121)), "seen": {"a": 10_120}}


def test_two_writers_of_a_log_lose_nothing(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor
    def write(who):
        log = _log(spark, scratch)
        return [log.append({"n": n, "who": who})[0] for n in range(30)]
    with ThreadPoolExecutor(3) as pool:
        got = [v for vs in pool.map(write, "abc") for v in vs]
    assert sorted(got) == list(range(1, 91))
    assert _log(spark, scratch).load() == (90, {"sum": 3 * sum(range(30)), "seen": {w: 29 for w in "abc"}})
    assert _log(spark, scratch).append({"n": 1, "who": "d"}, lambda s: s["sum"] < 0) is None


def test_live_area_stats_stream_equals_batch(spark, scratch):
    from propwise.plans import jobs
    clu = jobs.clean_clustering_table(spark, SF001).select("lokasi", "harga")
    src = os.path.join(scratch, "docs")
    clu.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(clu.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (SJ.live_area_stats(stream).writeStream.outputMode("complete").format("memory")
         .queryName("live_stats_test").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("live_stats_test").select("lokasi", "jumlah_data", "min_harga", "max_harga")
    want = SJ.live_area_stats(clu).select("lokasi", "jumlah_data", "min_harga", "max_harga")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_cache_ttl_expires_old_rows(spark):
    rows = [("k1", "2024-01-01 00:00:00", 1, "a"), ("k1", "2024-01-01 00:50:00", 2, "b"),
            ("k2", "2024-01-01 00:00:00", 3, "c")]
    log = spark.createDataFrame(rows, "cache_key string, ts string, event_id long, output_json string") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = SJ.latest_per_key(log, now=F.to_timestamp(F.lit("2024-01-01 01:10:00")), ttl_seconds=3600).collect()
    assert [(r["cache_key"], r["event_id"]) for r in got] == [("k1", 2)]


def test_feedback_handler_replay_is_idempotent(spark, scratch):
    fb = fx.feedback(spark, SF001)
    value = F.to_json(F.struct("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi",
                               "harga_prediksi", "harga_asli", "sumber"))
    batch = fb.select(F.col("feedback_id").alias("event_id"), F.col("created_at").cast("timestamp").alias("created_at"),
                      value.alias("value")).limit(120)
    root = os.path.join(scratch, "fb")
    calls = []
    handle = SJ.feedback_batch_handler(root, threshold=50, retrain=lambda sp, ids, r: calls.append(ids.count()))
    handle(batch, 0)
    handle(batch, 0)          # replay of the same micro-batch
    stored = spark.read.parquet(os.path.join(root, "feedback"))
    assert stored.count() == stored.select("feedback_id").distinct().count()
    assert len(calls) == 1
    assert SJ.pending_feedback(spark, root).count() == 0


def test_feedback_stream_with_real_retrain(spark, scratch):
    from propwise.plans import jobs
    from propwise.streaming.retrain import make_retrain

    fb = fx.feedback(spark, SF001)
    value = F.to_json(F.struct("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi",
                               "harga_prediksi", "harga_asli", "sumber"))
    rows = fb.select(F.col("feedback_id").alias("event_id"), F.col("created_at").cast("timestamp").alias("created_at"),
                     value.alias("value"))
    src = os.path.join(scratch, "src")
    rows.withColumn("_p", F.pmod("event_id", F.lit(2))).write.partitionBy("_p").json(src)
    root, reg = os.path.join(scratch, "fb"), os.path.join(scratch, "registry")
    retrain = make_retrain(lambda sp: jobs.clean_regression_table(sp, SF001), reg, secondary=True,
                           price={"max_iter": 5}, segment={"max_iter": 2, "max_depth": 3},
                           clusters={"k": 3, "restarts": 1, "max_iter": 5})
    stream = SJ.read_feedback_stream(spark, src, max_files=1)
    SJ.feedback_stream(stream, root, os.path.join(scratch, "ck"), threshold=300, retrain=retrain).awaitTermination()
    status = SJ.run_status(spark.read.parquet(os.path.join(root, "ledger"))).collect()
    assert status and all(r["status"] == "success" and r["score"] > 0 for r in status)
    for name in ("price", "segment", "cluster"):
        versions = REG.versions(spark, reg).filter(F.col("model") == name).orderBy("version").collect()
        assert len(versions) == len(status) and versions[-1]["stage"] == "Production"
    meta = REG.read_model_metadata(spark, reg, "price")
    assert meta["batas_segmen"] > 0 and meta["metrics"]["overall"]["mape"] > 0
    assert REG.read_model_metadata(spark, reg, "segment")["report"]
    # what serves is what the last run stored
    from propwise.sources import model_store as MS
    assert MS.load_current(spark, reg, "price").threshold == meta["batas_segmen"]


def _value(fb):
    return fb.select(F.col("feedback_id").cast("string").alias("event_id"),
                     F.col("created_at").cast("timestamp").alias("created_at"),
                     F.to_json(F.struct("kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi",
                                        "harga_prediksi", "harga_asli", "sumber")).alias("value"))


def _kafka(spark, rows):
    return spark.createDataFrame(rows, "value binary, topic string, partition int, offset long").withColumn(
        "timestamp", F.current_timestamp())


def test_kafka_event_ids_differ_across_partitions_and_prefer_the_payload(spark):
    raw = _kafka(spark, [(b'{"tool":"a"}', "t", 0, 5), (b'{"tool":"b"}', "t", 1, 5), (b'{"tool":"c"}', "u", 0, 5),
                         (b'{"event_id":"own","tool":"d"}', "t", 0, 6), (b'{"event_id":"own","tool":"d"}', "t", 0, 7)])
    ids = sorted(r["event_id"] for r in SJ.kafka_events(raw).collect())
    assert ids == ["t-0-5", "t-1-5", "t/own", "t/own", "u-0-5"]
    assert SJ.audit_log(EV.audit_rows(EV.parse_prediction_event(SJ.kafka_events(raw)))).count() == 4


def test_ids_shared_over_topics_and_empty_ids_lose_no_event(spark):
    raw = _kafka(spark, [(f'{{"event_id":"{i}","tool":"x"}}'.encode(), t, 0, i) for t in ("t", "u") for i in range(3)]
                 + [(b'{"event_id":"","tool":"x"}', "t", 1, i) for i in range(2)] + [(b'{"event_id":"  "}', "u", 1, 9)])
    events = SJ.kafka_events(raw)
    assert events.select("event_id").distinct().count() == 9
    assert SJ.audit_log(EV.audit_rows(EV.parse_prediction_event(events))).count() == 9
    # corrections: an own id never looks like the place of another
    raw = _kafka(spark, [(b'{"event_id":"@f-0-1"}', "f", 0, 0), (b'{}', "f", 0, 1), (b'{"event_id":""}', "f", 0, 2)])
    assert sorted(r["event_id"] for r in SJ.kafka_feedback(raw).collect()) == ["@@f-0-1", "@f-0-1", "@f-0-2"]


def test_corrections_of_files_without_ids_are_all_kept(spark, scratch):
    rows = _value(fx.feedback(spark, SF001)).where("cast(event_id as long) % 10 <> 0").limit(24).persist()
    n = SJ.prepare_feedback(rows)[0].count()
    src, root = os.path.join(scratch, "src"), os.path.join(scratch, "fb")
    rows.drop("event_id").coalesce(2).write.json(src)                                  # no id at all
    rows.withColumn("event_id", F.lit("")).coalesce(1).write.mode("append").json(src)  # an empty one
    rows.coalesce(1).write.mode("append").json(src)
    rows.coalesce(1).write.mode("append").json(src)                                    # delivered again
    stream = SJ.read_feedback_stream(spark, src, max_files=1)
    SJ.feedback_stream(stream, root, os.path.join(scratch, "ck"), threshold=10 ** 6).awaitTermination()
    assert SJ.stored_feedback(spark, root).count() == SJ.pending_feedback(spark, root).count() == 3 * n > 0
    rows.unpersist()


def test_redeliveries_are_dropped_in_the_stream_and_events_without_ids_are_not(spark, scratch):
    src, sink = os.path.join(scratch, "src"), os.path.join(scratch, "audit")
    rows = [("1", "t"), ("1", "u"), ("1", "t"), (None, "t"), (None, "t"), ("", "u"), ("2", "t")]
    df = spark.createDataFrame(rows, "event_id string, topic string").withColumn("ts", F.timestamp_seconds(F.lit(10 ** 9))).withColumn(
        "payload", F.lit('{"tool":"x"}'))
    for again in range(2):  # the second time all of them come again, as late as can be
        df.withColumn("ts", F.timestamp_seconds(F.lit(10 ** 9))).coalesce(1).write.mode("append").json(src)
        SJ.audit_stream(SJ.read_event_stream(spark, src), sink, os.path.join(scratch, "ck")).awaitTermination()
        stored = spark.read.parquet(sink)
        assert stored.count() == SJ.audit_log(stored).count() == 6 + 3 * again


def test_a_new_checkpoint_on_an_old_root_keeps_every_row(spark, scratch):
    rows = _value(fx.feedback(spark, SF001)).limit(60).persist()
    root = os.path.join(scratch, "fb")
    for k in range(2):  # the second stream starts again at batch 0
        src = os.path.join(scratch, f"src{k}")
        rows.filter(F.pmod(F.col("event_id").cast("long"), F.lit(2)) == k).coalesce(1).write.json(src)
        SJ.feedback_stream(SJ.read_feedback_stream(spark, src), root, os.path.join(scratch, f"ck{k}"),
                           threshold=10 ** 6).awaitTermination()
    valid, bad = SJ.prepare_feedback(rows)
    stored = spark.read.parquet(os.path.join(root, "feedback"))
    assert stored.count() == SJ.stored_feedback(spark, root).count() == valid.count()
    assert spark.read.parquet(os.path.join(root, "quarantine")).count() == bad.count()


def test_a_crash_between_the_writes_keeps_each_row_once(spark, scratch):
    rows = _value(fx.feedback(spark, SF001)).limit(60).persist()
    valid, bad = SJ.prepare_feedback(rows)
    root = os.path.join(scratch, "fb")
    folder = SJ.batch_folder("s0", 0)
    # died after the first write (a part of its rows), before quarantine and commit marker
    valid.limit(5).write.parquet(os.path.join(root, "feedback", folder))
    assert SJ.committed(spark, root) == {} and SJ.pending_feedback(spark, root).count() == 0
    handle = SJ.feedback_batch_handler(root, threshold=10 ** 6)
    for _ in range(2):
        handle(rows, 0)
    assert spark.read.parquet(os.path.join(root, "feedback")).count() == valid.count()
    assert spark.read.parquet(os.path.join(root, "quarantine")).count() == bad.count()
    # an all-invalid batch that is replayed
    none = rows.withColumn("value", F.lit("{}"))
    for _ in range(2):
        handle(none, 1)
    assert spark.read.parquet(os.path.join(root, "quarantine")).count() == bad.count() + 60


def test_runs_cut_short_are_closed(spark, scratch):
    rows = _value(fx.feedback(spark, SF001)).limit(60).persist()
    root = os.path.join(scratch, "fb")
    seen = []
    handle = SJ.feedback_batch_handler(root, threshold=10, retrain=lambda sp, ids, r: seen.append(ids.count()) or 1.0)
    SJ.store_batch(rows, 0, root, "s0")
    SJ.start_run(spark, root, "run-dead", 0, 5, SJ.pending_folders(spark, root))   # died while training
    handle(rows, 0)                                                 # the replay trains those rows
    n = SJ.stored_feedback(spark, root).count()
    status = {r["run_id"]: r["status"] for r in SJ.run_status(spark.read.parquet(os.path.join(root, "ledger"))).collect()}
    assert status.pop("run-dead") == "failed" and list(status.values()) == ["success"] and seen == [n]
    # died after the ids were stored, before 'success': not trained again
    late = _value(fx.feedback(spark, SF001)).exceptAll(rows).limit(40).persist()
    SJ.store_batch(late, 1, root, "s0")
    ids = SJ.pending_feedback(spark, root)
    m, folders = ids.count(), SJ.pending_folders(spark, root)
    ids.select(*[f.name for f in SJ.STORED_FEEDBACK]).write.parquet(os.path.join(root, "archive", "run_id=run-late"))
    SJ.start_run(spark, root, "run-late", 1, m, folders)
    ids.select("feedback_id").write.parquet(os.path.join(root, "processed_ids", "run_id=run-late"))
    handle(late, 1)
    status = {r["run_id"]: r["status"] for r in SJ.run_status(spark.read.parquet(os.path.join(root, "ledger"))).collect()}
    assert status["run-late"] == "success" and sorted(status.values()) == ["failed", "success", "success"] and seen == [n]
    assert SJ.pending_feedback(spark, root).count() == 0 and SJ.stored_feedback(spark, root).count() == n + m


def test_whole_numbers_written_with_a_fraction_are_numbers(spark):
    v = ['{"kamar_tidur":3.0,"kamar_mandi":2,"garasi":"1.0","luas_tanah":90,"luas_bangunan":"70",'
         '"lokasi":"A","harga_prediksi":1e9,"harga_asli":1000000000}', '{"kamar_tidur":99999999999,"kamar_mandi":"x"}']
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "event_id string, value string")
    a, b = EV.parse_feedback_event(df).orderBy("event_id").collect()
    assert (a["kamar_tidur"], a["kamar_mandi"], a["garasi"]) == (3, 2, 1)
    assert b["kamar_tidur"] is None and b["kamar_mandi"] is None
    p = spark.createDataFrame([("1", '{"input":{"kamar_tidur":3.0},"output":{"kelas_id":2.0}}')], "event_id string, payload string")
    r = EV.parse_prediction_event(p).collect()[0]
    assert (r["kamar_tidur"], r["kelas_id"]) == (3, 2)


def test_audit_read_prunes_days(spark, scratch):
    ev = fx.prediction_events(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp"))
    src, sink = os.path.join(scratch, "src"), os.path.join(scratch, "audit")
    ev.write.json(src)
    SJ.audit_stream(SJ.read_event_stream(spark, src), sink, os.path.join(scratch, "ck")).awaitTermination()
    got = SJ.audit_log(spark.read.parquet(sink)).where("day >= '2024-01-02'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "day" in plan.split("PartitionFilters:")[1][:120]


def test_briefs_are_cached_for_an_hour_and_carry_the_models_own_error(spark, scratch):
    from propwise.operators import brief as BR
    rows = [("harga rumah", 0, 1, "old"), ("harga rumah", 100, 2, "new"), ("sewa", 10, 3, "other")]
    df = spark.createDataFrame(rows, "query string, s long, request_id long, brief string").withColumn("ts", F.timestamp_seconds("s"))
    root = os.path.join(scratch, "briefs")
    for b, part in enumerate((df.where("s > 50"), df.where("s <= 50"))):
        SJ.fold_cache(BR.brief_cache_rows(part), b, root, "s0")
    at = lambda s: {r["output_json"] for r in SJ.cached(spark, root, F.timestamp_seconds(F.lit(s))).collect()}
    assert at(200) == {"new", "other"} and at(3650) == {"new"} and at(3800) == set()
    assert BR.model_errors(spark, None) == (1.2e9, 10.0824, 10.6653) == BR.model_errors(spark, scratch)
    got = BR.with_model_error(spark.createDataFrame([(1e9,), (2e9,)], "harga_estimasi double"), (1.5e9, 7.0, 9.0)).collect()
    assert [r["mape_persen"] for r in got] == [7.0, 9.0]


def test_checked_feedback_is_parsed_once_a_row(spark):
    """The rules read many fields: the filter on them reads a written table, not the JSON again."""
    rows = spark.createDataFrame([("1", '{"kamar_tidur": 2, "kamar_mandi": 1}'), ("2", "{}")], "event_id string, value string")
    for part in SJ.prepare_feedback(rows):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "jsontostructs" not in plan.lower()
