import hashlib
import json
import os
import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from dayledger.functions.stats import SCHEMA, finalize
from dayledger.operators.profile import profile
from dayledger.operators.spec import Dataset, ListStats, Rows, TextCounts
from dayledger.sources import commits, logs, records, tables
from dayledger.sources.tables import written
from dayledger.streaming import daily, incremental, sightings


def write_csv(path, rows, columns):
    lines = [",".join(columns)]
    lines += [",".join('"' + r.get(c, "").replace('"', '""') + '"' for c in columns) for r in rows]
    path.write_text("\n".join(lines) + "\n")


BASE = {"uuid": "1", "platform_name": "SIA \"JOOM\"", "category": "STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE", "content_type": '["CONTENT_TYPE_TEXT","CONTENT_TYPE_OTHER"]', "category_addition": "[]", "decision_facts": 'a "quoted",\nsecond line', "application_date": "2024-03-14 01:02:03", "territorial_scope": "[" + ",".join(f'"{c}"' for c in records.EU) + "]"}


def test_ingest(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "old").mkdir()
    write_csv(tmp_path / "new" / "a.csv", [BASE, BASE | {"uuid": "2", "application_date": "soon"}, BASE | {"uuid": "3", "category": "WHAT"}], list(records.FIELDS))
    write_csv(tmp_path / "old" / "b.csv", [BASE | {"uuid": "4", "territorial_scope": '["DE"]'}], [c for c in records.FIELDS if c != "content_id_ean"])
    raw = records.read_all_versions(spark, [str(tmp_path / "old")], [str(tmp_path / "new")])
    aliases = spark.createDataFrame([('SIA "JOOM"', "Joom")], "alias string, canonical string")
    good, bad = records.ingest(raw, date(2024, 3, 14), aliases, {"category": [BASE["category"]]})
    tables.check_schema(good, records.SCHEMA)
    rows = {r.uuid: r for r in good.collect()}
    assert set(rows) == {"1", "4"}
    assert rows["1"].platform_name == "Joom" and rows["1"].content_type == ["CONTENT_TYPE_TEXT", "CONTENT_TYPE_OTHER"]
    assert rows["1"].category_addition is None and rows["1"].decision_facts == BASE["decision_facts"] and rows["1"].territorial_scope == ["EU"]
    assert rows["4"].territorial_scope == ["DE"] and rows["4"].content_id_ean is None
    assert {r.uuid: r.reasons for r in bad.collect()} == {"2": ["application_date: not a time"], "3": ["category: unknown value"]}
    stats = profile(good, records.PROFILE)
    assert stats.where("column = 'content_type' and entity = 'elements'").agg(F.sum("count")).first()[0] == 4
    assert stats.where("column = 'decision_type' and entity = 'is_null'").agg(F.sum("count")).first()[0] == 2


def test_csv_of_bounded_files(spark, tmp_path):
    """No file, and so no task that reads one, holds more rows than a batch; rows with newlines come back whole."""
    rows = spark.range(2500).coalesce(1).selectExpr(*[f"concat(id, ',\"\\n', id) {c}" if c == "decision_facts" else f"cast(id as string) {c}" for c in records.FIELDS])
    records.write_csv(rows, str(tmp_path / "x"), 1000)
    back = records.read_csv(spark, str(tmp_path / "x"))
    assert [r["count"] for r in back.groupBy("file").count().orderBy("count").collect()] == [500, 1000, 1000]
    assert back.select(*rows.columns).exceptAll(rows).isEmpty() and back.count() == 2500
    assert tables.text_row_counts(spark, str(tmp_path / "x"), "7").agg(F.sum("rows")).first()[0] == 5000


def test_files_are_hashed_once(spark):
    """The query uses the digests three times, and reads no file again for that."""
    from dayledger.plans.queries import QUERIES

    found = QUERIES["file_digests"](spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = "/root/testdata/sf0.001/lineitem.parquet"
    if os.path.isfile(own):
        assert found.where("file = 'lineitem.parquet'").first().digest == hashlib.sha256(open(own, "rb").read()).hexdigest()


def test_large_files_are_streamed(spark, tmp_path):
    """From 32 MB on no file is a value; stores need be such as Spark opens, and names may be odd."""
    (tmp_path / "a b").mkdir()
    content = {"x y%20.bin": os.urandom(1 << 25), "s.bin": b"s"}
    for name, data in content.items():
        (tmp_path / "a b" / name).write_bytes(data)
    want = {len(x): hashlib.sha256(x).hexdigest() for x in content.values()}
    spark.conf.set("fs.viewfs.mounttable.digests.link./in", f"file://{tmp_path}")
    try:
        for large in (None, 1, 0):
            found = tables.file_digests(spark, "viewfs://digests/in/a b", **({} if large is None else {"large": large}))
            assert {r.bytes: r.digest for r in found.collect()} == want
    finally:
        spark.conf.unset("fs.viewfs.mounttable.digests.link./in")
    assert f"length#0L < {1 << 25}" in re.sub(r"length#\d+", "length#0", tables.file_digests(spark, str(tmp_path / "a b"))._jdf.queryExecution().optimizedPlan().toString())


def test_shuffle_files_are_freed(spark):
    """A written table leaves no shuffle files with free; the setting is as it was afterwards."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()  # once: others delete files meanwhile
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    rows, before, setting = spark.range(1000).repartition(4, "id"), shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = written(rows)
    assert shuffles() - before
    before |= shuffles()
    found = written(rows, free=True)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 1000
    assert found.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_check_schema(spark):
    with pytest.raises(TypeError):
        tables.check_schema(spark.range(1), SCHEMA)


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text(
        "2024-01-01T00:00:00︙1︙m︙INFO︙running multiprocessor with pid=1, task=\"old\"\n"
        "2024-01-01T00:00:01︙9︙m︙INFO︙maximum resident-set-size=5, unit=\"MB\"\n"
        "2024-01-02T00:00:00︙1︙m︙INFO︙running multiprocessor with pid=1, task=\"t\"\n"
        "2024-01-02T00:00:01︙7︙m︙INFO︙running task=\"t\", release=\"2024-01-05\", filter=\"f\", worker=7\n"
        "2024-01-02T00:00:02︙7︙m︙INFO︙summarized batch file=\"sor-2024-01-05-full-00003\", latency=1.5, unit=\"min\"\n"
        "2024-01-02T00:00:03︙7︙m︙ERROR︙failed\nTraceback\n  line\n"
        "2024-01-02T00:00:04︙8︙m︙INFO︙maximum resident-set-size=2_147_483_648, unit=\"byte\"\n"
    )
    entries = logs.entries(logs.read_lines(spark, str(tmp_path / "x.log")))
    assert entries.where("prefix = 'failed'").first().trace == "Traceback\n  line"
    got = sorted((r.metric, r.worker, r.release, r.batch, r.value) for r in logs.metrics(entries).collect())
    assert got == [("latency", 1, "2024-01-05", 3, 90.0), ("max-rss", 2, None, None, 2.0)]
    logs.write_metrics(logs.metrics(entries).select("metric", "value"), str(tmp_path / "m"))
    assert sorted(r.value for r in logs.read_metrics(spark, str(tmp_path / "m")).collect()) == [2.0, 90.0]


def test_messages_are_parsed_once(spark, tmp_path):
    """The plan of the metrics holds no parse of messages, which its tables and filters would repeat."""
    (tmp_path / "x.log").write_text("2024-01-02T00:00:00︙1︙m︙INFO︙running multiprocessor with pid=1, task=\"t\"\n2024-01-02T00:00:01︙2︙m︙INFO︙maximum resident-set-size=2, unit=\"GB\", release=\"2024-01-05\"\n")
    found = logs.metrics(logs.entries(logs.read_lines(spark, str(tmp_path / "x.log"))))
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.pid, r.worker, r.release, r.metric, r.value) for r in found.collect()] == [(2, 1, "2024-01-05", "max-rss", 2.0)]


def test_log_of_many_blocks(spark, tmp_path):
    """One log in many blocks uses many tasks; entries and what a process named last go on over their bounds."""
    head = lambda t, pid, text: f"2024-01-02T00:00:{t % 60:02d}︙{pid}︙m︙INFO︙{text}"
    lines, want, release, workers = [head(0, 1, 'maximum resident-set-size=1, unit="GB"'), head(0, 1, 'running multiprocessor with pid=1, task="t"')], [], {}, {1: None}
    for i in range(3000):
        pid = 2 + i % 3
        workers.setdefault(pid, pid - 1)
        if i % 400 == pid:
            release[pid] = f"2024-01-{1 + i // 400:02d}"
            lines.append(head(i, pid, f'running task="t", release="{release[pid]}", filter="f", worker={pid}'))
        elif i % 5 == 0:
            lines.append(head(i, pid, "failed") + "\n\nTraceback\n" + "\n".join(f"  line {k}" for k in range(i % 70)))
        else:
            lines.append(head(i, pid, f'maximum resident-set-size={i}, unit="GB"'))
            want.append((pid, workers[pid], release.get(pid), float(i)))
    (tmp_path / "x.log").write_text("\n".join(lines) + "\n")
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "8k")
    try:
        read = logs.read_lines(spark, str(tmp_path / "x.log"))
        assert read.rdd.getNumPartitions() > 20
        entries = written(logs.entries(read))
        text = "\n".join(lines).split("\n")
        assert {r.line for r in entries.select("line").collect()} == {i + 1 for i, x in enumerate(text) if "︙" in x}
        assert {(len(r.trace.split("\n")) - 1) for r in entries.where("prefix = 'failed'").collect()} == {i % 70 for i in range(0, 3000, 5) if i % 400 != 2 + i % 3}
        got = [(r.pid, r.worker, r.release, r.value) for r in logs.metrics(entries).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset(size)


def test_typed_properties(spark):
    text = 'did it a="True", b="", c=1_000, d=2.50, e="x y", a="false", f=_1'
    row = spark.createDataFrame([(text,), ("nothing",)], "m string").select(logs.typed(F.col("m")).alias("p")).collect()
    got = {k: tuple(v) for k, v in row[0].p.items()}
    assert got == {"a": (None, None, None, False), "b": (None,) * 4, "c": (None, 1000, None, None), "d": (None, None, 2.5, None), "e": ("x y", None, None, None), "f": (None, 1, None, None)}
    assert row[1].p == {}


def test_refresh_fills_holes(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, d), "p") for d in (1, 2, 2, 3)], "day date, platform string")
    data, path = Dataset((Rows(),)), str(tmp_path / "stats")
    assert incremental.refresh(df.where("day <> date'2024-01-02'"), data, path) == [date(2024, 1, 1), date(2024, 1, 3)]
    assert incremental.refresh(df, data, path) == [date(2024, 1, 2)]
    assert incremental.refresh(df, data, path) == []
    assert sorted((r.start_date.day, r["count"]) for r in incremental.combined(spark, path).collect()) == [(1, 1), (2, 2), (3, 1)]
    incremental.reschema(spark, path, str(tmp_path / "again"), lambda s: s.withColumn("tag", F.lit("t")))
    assert {r.tag for r in incremental.combined(spark, str(tmp_path / "again")).collect()} == {"t"}


def test_refresh_with_empty_and_null_days(spark, tmp_path):
    """Days of which the filter leaves nothing are done, too; rows without a day are left out."""
    df = spark.createDataFrame([(date(2024, 1, 1), "p"), (date(2024, 1, 2), "q"), (None, "p")], "day date, platform string")
    data, path, extract = Dataset((Rows(),)), str(tmp_path / "stats"), str(tmp_path / "extract")
    both = [date(2024, 1, 1), date(2024, 1, 2)]
    assert incremental.refresh(df, data, path, filter=F.col("platform") == "p") == both
    assert incremental.refresh(df, data, path, filter=F.col("platform") == "p") == []
    assert [(r.start_date.day, r["count"]) for r in incremental.combined(spark, path).collect()] == [(1, 1)]
    assert incremental.refresh_extract(df, F.col("platform") == "p", extract, "day") == both
    assert incremental.refresh_extract(df, F.col("platform") == "p", extract, "day") == []
    late = df.unionByName(spark.createDataFrame([(date(2023, 12, 31), "p")], df.schema))
    assert incremental.refresh(late, data, path, known_days=late.select("day")) == [date(2023, 12, 31)]
    assert incremental.refresh(df.limit(0), data, str(tmp_path / "none")) == []


def test_summary_of_an_extract(spark, tmp_path):
    schema = "day date, platform string, more string"
    df = spark.createDataFrame([(date(2024, 1, 1), "P1", "x"), (date(2024, 1, 1), "P2", "x"), (date(2024, 1, 2), "P3", "y")], schema)
    aliases = spark.createDataFrame([("P2", "P1")], "alias string, canonical string")
    extract, path, data = str(tmp_path / "e"), str(tmp_path / "s"), Dataset((Rows(),))
    assert incremental.summarize_extract(df, F.col("more") == "x", extract, data, path, "t", aliases) == ([date(2024, 1, 1), date(2024, 1, 2)],) * 2
    assert incremental.summarize_extract(df, F.col("more") == "x", extract, data, path, "t", aliases) == ([], [])
    assert [(r.platform, r.tag, r["count"]) for r in incremental.combined(spark, path).collect()] == [("P1", "t", 2)]
    wider = spark.createDataFrame([], schema + ", later string").schema
    assert {r.later for r in tables.read_extract(spark, extract, wider, "platform", aliases).collect()} == {None}
    with pytest.raises(ValueError, match="P1"):
        tables.read_statistics(spark, path, domain=spark.createDataFrame([("Q",)], "value string"))


def test_batches_and_malformed_rows(spark, tmp_path):
    for day, index, part in (("2024-01-01", 0, 0), ("2024-01-01", 0, 1), ("2024-01-01", 1, 0), ("2024-01-02", 0, 0)):
        write_csv(tmp_path / f"sor-global-{day}-full-{index:05d}-{part:05d}.csv", [BASE | {"uuid": f"{day}/{index}/{part}"}], list(records.FIELDS))
    uuids = lambda *a: sorted(r.uuid for r in records.read_batch(spark, str(tmp_path), *a).collect())
    assert uuids(date(2024, 1, 1), 0) == ["2024-01-01/0/0", "2024-01-01/0/1"] and len(uuids("2024-01-01")) == 3 and uuids("2024-01-02", 0) == ["2024-01-02/0/0"]
    found = records.read_batch(spark, str(tmp_path), "2024-01-02").select(records.day_of_file().alias("d")).first().d
    assert found == date(2024, 1, 2)
    bad = tmp_path / "bad.csv"
    write_csv(bad, [BASE], list(records.FIELDS))
    bad.write_text(bad.read_text() + "only,three,fields\n")
    good, odd = records.ingest(records.read_csv(spark, str(bad)), date(2024, 1, 1))
    assert good.count() == 1 and [r.reasons for r in odd.collect()] == [["malformed row"]]


def test_copy_refuses_other_rows(spark, tmp_path):
    stats = profile(spark.createDataFrame([(date(2024, 1, 1), "p")], "day date, platform string"), Dataset((Rows(),)))
    path = str(tmp_path / "copy")
    assert tables.copy_statistics(stats, path) and not tables.copy_statistics(stats, path)
    with pytest.raises(ValueError):
        tables.copy_statistics(stats.withColumn("count", F.lit(7).cast("long")), path)


def test_digests_and_manifest(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"x")
    assert tables.file_digests(spark, str(tmp_path / "f")).first().digest == hashlib.sha256(b"x").hexdigest()
    with open(tmp_path / "f" / "large.bin", "wb") as f:  # more than one value can hold; a hole on the disk
        f.seek((1 << 31) + 5)
        f.write(b"end")
    want = hashlib.sha256()
    for _ in range(1 << 7):
        want.update(bytes(1 << 24))
    want.update(bytes(5) + b"end")
    found = {r.bytes: r.digest for r in tables.file_digests(spark, str(tmp_path / "f")).collect()}
    assert found == {1: hashlib.sha256(b"x").hexdigest(), (1 << 31) + 8: want.hexdigest()}
    (tmp_path / "f" / "large.bin").unlink()
    (tmp_path / "m.json").write_text(json.dumps({"releases": {"2024-01-02": {"batch_count": 3, "total_rows": 9}}}))
    row = tables.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.release, row.batch_count, row.total_rows, row.sha256) == (date(2024, 1, 2), 3, 9, None)


def test_refresh_shows_at_once(spark, tmp_path, monkeypatch):
    """A run that stops after its write leaves readers with what was there; the next one goes on."""
    df = spark.createDataFrame([(date(2024, 1, d), "p") for d in (1, 2, 3)], "day date, platform string")
    data, path = Dataset((Rows(),)), str(tmp_path / "stats")
    days = lambda: sorted(r.start_date.day for r in incremental.combined(spark, path).collect())
    incremental.refresh(df.where("day = date'2024-01-01'"), data, path)

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(commits, "commit", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        incremental.refresh(df, data, path)
    monkeypatch.undo()
    assert days() == [1] and len(commits.tidy(spark, path)) == 1 and days() == [1]
    assert [d.day for d in incremental.refresh(df, data, path)] == [2, 3] and days() == [1, 2, 3]
    old = commits.state(spark, path)
    tables.write_statistics(incremental.combined(spark, path).where("start_date = date'2024-01-02'").withColumn("count", F.lit(9).cast("long")), path)
    assert sorted((r.start_date.day, r["count"]) for r in incremental.combined(spark, path).collect()) == [(1, 1), (2, 9), (3, 1)]
    with pytest.raises(Exception, match="exist"):  # a writer that began from an older state
        commits.commit(spark, path, old)


def test_large_day_is_dealt(spark, tmp_path):
    """A day of a hundred times the others' rows is written by many tasks, the others by few."""
    df = spark.range(0, 104_000, 1, 30).select(F.when(F.col("id") < 100_000, F.lit("2024-01-05")).otherwise(F.concat(F.lit("2024-01-0"), (F.col("id") % 4 + 1).cast("string"))).cast("date").alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("platform"))
    path, size = str(tmp_path / "e"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        assert tables.write_extract(df, path, "day") == [f"2024-01-0{i}" for i in range(1, 6)]
    finally:
        spark.conf.unset(size)
    stored = tables.read_extract(spark, path, df.schema)
    files = {r.day.day: r.n for r in stored.groupBy("day").agg(F.count_distinct("_metadata.file_path").alias("n")).collect()}
    assert files[5] >= 10 and all(files[i] == 1 for i in range(1, 5)) and stored.count() == 104_000


def test_second_refresh_reads_nothing(spark, tmp_path):
    spark.createDataFrame([(date(2024, 1, d), "p") for d in (1, 2)], "day date, platform string").coalesce(1).write.parquet(str(tmp_path / "in"))
    data, path = Dataset((Rows(),)), str(tmp_path / "stats")
    read = lambda: spark.read.schema("day date, platform string").parquet(str(tmp_path / "in"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("refresh"))
    assert len(incremental.refresh(read(), data, path)) == 2
    spark.sparkContext.setJobGroup("refresh", "")
    try:
        assert incremental.refresh(read(), data, path) == [] and jobs() == 0
        assert incremental.refresh(read().where("platform = 'p'"), data, path) == [] and jobs() > 0  # another plan
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.createDataFrame([(date(2024, 1, 3), "p")], "day date, platform string").write.mode("append").parquet(str(tmp_path / "in"))
    assert incremental.refresh(read(), data, path) == [date(2024, 1, 3)]


def test_compacted_stream(spark, tmp_path):
    """Compacted and plain statistics are equal; a batch that comes again after the compaction counts once."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data, schema = Dataset((Rows(), ListStats("words"))), "day date, platform string, words array<string>"
    rows = lambda k: spark.createDataFrame([(date(2024, 1, 1 + i % 3), "p", ["a"] * (i % k)) for i in range(10)], schema).coalesce(1)
    run = lambda: daily.stream_statistics(daily.file_stream(spark, source, rows(2).schema, 1), data, out, str(tmp_path / "check")).awaitTermination()
    rows(2).write.mode("append").parquet(source)
    run()
    rows(3).write.mode("append").parquet(source)
    run()
    told = lambda: sorted(map(str, daily.streamed(spark, out).collect()))
    plain, before = told(), commits.state(spark, out)
    assert plain == sorted(map(str, finalize(profile(spark.read.schema(schema).parquet(source), data)).collect())) and len(before.batches) == 2
    assert daily.compact(spark, out) == ["2024-01-01", "2024-01-02", "2024-01-03"] and daily.compact(spark, out) == []
    assert told() == plain and len(commits.tidy(spark, out)) == 2 and told() == plain
    # The last batch comes again, as after a failure before the stream's own commit.
    last = max(f for f in os.listdir(tmp_path / "check" / "commits") if not f.startswith("."))
    os.remove(tmp_path / "check" / "commits" / last)
    (tmp_path / "check" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run()
    assert told() == plain
    rows(4).write.mode("append").parquet(source)
    run()
    assert len(commits.state(spark, out).batches) == 1 and told() != plain


def test_sightings(spark, tmp_path):
    """A refresh of one day reads one day; what was seen equals the full count, late days and replaced ones included."""
    df = spark.createDataFrame([(date(2024, 1, d), p, t) for d, p, t in ((1, "a", "x"), (2, "b", None), (2, "a", "y"), (3, "c", "x"))], "day date, platform string, t string")
    data, path, seen = Dataset((Rows(), TextCounts("t"))), str(tmp_path / "stats"), str(tmp_path / "seen")
    told = lambda: {(k, v): d.day for k, v, d in map(tuple, sightings.read_sightings(spark, seen).collect())}
    for days, add in (("2", ["2024-01-02"]), ("2, 3", ["2024-01-03"]), ("1, 2, 3", ["2024-01-01"]), ("1", [])):
        incremental.refresh(df.where(f"dayofmonth(day) in ({days})"), data, path)
        assert sightings.refresh_sightings(spark, path, seen) == add
    want = {("platform", "a"): 1, ("platform", "b"): 2, ("platform", "c"): 3, ("text.t", "x"): 1, ("text.t", "y"): 2}
    assert told() == want
    sightings.compact_sightings(spark, seen)
    assert told() == want and len(commits.state(spark, seen).batches) == 1
    tables.write_statistics(profile(df.where("day = date'2024-01-01'").withColumn("platform", F.lit("new")), data), path)
    assert sightings.refresh_sightings(spark, path, seen) == ["2024-01-01"] and told() == want | {("platform", "new"): 1}
    assert {r.kind: r.n for r in sightings.approximate_counts(sightings.sketches(df, "day", {"p": "platform", "t": "t"})).collect()} == {"p": 3, "t": 2}
