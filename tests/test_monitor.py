from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cropline import schemas
from cropline.operators import monitor as R
from cropline.sources.files import append_predictions, read_log
from cropline.streaming import monitor as T

LOG = "id long, username string, status string, latency_ms double, total_value double, timestamp timestamp"
START = datetime(2024, 1, 1)


def log(frame, statuses):
    return frame(LOG, [(i, "ada", s, float(i), 1.5, START) for i, s in enumerate(statuses)])


STATUSES = ["ERROR", "ERROR: x: y", "SUCCESS"]


@pytest.mark.parametrize("prefix, rate", [(False, 33.33), (True, 66.67)])
def test_error_rate(frame, prefix, rate):
    row = R.monitor_summary(log(frame, STATUSES), prefix).first()
    assert (row.total_predictions, row.avg_latency_ms, row.error_rate_pct) == (3, 2.0, rate)


def test_empty_log(frame):
    assert tuple(R.monitor_summary(log(frame, [])).first()) == (0, 0.0, 0.0)


def test_labels(frame):
    rows = [(r.status_label, r.row_class) for r in R.log_classes(log(frame, STATUSES)).collect()]
    assert rows == [("ERROR", "error"), ("ERROR", "error"), ("SUCCESS", "success")]
    auth = frame("action string, ip_address string", [("LOGIN_FAILURE", None), ("LOGOUT", "1.2.3.4"), ("LOGOUT", "")])
    assert [(r.row_class, r.address) for r in R.log_classes(auth).collect()] == [("error", "local"), ("success", "1.2.3.4"), ("success", "local")]


def test_latencies_oldest_first(frame):
    rows = R.latency_history(log(frame, ["SUCCESS"] * 30 + ["ERROR"]), 20).collect()
    assert [r.id for r in rows] == list(range(10, 30))


def test_recent(frame):
    assert [r.id for r in R.recent(log(frame, ["SUCCESS"] * 5), 2).collect()] == [4, 3]


def test_report_sections(frame):
    auth = frame("id long, username string, action string, ip_address string", [(1, "ada", "LOGOUT", None)])
    sections = {r.section for r in R.monitoring(log(frame, STATUSES), auth).collect()}
    assert sections == {"summary", "latency_history", "recent_predictions", "recent_auth_events"}


@pytest.fixture(scope="module")
def log_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("logs") / "log")
    rows = [
        (i, "ada", START + timedelta(hours=i), "Rice", "S", "D", "Rabi", 1.0, 1.0, 1.0, 1.0, 1.0, i / 4, "SUCCESS" if i % 5 else "ERROR")
        for i in range(100)
    ]
    for part in range(4):
        batch = spark.createDataFrame(rows[part * 25 : part * 25 + 25], schemas.PREDICTION_LOG)
        batch.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch_for_closed_windows(spark, log_folder, tmp_path):
    stream = T.monitor_stream(T.read_log_stream(spark, log_folder))
    out, state = str(tmp_path / "windows"), str(tmp_path / "checkpoint")
    T.write_windows(stream, out, state).awaitTermination()
    batch = T.monitor_windows(spark.read.parquet(log_folder))
    closed = batch.filter(F.col("window_end") <= START + timedelta(hours=98))
    assert sorted(spark.read.parquet(out).collect()) == sorted(closed.collect())
    # A restart finds nothing new and emits nothing twice.
    T.write_windows(T.monitor_stream(T.read_log_stream(spark, log_folder)), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == closed.count() == 4


def test_streamed_log_appends(spark, log_folder, tmp_path):
    out, state = str(tmp_path / "copy"), str(tmp_path / "checkpoint")
    stream = T.read_log_stream(spark, log_folder)
    T.append_prediction_stream(stream, out, state).awaitTermination()
    assert read_log(spark, out).count() == 100
    events = stream.select("id", "username", F.lit("LOGOUT").alias("action"), "timestamp")
    T.append_auth_stream(events, str(tmp_path / "auth"), str(tmp_path / "auth_state")).awaitTermination()
    auth = read_log(spark, str(tmp_path / "auth"), schemas.AUTH_EVENTS)
    assert auth.filter("ip_address IS NULL").count() == 100


def test_batch_and_stream_share_a_log(spark, log_folder, tmp_path):
    out = str(tmp_path / "log")
    stream = T.read_log_stream(spark, log_folder)
    T.append_prediction_stream(stream.filter("id = 1"), out, str(tmp_path / "a")).awaitTermination()
    append_predictions(spark.read.parquet(log_folder).filter("id = 2"), out)
    T.append_prediction_stream(stream.filter("id = 3"), out, str(tmp_path / "b")).awaitTermination()
    append_predictions(spark.read.parquet(log_folder).filter("id = 30"), out)
    log = read_log(spark, out)
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 30]
    assert [r.id for r in log.filter("date = '2024-01-02'").collect()] == [30]
    # The log is a stream's input as well.
    copy = T.append_prediction_stream(T.read_log_stream(spark, out), str(tmp_path / "copy"), str(tmp_path / "c"))
    copy.awaitTermination()
    assert read_log(spark, str(tmp_path / "copy")).count() == 4


def test_the_report_scans_each_log_once(spark, frame, tmp_path):
    log = frame("id long, username string, status string, latency_ms double, total_value double",
                [(i, f"u{i}", "SUCCESS" if i % 3 else "ERROR", float(i), None if i == 49 else i * 1.5) for i in range(50)] + [(50, None, None, None, 1.0)])
    auth = frame("id long, username string, action string, ip_address string", [(i, "a", "LOGOUT", None) for i in range(4)])
    for name, df in (("log", log), ("auth", auth)):
        df.write.parquet(str(tmp_path / name))
    stored = [spark.read.parquet(str(tmp_path / name)) for name in ("log", "auth")]
    report = R.monitoring(*stored, latencies=5, rows=3)
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
    rows = [tuple(r) for r in report.collect()]
    assert [r[1] for r in rows if r[0] == "latency_history"] in ([49, 47, 46, 44, 43], [43, 44, 46, 47, 49])
    assert {r[1] for r in rows if r[0] == "recent_predictions"} == {50, 49, 48}
    assert ("recent_predictions", 50, "username", None) in rows and ("summary", 0, "total_predictions", "51") in rows
    assert len([r for r in rows if r[0] == "recent_auth_events"]) == 9
    empty = [tuple(r) for r in R.monitoring(stored[0].limit(0), stored[1].limit(0)).collect()]
    assert [r[3] for r in empty] == ["0", "0.00", "0.00"]


def test_a_kept_report_equals_the_batch_one_after_a_restart(spark, frame, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("log", "state", "checkpoint"))
    schema = "id long, username string, status string, latency_ms double, total_value double"

    def rows(first, last):
        return frame(schema, [(i, f"u{i % 7}", ["SUCCESS", "ERROR", None][i % 3 if i % 5 else 0], i / 7, i * 1.25) for i in range(first, last)])

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        T.keep_report(stream, state, checkpoint, latencies=6, rows=4).awaitTermination()

    auth = frame("id long, username string, action string, ip_address string", [])

    def same():
        want = R.monitoring(spark.read.schema(schema).parquet(source), auth, latencies=6, rows=4)
        return sorted(map(str, T.kept_report(spark, state).collect())) == sorted(map(str, want.collect()))

    for first in range(0, 60, 20):
        rows(first, first + 20).coalesce(1).write.mode("append").parquet(source)
    run()
    assert same() and len(T._batches(spark, state)) == 2
    # Old ids and new ones arrive; the stream goes on where it was.
    rows(-30, -10).coalesce(1).write.mode("append").parquet(source)
    rows(60, 75).coalesce(1).write.mode("append").parquet(source)
    run()
    assert same()
    # The last batch is run again, as after a failure behind its write: it counts once.
    last = max(int(f.name) for f in (tmp_path / "checkpoint" / "commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    run()
    assert same() and T._batches(spark, state)[-1] == last
