"""A stream gives what the batch form gives, also when it comes in parts."""

from pyspark.sql import functions as F

from siftwell.operators import crawl
from siftwell.streaming import frontier


def test_frontier_over_two_runs(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    white = spark.createDataFrame([("http://a.b/",)], "domain string")
    stream = lambda: frontier.frontier(spark.readStream.schema("value string").text(inbox), white, 4)
    for urls in (["http://a.b/1", "http://a.b/2", "http://c.d/1"], ["http://a.b/2", "http://A.b/3"]):
        spark.createDataFrame([(u,) for u in urls], "u string").select(F.url_encode("u").alias("value")).write.mode("append").text(inbox)
        frontier.run_once(stream(), out, state)
    rows = spark.read.parquet(out)
    assert sorted((r.domain, r.path) for r in rows.collect()) == [("http://a.b/", "/1"), ("http://a.b/", "/2"), ("http://a.b/", "/3")]
    assert rows.select("shard").distinct().count() == 1


def test_replay_and_progress(spark):
    state = spark.createDataFrame([("d", "/1", True), ("d", "/2", False)], "domain string, path string, done boolean")
    assert [(r.domain, r.path) for r in frontier.replay(state).collect()] == [("d", "/2")]
    assert tuple(crawl.progress(state).first()) == ("d", 1, 1)


def test_done_state_goes_on_after_a_stop(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "domain string, path string, done boolean"
    assert frontier.read_done_state(spark, out).count() == 0
    for rows in ([("d", "/1", False), ("d", "/2", True)], [("d", "/1", True), ("d", "/2", False), ("d", "/3", False)], [("e", "/1", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        frontier.keep_done_state(spark.readStream.schema(schema).parquet(inbox), out, state)
    rows = frontier.read_done_state(spark, out)
    assert sorted(map(tuple, rows.collect())) == [("d", "/1", True), ("d", "/2", True), ("d", "/3", False), ("e", "/1", False)]
    assert sorted(map(tuple, frontier.replay(rows).collect())) == [("d", "/3"), ("e", "/1")]
    assert len(frontier.versions(spark, out)) == 2  # the newest and the one before it
    (tmp_path / "out" / f"v={frontier.last_version(spark, out)}" / "_SUCCESS").unlink()
    assert frontier.read_done_state(spark, out).count() == 3  # a version that is cut short doesn't count


def test_queues_take_turns_over_two_runs(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "domain string, path string, seq long"
    for rows in ([("a", "/2", 2), ("a", "/1", 1), ("b", "/1", 3)], [("a", "/1", 4), ("a", "/3", 5), ("b", "/2", 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        frontier.run_once(frontier.queues(spark.readStream.schema(schema).parquet(inbox)), out, state)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a", "/1"), (1, "b", "/1"), (2, "a", "/2"), (2, "b", "/2"), (3, "a", "/3")]


def test_crawl_delay_over_two_runs(spark, tmp_path):
    """Against a walk over the requests."""
    schema = "request_id long, domain string, at_ms long"
    runs = [[(1, "a", 0), (2, "a", 5), (3, "b", 100), (4, "a", 400)], [(5, "a", 10), (6, "a", 900), (7, "b", 100)]]
    want, last = set(), {}
    for rows in runs:
        for i, d, at in sorted(rows, key=lambda r: (r[2], r[0])):
            last[d] = at if d not in last else max(at, last[d] + 50)
            want.add((i, d, at, last[d]))
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        frontier.run_once(frontier.crawl_delay(spark.readStream.schema(schema).parquet(inbox), 50), out, state)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want
