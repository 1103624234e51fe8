"""Scrapes in several batches, replaced scrapes, and addresses that come and go."""

import datetime as dt
import json
import os

from agendaflow.streaming import pages as stream

DAY = "2024-05-01T10:00:00"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def page(url, fetched=DAY, html="x"):
    return {"url": url, "html": html, "fetched": fetched}


def urls(spark, path, key="day"):
    return sorted(r.url for r in stream.current_pages(spark, str(path), key).collect())


def run(spark, src, path, check, **options):
    pages = stream.page_stream(spark, str(src), files_a_batch=1)
    assert stream.replace_pages(pages, str(path), str(check), **options).awaitTermination(120)


def test_batches_of_one_scrape_add_up(spark, tmp_path):
    for k in range(3):
        put(tmp_path / "a", k, [page(f"p{k}")])
    put(tmp_path / "a", 3, [page("other", "2024-05-02T10:00:00")])
    out = tmp_path / "out"
    run(spark, tmp_path / "a", out, tmp_path / "ck", scrape="2024-05-01")
    assert urls(spark, out) == ["other", "p0", "p1", "p2"]
    run(spark, tmp_path / "a", out, tmp_path / "ck", scrape="2024-05-01")  # nothing new
    assert urls(spark, out) == ["other", "p0", "p1", "p2"]
    assert spark.read.parquet(str(out)).count() == 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [spark.createDataFrame([(f"p{k}", "x", dt.datetime(2024, 5, 1))], stream.SCHEMA) for k in range(3)]
    for k in (0, 1, 1, 2, 0):
        stream.write_batch(rows[k], k, out, scrape="1", source="ck")
    assert urls(spark, out) == ["p0", "p1", "p2"]


def test_a_later_scrape_replaces_only_its_keys(spark, tmp_path):
    out = tmp_path / "out"
    put(tmp_path / "a", 0, [page("p0"), page("p1")])
    put(tmp_path / "a", 1, [page("q", "2024-05-02T10:00:00")])
    put(tmp_path / "b", 0, [page("p1", html="new")])
    put(tmp_path / "b", 1, [page("p5")])
    run(spark, tmp_path / "a", out, tmp_path / "ck1", scrape="1")
    run(spark, tmp_path / "b", out, tmp_path / "ck2", scrape="2")
    assert urls(spark, out) == ["p1", "p5", "q"]
    assert {r.html for r in stream.current_pages(spark, str(out)).where("url = 'p1'").collect()} == {"new"}
    # what comes late of the first scrape is stored, and not current
    stream.write_batch(spark.createDataFrame([("late", "x", dt.datetime(2024, 5, 1))], stream.SCHEMA), 7, str(out), scrape="1", source="ck1")
    assert urls(spark, out) == ["p1", "p5", "q"]
    assert stream.drop_replaced(spark, str(out)) == 1 and stream.drop_replaced(spark, str(out)) == 0
    assert sorted(r.url for r in spark.read.parquet(str(out)).collect()) == ["p1", "p5", "q"] == urls(spark, out)


def test_keys_of_a_column_and_null_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame([(u, "x", None, v) for u, v in x], stream.SCHEMA + ", venue string")
    stream.write_batch(rows(("a", "Bar / Nord"), ("b", None)), 0, out, "venue", "1")
    stream.write_batch(rows(("c", None)), 1, out, "venue", "1")
    stream.write_batch(rows(("d", "Bar / Nord")), 0, out, "venue", "2")
    assert urls(spark, out, "venue") == ["b", "c", "d"]
    assert stream.drop_replaced(spark, out, "venue") == 1 and urls(spark, out, "venue") == ["b", "c", "d"]


def test_links_that_come_and_go(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        link = lambda u, day, stored=False, venue="v": {"venue": venue, "url": u, "listed": f"2024-05-{day:02d}T00:00:00", "stored": stored}
        put(tmp_path / "a", "0", [link("x", 1), link("x", 1), link("y", 1), link("s", 1, True), link("x", 1, venue="w")])
        put(tmp_path / "a", "1", [link("x", 5), link("z", 5)])
        put(tmp_path / "a", "2", [link("x", 9)])
        put(tmp_path / "a", "3", [link("y", 20)])
        put(tmp_path / "a", "4", [link("x", 21)])
        for k in range(5):  # files come in the order of their times
            os.utime(tmp_path / "a" / f"{k}.json", (1000 + k, 1000 + k))
        src = spark.readStream.schema("venue string, url string, listed timestamp, stored boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "a"))
        got = stream.link_changes(src, "7 days").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert got.awaitTermination(180)
        rows = [(r.venue, r.url, r.change, r.at.day) for r in spark.table("changes").collect()]
    finally:
        spark.conf.unset(key)
    assert sorted(rows) == sorted([
        ("v", "x", "new", 1), ("v", "y", "new", 1), ("w", "x", "new", 1), ("v", "z", "new", 5),
        ("v", "y", "gone", 8), ("v", "s", "gone", 8), ("w", "x", "gone", 8), ("v", "z", "gone", 12), ("v", "x", "gone", 16),
        ("v", "y", "new", 20), ("v", "x", "new", 21),
    ])
