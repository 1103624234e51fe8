"""One JSON document of any size: written in order by many tasks, read in many chunks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from agendaflow.sources import geojson, json_files, registries

ODD = ["", '"', "\\", '\\"', "a,b", "{", "}]", '","', "\\\\", "é漢😀", "\n\t", '{"k": "v"}', "\\" * 9, '"' * 5, "x" * 300]


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 4:
        return rng.choice(ODD) + rng.choice(ODD)
    if kind == 4:
        return rng.choice([None, True, 1.5, -3, 0])
    return {f"{rng.choice(ODD)}{k}": value(rng, depth + 1) for k in range(rng.randint(0, 3))} if kind == 5 else [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("chunk, indent, ascii_", [(5, None, False), (37, 2, True), (400, None, True), (1 << 20, 2, False)])
def test_maps_in_chunks(spark, tmp_path, chunk, indent, ascii_):
    rng = random.Random(chunk)
    held = {f"{rng.choice(ODD)}-{k}": value(rng) for k in range(12 if chunk < 10 else 60)}
    (tmp_path / "m.json").write_text(json.dumps(held, indent=indent, ensure_ascii=ascii_))
    got = {r.key: r.value for r in json_files.read_large_map(spark, str(tmp_path / "m.json"), chunk).collect()}
    assert set(got) == set(held)
    for k, v in held.items():
        assert got[k] == v if isinstance(v, str) or v is None else json.loads(got[k]) == v


def test_arrays_folders_and_empty_documents(spark, tmp_path):
    rows = [{"id": k, "name": ODD[k % len(ODD)], "tags": ["a", "]"]} for k in range(90)]
    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows[30 * n : 30 * n + 30], indent=n or None))
    (tmp_path / "3.json").write_text("[]")
    (tmp_path / "4.json").write_text(" { } ")
    (tmp_path / "5.json").write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = json_files.read_large_array(spark, path, "id int, name string, tags array<string>", 100).collect()
        assert sorted((r.id, r.name, r.tags) for r in got) == [(r["id"], r["name"], r["tags"]) for r in rows]
    assert json_files.read_large_map(spark, str(tmp_path / "4.json")).count() == 0 == json_files.read_large_map(spark, str(tmp_path / "5.json")).count()
    with pytest.raises(FileNotFoundError):
        json_files.top_level_texts(spark, str(tmp_path / "none.json"))


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({f"http://x/{k}": "<p>" * 50 for k in range(2000)}))
    texts = json_files.top_level_texts(spark, str(tmp_path / "m.json"), 20_000)
    tasks = texts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).count()
    assert tasks > 4 and texts.count() == 2000


def test_documents_in_order(spark, tmp_path):
    rows = spark.range(1000).repartition(7).select("id", (F.col("id") % 3).cast("string").alias("city"), F.to_json(F.struct("id")).alias("value"))
    json_files.write_document(rows, str(tmp_path / "a"), "id")
    assert [r["id"] for r in json.loads((tmp_path / "a" / "document.json").read_text())] == list(range(1000))
    odd = rows.withColumn("city", F.when(F.col("city") == "1", F.lit("a/b=ü")).when(F.col("city") == "2", None).otherwise(F.col("city")))
    json_files.write_document(odd, str(tmp_path / "b"), F.desc("id"), by=("city",))
    got = {p.parent.name: [r["id"] for r in json.loads(p.read_text())] for p in (tmp_path / "b").glob("*/document.json")}
    assert got == {"city=0": list(range(999, -1, -3)), "city=a%2Fb%3Dü": list(range(997, 0, -3)), "city=__HIVE_DEFAULT_PARTITION__": list(range(998, 1, -3))}
    assert {r.city for r in spark.read.option("multiLine", True).json(str(tmp_path / "b")).select("city").collect()} == {"0", "a/b=ü", None}
    assert not list(tmp_path.glob("*/_parts*"))
    json_files.write_document(rows.limit(0), str(tmp_path / "a"), "id")
    assert json.loads((tmp_path / "a" / "document.json").read_text()) == []
    with pytest.raises(Exception, match="document.json"):
        json_files.write_document(rows, str(tmp_path / "a"), "id", overwrite=False)
    assert json.loads((tmp_path / "a" / "document.json").read_text()) == []


def test_a_failed_write_leaves_the_old_document(spark, tmp_path):
    rows = spark.range(100).select("id", F.to_json(F.struct("id")).alias("value"))
    json_files.write_document(rows, str(tmp_path / "a"), "id")
    before = (tmp_path / "a" / "document.json").read_text()
    bad = rows.withColumn("value", F.when(F.col("id") == 99, F.raise_error(F.lit("no value"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no value"):
        json_files.write_document(bad, str(tmp_path / "a"), "id")
    assert (tmp_path / "a" / "document.json").read_text() == before and not list((tmp_path / "a").glob("_parts*"))


def test_collections_and_events(spark, tmp_path):
    places = spark.createDataFrame([(f"Bar {k:03d}", 4.8, 45.0 + k, "music", None, "Lyon" if k % 2 else "Paris", "France") for k in range(200)], "title string, longitude double, latitude double, icon string, url string, city string, country string")
    geojson.write_world_file(places, str(tmp_path / "w"))
    world = json.loads((tmp_path / "w" / "document.json").read_text())
    assert world["type"] == "FeatureCollection" and [f["id"] for f in world["features"]] == [f"Bar {k:03d}" for k in range(200)]
    template = json.dumps({"type": "FeatureCollection", "name": "mine", "features": [{"id": "first"}]})
    geojson.write_collections(geojson.place_features(places), str(tmp_path / "t"), "city", head=geojson.merge_template(template) + ",")
    one = json.loads((tmp_path / "t" / "city=Lyon" / "document.json").read_text())
    assert one["name"] == "mine" and [f["id"] for f in one["features"]][:2] == ["first", "Bar 001"] and len(one["features"]) == 101
    events = spark.createDataFrame([(k, f"e{k}", "no date" if k % 5 == 0 else None) for k in range(50)], "seq long, eventName string, errorLog string")
    registries.write_events(events, str(tmp_path / "e"))
    assert [e["seq"] for e in json.loads((tmp_path / "e" / "all" / "document.json").read_text())] == list(range(50))
    assert [e["seq"] for e in json.loads((tmp_path / "e" / "errors" / "document.json").read_text())] == list(range(0, 50, 5))
    back = json_files.read_large_array(spark, str(tmp_path / "e" / "all"), "seq long, eventName string", 500)
    assert sorted(map(tuple, back.collect())) == [(k, f"e{k}") for k in range(50)]
