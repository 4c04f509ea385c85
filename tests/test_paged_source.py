"""The data source of landed pages: batches and streams."""

import json

from quarry.sources import landing, paged

SCHEMA = "page long, id string, score double, tags array<string>, who struct<name:string,n:int>"
ITEM = "struct<id:string,score:double,tags:array<string>,who:struct<name:string,n:int>>"


def land(folder, number, items):
    folder.mkdir(exist_ok=True)
    (folder / f"page_{number}.json").write_text(json.dumps(items))


def item(i):
    return {"id": f"i{i}", "score": i if i % 2 else i / 4, "tags": ["a", str(i)] if i % 3 else None, "who": {"name": "n", "n": i}, "more": [1]}


def test_pages_are_those_of_the_text_reader(spark, tmp_path):
    folder = tmp_path / "in"
    for number in range(1, 8):
        land(folder, number, [item(number * 10 + k) for k in range(4 if number != 5 else 2)])
    (folder / "other.json").write_text("[]")
    got = paged.read_pages(spark, str(folder), SCHEMA, 4, 2)
    want = landing.read_pages(spark, str(folder), ITEM, 4)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() == 18
    assert got.select("page").distinct().count() == 5 and got.rdd.getNumPartitions() == 4


def test_an_empty_page_ends_the_list(spark, tmp_path):
    for number, n in ((1, 2), (2, 0), (3, 2)):
        land(tmp_path / "in", number, [item(number * 10 + k) for k in range(n)])
    assert sorted(r["id"] for r in paged.read_pages(spark, str(tmp_path / "in"), SCHEMA, 2).collect()) == ["i10", "i11"]
    assert paged.read_pages(spark, str(tmp_path / "none"), SCHEMA, 2).collect() == []


def test_values_that_do_not_fit_are_null(spark, tmp_path):
    land(tmp_path / "in", 1, [{"id": 5, "score": "x", "tags": "no", "who": []}, "odd", {"id": None, "score": True}, {"id": {"a": 1}, "score": 2, "who": {"name": "z"}}])
    got = sorted((tuple(r) for r in paged.read_pages(spark, str(tmp_path / "in"), SCHEMA).collect()), key=str)
    assert got == sorted([(1, "5", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (1, '{"a": 1}', 2.0, None, ("z", None))], key=str)


def test_a_stream_goes_on_at_its_offset(spark, tmp_path):
    spark.dataSource.register(paged.LandedPages)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "page long, id string"

    def run():
        stream = spark.readStream.format("landed_pages").schema(schema).option("path", str(folder)).option("pages_per_task", 2).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["page"] for r in spark.read.schema(schema).parquet(out).collect())

    for number in (3, 4, 6):
        land(folder, number, [item(number)])
    assert run() == [3, 4]
    land(folder, 5, [item(5)])
    assert run() == [3, 4, 5, 6]
    assert run() == [3, 4, 5, 6]
