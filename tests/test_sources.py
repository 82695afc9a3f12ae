"""Files, log lines, status texts and page tables."""

import pytest
from pyspark.sql import functions as F

from kinetable.operators.clean import prepare_recordings
from kinetable.sources import files, messages as msg, pages


@pytest.mark.parametrize("layout,axes", [("LRC", 9), ("LR", 6), ("L", 3)])
def test_sample_layouts(spark, scratch, layout, axes):
    with open(f"{scratch}/3.csv", "w") as out:
        for i in range(4):
            out.write(",".join([str(i), *[str(i + a / 10) for a in range(axes)], "2"]) + "\n")
    row = files.read_samples(spark, f"{scratch}/3.csv", layout).orderBy("index").collect()[3]
    assert row["index"] == 3 and row["label"] == 2 and row["session_id"] == "3"
    assert row[f"z{layout[-1]}"] == pytest.approx(3 + (axes - 1) / 10)


def test_many_files_and_missing_values(spark, scratch):
    for person in (1, 2):
        with open(f"{scratch}/{person}.csv", "w") as out:
            out.write("0,1,2,3,1\n1,1,,3,1\n2,1,2,3,0\n3,4,5,6,1\n")
    df = files.read_samples(spark, scratch, "L")
    assert df.count() == 8
    kept = prepare_recordings(df).orderBy("session_id", "seq").collect()
    assert [(r["session_id"], r["seq"], r["pos"]) for r in kept] == [("1", 0, 0), ("1", 3, 1), ("2", 0, 0), ("2", 3, 1)]
    with pytest.raises(ValueError):
        files.read_samples(spark, scratch, "XY")


def test_phone_file(spark, scratch):
    with open(f"{scratch}/p.csv", "w") as out:
        out.write("7,1424,1425,0.5,-1,9.8,a,nexus4,nexus4_1,stand\n")
    row = files.read_phone_samples(spark, scratch).first()
    assert row.asDict() == {"session_id": "p", "index": 7, "x": 0.5, "y": -1.0, "z": 9.8, "label": "stand"}


def test_aligned_samples_are_written_by_activity_and_person(spark, scratch):
    names = ["seq"] + [f"{a}{s}" for s in "LRC" for a in "xyz"] + ["label", "person"]
    df = spark.createDataFrame([(1, *[0.25] * 9, 3, "ann"), (2, *[0.5] * 9, 4, "bob, jr")], names)
    files.write_samples(df, f"{scratch}/out")
    lines = [r["value"] for r in spark.read.text(f"{scratch}/out/label=3/person=ann").collect()]
    assert lines == ["1," + ",".join(["0.25"] * 9) + ",3"]
    back = spark.read.schema(files.sample_schema("LRC")).csv(f"{scratch}/out/*/*")
    assert sorted((r["index"], r["label"]) for r in back.collect()) == [(1, 3), (2, 4)]


def test_captured_adverts(spark, scratch):
    rows = spark.createDataFrame([(1, "aa", None, 1, 40, 0, bytearray(b"\x02\x01\x06"))], files.ADVERT_SCHEMA)
    rows.write.parquet(f"{scratch}/adv")
    assert files.read_adverts(spark, f"{scratch}/adv").first()["addr"] == "aa"


def test_response_lines(spark, scratch):
    with open(f"{scratch}/log.txt", "w") as out:
        out.write("# comment\n\nrsp=$scan\x1eaddr=b2471890000ab\x1etype=h1\x1erssi=h2D\x1eflag=h4\x1ed=b020106\n")
        out.write("rsp=$find\x1ehstart=h1\x1euuid='180f\x1ehstart=hFF\x1euuid='2a19\x1eempty=\n")
        out.write("rsp=$x\x1ebad=?1\n")
    parsed = msg.read_responses(spark, f"{scratch}/log.txt")
    assert parsed.count() == 3
    find = parsed.where(msg.text_value("rsp") == "find").select(
        "fields", msg.number_value("hstart").alias("h"), msg.text_value("uuid").alias("u"), msg.text_value("empty").alias("e")
    ).first()
    assert find["fields"]["hstart"] == ["h1", "hFF"] and find["fields"]["uuid"] == ["'180f", "'2a19"]
    assert (find["h"], find["u"], find["e"]) == (1, "180f", None)
    bad = parsed.where(F.size(msg.unreadable_tags()) > 0).select(msg.unreadable_tags().alias("t")).collect()
    assert [r["t"] for r in bad] == [["bad"]]
    advert = msg.adverts_of_log(parsed).first()
    assert advert["addr"] == "24:71:89:00:00:ab" and advert["rssi"] == 45 and bytes(advert["data"]) == b"\x02\x01\x06"


def test_status_and_control_texts(spark):
    rows = spark.createDataFrame(
        [("clientLeft", "on"), ("clientChest", "off"), ("frontend", "start"), ("frontend", "hello"), ("Left", "[]")], "topic string, payload string"
    )
    assert sorted((r["sensor"], r["status"]) for r in msg.read_status(rows).collect()) == [("Chest", "off"), ("Left", "on")]
    assert [r["command"] for r in msg.read_control(rows).collect()] == ["start"]


PAGE = """<html><body><table id=a><tr><td>one</td></tr></table>
<table><tbody></tbody><tr><th>Name</th></tr>
<tr><td> Battery <b>Service</b>&amp;co </td><td>org.x.service.battery_service</td><td>0x180F</td><td></td><td>Adopted</td></tr>
<tr><td>Nested<table><tr><td>in</td></tr></table></td><td>t.n</td><td>0x1</td><td>L</td></tr>
<tr><td></td></tr><tr><td>open<td>cells<td>0x2<td>L
</table></body></html>"""


def test_largest_table():
    rows = pages.largest_table(PAGE)
    assert rows[0] == ["Battery Service&co", "org.x.service.battery_service", "0x180F", "Adopted"]
    assert rows[1] == ["Nestedin", "in", "t.n", "0x1", "L"]
    assert rows[-1] == ["open", "cells", "0x2", "L"]
    assert pages.largest_table("<p>no table") == [] and pages.largest_table(None) is None


def test_catalogue_and_bad_rows(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    rows = pages.largest_table_rows(df)
    typed = pages.typed_rows(rows, pages.TABLE_COLUMNS["service_UUIDs"])
    errors = {r["n"]: r["error"] for r in typed.collect()}
    assert errors[0] is None and errors[1] == "expected 4 cells, got 5"
    found = pages.catalogue(rows, "service_UUIDs").orderBy("number").collect()
    assert [(r["number"], r["cname"]) for r in found if r["number"] == 0x180F] == [(0x180F, "battery_service")]
    units = spark.createDataFrame([(["0x2700", "unitless", "org.unit.unitless"],), (["zz", "a", "b"],)], "cells array<string>")
    table = pages.catalogues({"units_UUIDs": units, "formats": spark.createDataFrame([(["utf8s", "text"],)], "cells array<string>")})
    assert sorted((r["kind"], r["cname"]) for r in table.collect()) == [("formats", "utf8s"), ("units_UUIDs", "unitless")]
    texts = {r["kind"]: r["entries"] for r in pages.to_catalog(table).collect()}
    assert texts["formats"] == '[["utf8s","text"]]' and texts["units_UUIDs"] == '[["9984","unitless","unitless"]]'


def test_custom_converter(spark):
    df = spark.createDataFrame([(["a", "5"],)], "cells array<string>")
    out = pages.typed_rows(df, [("Name", None), ("Twice", lambda c: c.try_cast("int") * 2)]).first()
    assert out["Twice"] == 10 and out["error"] is None
