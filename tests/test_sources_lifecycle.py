import base64
import zlib
from datetime import UTC, datetime

import numpy as np
import pytest

from ionloom.operators import lifecycle
from ionloom.sources import mzml, raster_xml, target_list
from ionloom.streaming import arrivals


def array(values, kind, dtype="<f4", compressed=True):
    raw = np.array(values, dtype).tobytes()
    text = base64.b64encode(zlib.compress(raw) if compressed else raw).decode()
    width = "MS:1000521" if dtype == "<f4" else "MS:1000523"
    return f'<binaryDataArray encodedLength="{len(text)}"><cvParam accession="{width}" name="w"/><cvParam accession="{"MS:1000574" if compressed else "MS:1000576"}" name="c"/><cvParam accession="{kind}" name="k"/><binary>{text}</binary></binaryDataArray>'


def spectrum(n, level=1, rt="1.5", extra="", arrays="", unit="UO:0000031"):
    return f'<spectrum index="{n}" id="controllerType=0 scan={n}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130" name="positive scan" value=""/><scanList><scan><cvParam accession="MS:1000016" value="{rt}" unitAccession="{unit}"/></scan></scanList>{extra}<binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>\n'


PRECURSOR = '<precursorList><precursor spectrumRef="scan=1"><isolationWindow><cvParam accession="MS:1000827" value="200"/><cvParam accession="MS:1000828" value="0.5"/><cvParam accession="MS:1000829" value="0.5"/></isolationWindow><selectedIon><cvParam accession="MS:1000744" value="200.0123"/><cvParam accession="MS:1000041" value="2"/></selectedIon></precursor></precursorList>'


def write(path, body):
    path.write_text(f'<?xml version="1.0"?><mzML><run startTimeStamp="2025-01-01T00:00:00Z"><spectrumList>{body}</spectrumList></run></mzML>')


def test_mzml(spark, tmp_path):
    peaks = array([100, 200, 300], "MS:1000514") + array([1000, 5000, 2500], "MS:1000515")
    plain = array([50.12346, 60], "MS:1000514", "<f8", False) + array([1, 2], "MS:1000515", "<f8", False)
    body = spectrum(1, arrays=peaks) + spectrum(2, 2, "91", PRECURSOR, plain, "UO:0000010") + spectrum(3, 3, arrays=peaks) + spectrum(4, arrays="<binaryDataArray><binary>!!</binary></binaryDataArray>")
    body += spectrum(1, rt="2", arrays=peaks) + "".join(spectrum(k, arrays=peaks) for k in range(10, 60))
    write(tmp_path / "a.mzML", body)
    spark.dataSource.register(mzml.MzmlSource)
    for size in (3000, 1 << 20):
        df = spark.read.format("mzml").option("maxPartitionBytes", str(size)).load(str(tmp_path / "*.mzML"))
        rows = {r["scan_id"]: r for r in mzml.last_of_each_scan(df).collect()}
        assert df.count() == 54 and set(rows) == {1, 2, 4, *range(10, 60)}
    one, two = rows[1], rows[2]
    assert one["rt"] == 120.0 and one["polarity"] == "POSITIVE" and list(one["mz"]) == [100, 200, 300] and one["n_peaks"] == 3 and one["mz_max"] == 300
    assert two["rt"] == 91.0 and two["parent_scan_id"] == 1 and two["precursor_mz"] == 200.0123 and two["precursor_charge"] == 2 and two["isolation_window_lower"] == 0.5 and two["mz"][0] == pytest.approx(50.1235, abs=1e-5)
    assert rows[4]["mz"] is None
    assert mzml.instrument_info(str(tmp_path / "a.mzML")) == {"acquisition_start": "2025-01-01T00:00:00Z"}


def test_profile_file_is_refused(spark, tmp_path):
    write(tmp_path / "p.mzML", spectrum(1, extra='<cvParam accession="MS:1000128"/>'))
    spark.dataSource.register(mzml.MzmlSource)
    with pytest.raises(Exception, match="profile"):
        spark.read.format("mzml").load(str(tmp_path / "p.mzML")).count()


RASTER = '<targetRaster{ns} startTime="2026-08-11T12:00:00Z"><rasterConfig>{config}</rasterConfig><image width="10" height="20" {shift}>{pixels}</image></targetRaster>'
TWO = '<pixel x="0" y="0" offset="100" duration="500"/><pixel x="1" y="0" offset="700" duration="500"/>'


@pytest.mark.parametrize("ns", ["", ' xmlns="http://example.org/raster-1.0.0"'])
def test_raster_xml(spark, tmp_path, ns):
    path = tmp_path / "r.xml"
    path.write_text(RASTER.format(ns=ns, config='<spacingX units="Millimeter">0.05</spacingX><spacingY units="mm">0.07</spacingY>', shift='timeShift="500"', pixels=TWO))
    rows = raster_xml.pixels(spark, [str(path)]).orderBy("x").collect()
    assert [(r["pixel_id"], r["t_start"], r["t_end"]) for r in rows] == [(1, pytest.approx(0.6), pytest.approx(1.1)), (2, pytest.approx(1.2), pytest.approx(1.7))]
    begun = datetime(2026, 8, 11, 12, tzinfo=UTC).timestamp()
    assert [(r["abs_start"], r["abs_end"]) for r in rows] == [(pytest.approx(begun + 0.6), pytest.approx(begun + 1.1)), (pytest.approx(begun + 1.2), pytest.approx(begun + 1.7))]
    assert raster_xml.parse(str(path))[1] == {"width": 10, "height": 20, "raster_start": begun, "pixel_size_x": 0.05, "pixel_size_y": 0.07, "pixel_size_unit": "mm"}


def test_raster_xml_with_parts_missing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster_xml, "BATCH", 1)
    path = tmp_path / "r.xml"
    write_ = lambda **kw: path.write_text(RASTER.format(**{"ns": "", "config": "", "shift": "", "pixels": ""} | kw))
    write_(pixels='<pixel x="2" y="3" offset="1000" duration="2000"/>')
    (pixel,), info = raster_xml.parse(str(path))
    assert pixel[:4] == (2, 3, 1.0, 3.0) and (info["pixel_size_x"], info["pixel_size_unit"]) == (None, None)
    write_(config='<spacingX units="furlong">0.05</spacingX>')
    rows, info = raster_xml.parse(str(path))
    assert rows == [] and (info["pixel_size_x"], info["pixel_size_unit"]) == (0.05, None)
    assert raster_xml.pixels(spark, [str(path)]).count() == 0
    for text in ("<r><image width='1' height='1'/></r>", '<r startTime="2026-08-11T12:00:00Z"/>'):
        path.write_text(text)
        with pytest.raises(ValueError):
            raster_xml.parse(str(path))


def test_header_of_any_length(tmp_path):
    path = tmp_path / "h.mzML"
    path.write_text('<mzML><run startTimeStamp="2025-01-01T00:00:00Z">' + "\n" * 2000 + '<sourceFile id="s" name="raw.d"/>\n<spectrumList><spectrum/></spectrumList></run></mzML>')
    assert mzml.instrument_info(str(path)) == {"acquisition_start": "2025-01-01T00:00:00Z", "source_file": "raw.d"}


def test_target_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,FORMULA,InChIKey\nglucose,C6H12O6,WQZ\n")
    (tmp_path / "b.txt").write_text("name\tmz\nx\t500.25\n")
    rows = target_list.read_target_lists(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.txt")]).collect()
    assert [(r["name"], r["target_mz"]) for r in rows] == [("glucose", None), ("x", 500.25)] and rows[0]["neutral_mass"] == pytest.approx(180.0634, abs=1e-3)
    (tmp_path / "c.csv").write_text("name,formula\nx,C6H\n,C6\n")
    with pytest.raises(Exception, match="no name"):
        target_list.read_target_list(spark, str(tmp_path / "c.csv")).collect()


def test_lifecycle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (2, None, 5)], "k int, v string, at int")
    assert {tuple(r) for r in lifecycle.latest(df, ["k"], ["at"]).collect()} == {(1, "b", 2), (None, "c", 1), (2, None, 5)}
    new = spark.createDataFrame([(None, "n", 9), (3, "m", 9)], "k int, v string, at int")
    assert {tuple(r) for r in lifecycle.upsert(df, new, ["k"]).collect()} == {(1, "a", 1), (1, "b", 2), (2, None, 5), (None, "n", 9), (3, "m", 9)}
    lifecycle.snapshot({"t": df}, str(tmp_path / "v1"))
    wider = df.drop("at").selectExpr("k", "v", "cast(null as double) as w")
    back = lifecycle.restore(spark, str(tmp_path / "v1"), {"t": wider})["t"]
    assert back.columns == ["k", "v", "w"] and back.count() == 4
    lifecycle.replace_partitions(spark.createDataFrame([(1, 1), (2, 2)], "p int, v int"), str(tmp_path / "d"), ["p"])
    lifecycle.replace_partitions(spark.createDataFrame([(2, 9)], "p int, v int"), str(tmp_path / "d"), ["p"])
    assert {(r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {(1, 1), (2, 9)}
    log = lifecycle.command_row(spark, "align", "r1", {"ppm": 5}).unionByName(lifecycle.command_row(spark, "align", "r1", {"ppm": 7}, 3))
    assert lifecycle.was_run(log, "align", "r1", 3) and not lifecycle.was_run(log, "align", "r2")
    assert {r["args"]["ppm"] for r in lifecycle.last_arguments(log, "ppm int").collect()} == {5, 7}
    assert [r["line"] for r in lifecycle.quoted_lines(spark.createDataFrame([('a"b', 1.5), (None, None)], "s string, n double"), ["s", "n"]).collect()] == ['"a""b",1.5', '"",']


def test_arrivals(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = spark.createDataFrame([(1, "2025-01-01"), (1, "2025-01-02"), (2, "2025-01-01")], "id int, at string").selectExpr("id", "cast(at as timestamp) as at")
    rows.write.parquet(src)
    arrivals.drain(arrivals.without_repeats(arrivals.read_arrivals(spark, src, rows.schema), ["id"], "at"), out, state)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]
    rows.limit(1).write.mode("append").parquet(src)
    arrivals.drain(arrivals.without_repeats(arrivals.read_arrivals(spark, src, rows.schema), ["id"], "at"), out, state)
    assert spark.read.parquet(out).count() == 2
