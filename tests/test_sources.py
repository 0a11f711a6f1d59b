import json
import sqlite3
import struct

from orbisframe.sources import config
from orbisframe.sources.geopackage import GeoPackage, add_header, layers, strip_header, wkb_bounds


def test_geopackage_round_trip(spark, tmp_path):
    spark.dataSource.register(GeoPackage)
    point = lambda x, y: struct.pack("<BIdd", 1, 1, x, y)
    rows = [(k, f"n{k}", k / 2, point(k, -k)) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "fid long, name string, v double, geom binary")
    path = str(tmp_path / "w.gpkg")
    df.write.format("geopackage").option("path", path).option("layer", "towns").mode("append").save()
    got = spark.read.format("geopackage").option("path", path).option("layer", "towns").option("rows", "3").load()
    assert sorted((r.fid, r.name, r.v, bytes(r.geom)) for r in got.collect()) == rows
    with sqlite3.connect(path) as db:
        assert {r[0] for r in db.execute("select srs_id from gpkg_spatial_ref_sys")} == {-1, 0, 4326}
        assert db.execute("select data_type, min_x, min_y, max_x, max_y, srs_id from gpkg_contents").fetchall() == [("features", 1, -7, 7, -1, 4326)]
        assert db.execute("select length(last_change) from gpkg_contents").fetchone() == (24,) and db.execute("pragma foreign_key_check").fetchall() == []
    assert [f.name for f in tmp_path.iterdir()] == ["w.gpkg"]
    df.drop("geom").write.format("geopackage").option("path", path).option("layer", "plain").mode("append").save()
    assert layers(path) == ["plain", "towns"]
    line = struct.pack(">BII", 0, 2, 2) + struct.pack(">4d", 1, 5, -3, 2)
    ring = struct.pack("<BIII", 1, 1003, 1, 2) + struct.pack("<6d", 0, 0, 9, 4, 4, 9)
    assert wkb_bounds(line) == (-3, 2, 1, 5) and wkb_bounds(struct.pack("<BII", 1, 7, 2) + line + ring) == (-3, 0, 4, 5) and wkb_bounds(struct.pack("<BII", 1, 2, 0)) is None
    assert layers(path)[1:] == ["towns"] and strip_header(add_header(b"abc")) == b"abc"


def test_configuration(spark, tmp_path):
    (tmp_path / "Latin.txt").write_text("roma\n\nostia\n")
    assert sorted(r.word for r in config.read_word_lists(spark, [str(tmp_path / "Latin.txt")]).collect()) == ["ostia", "roma"]
    (tmp_path / "c.json").write_text(json.dumps([{"count": 3}, {"name": "A", "namer": "Latin", "preferences": {"Habitability": None}}]))
    c = config.read_cultures(spark, str(tmp_path / "c.json"))
    assert c.count() == 4 and config.weighted_sets(c, 2).count() == 2
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2\n3 -9\n")
    grid, head = config.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert {(r.px, r.py): r.value for r in grid.collect()} == {(0, 1): 1.0, (1, 1): 2.0, (0, 0): 3.0, (1, 0): None} and head["ncols"] == 2
    assert config.raster_bounds(head) == (0.0, 0.0, 2.0, 2.0) and config.raster_bounds({"ncols": 4, "nrows": 2, "xllcenter": 1, "yllcenter": 1, "cellsize": 2}) == (0, 0, 8, 4)
    assert tuple(config.raster_min_max(grid).first()) == (1.0, 3.0)
