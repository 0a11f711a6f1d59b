"""Versions of a world: what fails leaves the last one as it was."""

import pytest

from orbisframe.sources import snapshots
from orbisframe.world import Source, WorldMap


def _world(spark):
    w = WorldMap(spark, Source(n_tiles=4))
    w.put("tiles", spark.range(3).selectExpr("id as fid", "0D as elevation"))
    w.put("towns", spark.range(2).selectExpr("id as fid"))
    return w


def _heights(spark, folder, version=None):
    return sorted(r.elevation for r in WorldMap.load(spark, folder, version=version).tiles.collect())


def test_versions_and_rollback(spark, tmp_path):
    folder = str(tmp_path / "world")
    w = _world(spark)
    assert w.save(folder) == 1
    with pytest.raises(FileExistsError):
        _world(spark).save(folder)
    w.put("tiles", w.tiles.selectExpr("fid", "elevation + 7 as elevation"))
    assert w.save(folder, overwrite=True) == 2
    assert _heights(spark, folder) == [7, 7, 7] and _heights(spark, folder, 1) == [0, 0, 0]
    # the layer that hasn't changed is the same table
    places = [snapshots.read(spark, folder, v)[1] for v in (1, 2)]
    assert places[0]["towns"] == places[1]["towns"] and places[0]["tiles"] != places[1]["tiles"]
    assert snapshots.rollback(spark, folder, 1) == 3 and _heights(spark, folder) == [0, 0, 0]
    assert snapshots.vacuum(spark, folder, 1) == [places[1]["tiles"]]
    assert snapshots.versions(spark, folder) == [3] and _heights(spark, folder) == [0, 0, 0]
    with pytest.raises(FileNotFoundError):
        WorldMap.load(spark, folder, version=2)


def test_a_failing_edit_of_two_layers(spark, tmp_path):
    folder = str(tmp_path / "world")
    _world(spark).save(folder)
    w = WorldMap.load(spark, folder)
    w.put("tiles", w.tiles.selectExpr("fid", "elevation + 1 as elevation"))
    w.t["towns"] = w.t["towns"].selectExpr("fid", "raise_error('no') as name")
    with pytest.raises(Exception, match="no"):
        w.save(folder, overwrite=True)
    assert snapshots.versions(spark, folder) == [1] and _heights(spark, folder) == [0, 0, 0]
    # a manifest that was cut off isn't a version
    (tmp_path / "world" / "versions" / "000000002").write_text('{"tiles": "layers/none"}')
    assert snapshots.versions(spark, folder) == [1] and _heights(spark, folder) == [0, 0, 0]


def test_two_writers_on_one_version(spark, tmp_path):
    folder = str(tmp_path / "world")
    _world(spark).save(folder)
    a, b = WorldMap.load(spark, folder), WorldMap.load(spark, folder)
    for w, by in ((a, 1), (b, 2)):
        w.put("tiles", w.tiles.selectExpr("fid", f"elevation + {by} as elevation"))
    assert a.save(folder, overwrite=True) == 2
    with pytest.raises(snapshots.ConflictError):
        b.save(folder, overwrite=True)
    assert _heights(spark, folder) == [1, 1, 1]


def test_transactions(spark, tmp_path):
    folder = str(tmp_path / "world")
    w = _world(spark)
    with w.transaction(folder):
        w.put("tiles", w.tiles.selectExpr("fid", "elevation + 1 as elevation"))
    with pytest.raises(ValueError), w.transaction(folder):
        w.put("tiles", w.tiles.selectExpr("fid", "elevation + 10 as elevation"))
        w.put("towns", w.t["towns"].limit(0))
        raise ValueError
    assert sorted(r.elevation for r in w.tiles.collect()) == [1, 1, 1] and w.t["towns"].count() == 2
    assert snapshots.versions(spark, folder) == [1] and _heights(spark, folder) == [1, 1, 1]
