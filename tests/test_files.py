import json
import zipfile

from tessera.sources.files import read_placemarks, read_points, write_points


def test_geojson(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"class": "rock", "area_m2": 3}},
        {"type": "Feature", "geometry": None, "properties": {"class": "shoal"}},
    ]}))
    got = read_points(spark, str(path), "struct<class:string,area_m2:double>")
    assert [tuple(r) for r in got.collect()] == [(1.5, 2.5, "rock", 3.0), (None, None, "shoal", None)]
    assert read_points(spark, str(tmp_path / "none.geojson"), "struct<class:string>").collect() == []
    write_points(got, str(tmp_path / "out"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0]["geometry"]["coordinates"] == [1.5, 2.5] and lines[1]["geometry"] is None and lines[1]["properties"]["area_m2"] is None


def test_kmz(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("doc.kml", "<kml><Placemark><name>A</name><Point><coordinates> -70.5,44.25,0</coordinates></Point></Placemark><Placemark><name>none</name></Placemark></kml>")
        z.writestr("x.txt", "<Placemark><coordinates>1,2</coordinates>")
    (tmp_path / "b.kmz").write_text("<html>404</html>")
    assert [(r.lon, r.lat) for r in read_placemarks(spark, str(tmp_path / "*.kmz")).collect()] == [(-70.5, 44.25)]
