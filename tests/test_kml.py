"""Archives of KML documents."""

import zipfile

import pytest

from tessera.sources import kml

MARK = "<Placemark><name>A &amp; B</name><description>&lt;td&gt;Depth (ft):&lt;/td&gt;&lt;td&gt; 12 &lt;/td&gt;</description><Point><coordinates> -70.5,44.25,0 </coordinates></Point></Placemark>"


def link(name, href):
    return f"<NetworkLink><name>{name}</name><Region><LatLonAltBox><north>2</north><south>1</south><east>4</east><west>3</west></LatLonAltBox></Region><Link><href>{href}</href></Link></NetworkLink>"


def test_placemarks_of_good_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("doc.kml", f"<kml><Document>{MARK}<Placemark><name>none</name></Placemark><Placemark><Point><coordinates>x,1</coordinates></Point></Placemark></Document></kml>")
        z.writestr("broken.kml", "<kml><Document><Placemark>")
        z.writestr("x.txt", MARK)
    (tmp_path / "b.kmz").write_text("<html>404</html>")
    with zipfile.ZipFile(tmp_path / "c.kmz", "w") as z:
        z.writestr("empty.KML", "<kml><Document></Document></kml>")
    got = kml.placemarks(kml.read_kmz(spark, str(tmp_path / "*.kmz"))).collect()
    assert [(r.file, r.name, r.lon, r.lat, r.fields) for r in got] == [("a", "A & B", -70.5, 44.25, {"depth_ft": "12"})]


def test_tree_of_links(spark, tmp_path):
    docs = {"root": link("n1", "p") + link("n2", "q"), "p": link("n3", "x") + link("n4", "root"), "q": link("n5", "p")}
    kml.write_kmz(spark.createDataFrame([(k, f"<kml><Document>{v}</Document></kml>") for k, v in docs.items()], "file string, kml string"), f"file://{tmp_path}/k")
    found = kml.links(kml.read_kmz(spark, f"file://{tmp_path}/k"))
    assert {(r.north, r.west) for r in found.collect()} == {(2.0, 3.0)}
    got = {(r.name, r.parent, r.depth) for r in kml.tiles(found, "root").collect()}
    assert got == {("n1", None, 0), ("n2", None, 0), ("n3", "n1", 1), ("n4", "n1", 1), ("n5", "n2", 1)}
    with pytest.raises(ValueError, match="deeper"):
        kml.tiles(found, "root", deepest=1)
    assert kml.tiles(found, "none").collect() == []
