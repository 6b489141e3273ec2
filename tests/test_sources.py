import json

from tidewright.operators import feed
from tidewright.sources import files


def test_files(spark, tmp_path):
    for v, name in (("x", "A"), ("y", "B")):
        (tmp_path / f"c/version={v}").mkdir(parents=True)
        (tmp_path / f"c/version={v}/books.json").write_text(json.dumps([{"abbrev": "a", "name": name, "chapters": [["v1", "v2"]]}]))
    one = files.corpus(spark, str(tmp_path / "c"), "y")
    assert [(r.name, r.chapters) for r in one.collect()] == [("B", [["v1", "v2"]])]
    assert files.corpus(spark, str(tmp_path / "c")).count() == 2
    (tmp_path / "f.xml").write_text("<feed><entry><yt:videoId>v</yt:videoId><title>t\n</title></entry></feed>")
    assert [r.id for r in feed.videos(files.feeds(spark, str(tmp_path / "f.xml"))).collect()] == ["v"]
    (tmp_path / "kv").write_text('{"darkMode": true}\nbroken\n')
    assert [tuple(r.settings) for r in files.stored_settings(spark, str(tmp_path / "kv")).collect()] == [(True, 16.0), (False, 16.0)]
