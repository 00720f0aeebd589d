"""Reads of visit tables and snapshot documents."""

import json
import os

from pagelib.plans import stream_queries
from pagelib.plans.tables import Tables
from pagelib.sources import snapshots, visits


def test_jdbc_options_split_a_table():
    split = {"visits": ("id", 1, 1_000_000, 64)}
    got = visits.jdbc_options("jdbc:x:y", "visits", split, fetchsize=1000)
    assert got == {"url": "jdbc:x:y", "dbtable": "visits", "fetchsize": "1000", "partitionColumn": "id", "lowerBound": "1",
                   "upperBound": "1000000", "numPartitions": "64"}
    assert visits.jdbc_options("jdbc:x:y", "urls", split) == {"url": "jdbc:x:y", "dbtable": "urls"}
    one = visits.jdbc_options("jdbc:x:y", "visits", {"visits": ("id", 5, 5, 0)})
    assert one["upperBound"] == "6" and one["numPartitions"] == "1"


def test_snapshot_documents(spark, tmp_path):
    tab = {"tab_id": 1, "window": 1, "position": 0, "url": "https://a.example/", "title": "A", "pinned": False, "active": True}
    docs = {"s1": {"schema_version": 1, "tabs": [tab, tab | {"tab_id": 2}], "windows": [], "groups": []},
            "s2": {"schema_version": 2, "tabs": [tab]}, "s3": {"schema_version": 1, "tabs": [tab, tab]},
            "s4": {"schema_version": 1, "tabs": [tab | {"window": 0}]}}
    for name, doc in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text(json.dumps(doc))
    (tmp_path / "s5").mkdir()
    (tmp_path / "s5" / "doc.json").write_text('{"schema_version": 1, "tabs": [')
    got = snapshots.read_snapshots(spark, str(tmp_path))
    assert sorted((r["snapshot_id"], r["tab_id"]) for r in got["tabs"].collect()) == [("s1", 1), ("s1", 2)]
    assert sorted(r["snapshot_id"] for r in got["unreadable"].collect()) == ["s2", "s3", "s4", "s5"]
    # The documents are read from the table they were parsed into.
    assert "Scan json" not in got["tabs"]._jdf.queryExecution().toString()
    assert got["windows"].count() == 0 and got["snapshots"].count() == 1


def test_snapshot_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "with space+plus"
    tab = {"tab_id": 1, "window": 1, "position": 0, "url": "https://a.example/", "title": "A", "pinned": False, "active": True}
    doc = json.dumps({"schema_version": 1, "tabs": [tab], "windows": [], "groups": []})
    for i in range(40):
        (root / f"s{i}").mkdir(parents=True)
        (root / f"s{i}" / "doc.json").write_text(doc)
        (root / f"s{i}" / "notes.txt").write_text("no document")
    (root / "doc.json").write_text(doc)
    (root / "s1" / "deeper").mkdir()
    (root / "s1" / "deeper" / "doc.json").write_text(doc)
    for path in (str(root), f"file://{tmp_path}/with space+plus/"):
        got = snapshots.read_snapshots(spark, path)
        assert sorted(r.snapshot_id for r in got["tabs"].collect()) == sorted(f"s{i}" for i in range(40))
        assert got["unreadable"].count() == 0
    # One path is given to Spark, so the driver matches no folder by itself.
    seen = []
    monkeypatch.setattr(snapshots, "materialise", lambda df, name: seen.append(df) or df)
    snapshots.read_snapshots(spark, str(root))
    assert "Location: InMemoryFileIndex(1 paths)" in seen[0]._jdf.queryExecution().toString()


def test_one_file_for_each_snapshot_document(spark):
    folder = stream_queries.snapshot_folder(Tables(spark, "/root/testdata/sf0.001"))
    names = sorted(os.listdir(folder))
    assert len(names) > 20 and all(os.listdir(os.path.join(folder, n)) == ["document"] for n in names)
