"""Label files in byte ranges."""

import struct

import pytest
from nearkey import folders
from nearkey.sources import files, label_files
from nearkey.sources.tables import star_model
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LABELS = {0: [(0, 0), (2, 5)], 2: [(2, 0)], 3: [(3, 0), (0, 7), (2, 1), (4, 9)], 6: [(6, 0)] + [(i, i + 1) for i in range(7, 40)]}
ROWS = {(v, h, d) for v, pairs in LABELS.items() for h, d in pairs}


def rows(df):
    found = [tuple(r) for r in df.select("vertex", "hub", "dist").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture
def out(tmp_path):
    values = [7]
    for v in range(7):
        values += [len(LABELS.get(v, []))] + [x for pair in LABELS.get(v, []) for x in pair]
    path = tmp_path / "a.out"
    path.write_bytes(struct.pack(f"<{len(values)}i", *values))
    return str(path)


@pytest.fixture
def forward(tmp_path):
    values = [x for v in LABELS for pair in LABELS[v] for x in pair] + [-1, -1]
    path = tmp_path / "a.labelForward"
    path.write_bytes(struct.pack(f"<{len(values)}i", *values))
    return str(path)


@pytest.mark.parametrize("step", [1, 8, 20, 64, 10**6])
def test_ranges_of_any_size(spark, out, forward, step, monkeypatch):
    monkeypatch.setattr(label_files, "BLOCK", 16)
    for path, form, one in ((out, label_files.OUT, files.read_labels), (forward, label_files.FORWARD, files.read_label_forward)):
        found = label_files.read(spark, path, form, step)
        assert rows(found) == ROWS == rows(one(spark, path))
        assert found.rdd.getNumPartitions() > 1 if step < 64 else found.rdd.getNumPartitions() >= 1


def test_broken_and_odd_files(spark, tmp_path, out, forward):
    data = open(forward, "rb").read()
    (tmp_path / "b.labelForward").write_bytes(data + struct.pack("<6i", 5, 0, 9, 9, 1, 1))
    assert rows(label_files.read(spark, str(tmp_path / "b.labelForward"), label_files.FORWARD, 24)) == ROWS
    (tmp_path / "c.labelForward").write_bytes(data[:-8])
    assert rows(label_files.read(spark, str(tmp_path / "c.labelForward"), label_files.FORWARD, 24)) == ROWS
    for name, form, content in (("e.out", ".out", b""), ("z.out", ".out", struct.pack("<i", 0)), ("e.labelForward", ".labelForward", b""), ("m.labelForward", ".labelForward", label_files.END)):
        (tmp_path / name).write_bytes(content)
        assert rows(label_files.read(spark, str(tmp_path / name), form)) == set()
    (tmp_path / "short.out").write_bytes(open(out, "rb").read()[:-4])
    with pytest.raises(Exception, match="ends inside a vertex"):
        label_files.read(spark, str(tmp_path / "short.out"), ".out").collect()
    (tmp_path / "first.labelForward").write_bytes(struct.pack("<4i", 1, 2, -1, -1))
    with pytest.raises(Exception, match="before any vertex"):
        label_files.read(spark, str(tmp_path / "first.labelForward"), ".labelForward").collect()


def test_written_files_are_read_back(spark, tmp_path):
    labels = star_model(spark, SF).labels
    own = labels.select("vertex").distinct().selectExpr("vertex", "vertex as hub", "0 as dist")
    # suppliers get ids above all parts, so a label is not one of a vertex to itself
    shifted = labels.withColumn("hub", F.col("hub") + 1_000_000)
    label_files.write_forward(shifted.repartition(5), str(tmp_path / "forward"))
    found = label_files.read(spark, str(tmp_path / "forward"), ".labelForward", 4096)
    assert rows(found) == rows(shifted.unionByName(own))
    assert not list((tmp_path / "forward").glob("*.draft"))
    label_files.write_out(shifted, str(tmp_path / "x" / "labels.out"))
    assert rows(label_files.read(spark, str(tmp_path / "x" / "labels.out"), ".out", 1000)) == rows(shifted)
    with pytest.raises(Exception, match="cannot hold a distance of 0"):
        label_files.write_forward(spark.createDataFrame([(1, 2, 0)], "vertex int, hub int, dist int"), str(tmp_path / "no"))


def test_pieces_are_joined_in_order(spark, tmp_path, monkeypatch):
    """Several pieces, with vertices without labels inside and between them, and none at all."""
    monkeypatch.setattr(folders, "TASK_ROWS", 3)
    place = str(tmp_path / "x" / "labels.out")
    label_files.write_out(spark.createDataFrame(sorted(ROWS)[::-1], "vertex int, hub int, dist int"), place)
    want = struct.pack("<i", 7)
    for vertex in range(7):
        pairs = sorted((d, h) for h, d in LABELS.get(vertex, []))
        want += struct.pack(f"<{1 + 2 * len(pairs)}i", len(pairs), *[x for d, h in pairs for x in (h, d)])
    assert (tmp_path / "x" / "labels.out").read_bytes() == want
    label_files.write_out(spark.createDataFrame([], "vertex int, hub int, dist int"), place)
    assert (tmp_path / "x" / "labels.out").read_bytes() == struct.pack("<i", 0)
    rows_of = [len(pairs) for pairs in LABELS.values()]
    assert folders.tasks_for(spark, sum(rows_of)) > 4
