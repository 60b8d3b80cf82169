"""Raw vectors and lines in byte ranges."""

from __future__ import annotations

import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from girasol.sources import raw


@pytest.fixture
def shards(tmp_path):
    x = np.arange(500, dtype="<f4").reshape(100, 5) / 8
    for i, (a, b) in enumerate(((0, 6), (6, 6), (6, 70), (70, 100))):
        (tmp_path / f"part-{i}.f32").write_bytes(x[a:b].tobytes())
    (tmp_path / "part-2.f16").write_bytes(b"\0" * 640)
    (tmp_path / "_hidden.f32").write_bytes(b"\0" * 20)
    return str(tmp_path), x


def test_vectors_of_many_splits(spark, shards):
    path, x = shards
    df = raw.vectors(spark, path, 5, split_bytes=200)
    assert df.rdd.getNumPartitions() == 1 + 7 + 3
    assert {r.row: r.embedding for r in df.collect()} == {i: v.tolist() for i, v in enumerate(x)}
    assert raw.vectors(spark, path, 5, split_bytes=1).rdd.getNumPartitions() == 100


def test_a_range_of_rows_reads_its_bytes_only(spark, shards):
    path, x = shards
    some = raw.vectors(spark, path, 5, first_row=65, last_row=73, split_bytes=200)
    assert {r.row: r.embedding for r in some.collect()} == {i: x[i].tolist() for i in range(65, 74)}
    reader = raw.VectorReader({"path": path, "width": "5", "splitBytes": "200", "firstRow": "65", "lastRow": "73"})
    assert sum(s.rows for s in reader.partitions()) == 9
    pushed = raw.VectorReader({"path": path, "width": "5"})
    left = list(pushed.pushFilters([raw.GreaterThan(("row",), 10), raw.LessThanOrEqual(("row",), 12), raw.EqualTo(("embedding",), 1)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and sum(s.rows for s in pushed.partitions()) == 2
    got = raw.vectors(spark, path, 5, split_bytes=200).where("row >= 90 AND row < 93")
    assert got.rdd.getNumPartitions() == 1 and {r.row for r in got.collect()} == {90, 91, 92}


def test_shards_are_written_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(300)], "vec_id long, v array<float>").repartition(4)
    for kind, tolerance in (("f32", 0), ("f16", 2e-3)):
        path = str(tmp_path / kind)
        raw.write_vectors(df, "vec_id", "v", path, kind=kind, shards=3)
        got = {r.row: r.embedding for r in raw.vectors(spark, path, 4).collect()}
        assert sorted(got) == list(range(300)) and np.allclose([got[i] for i in range(300)], x, atol=tolerance, rtol=tolerance)
    (tmp_path / "none").mkdir()
    assert raw.vectors(spark, str(tmp_path / "none"), 4).count() == 0
    with pytest.raises(Exception, match="no whole number of rows"):
        raw.vectors(spark, str(tmp_path / "f16"), 7).collect()


def lines_of(data: bytes) -> list[bytes]:
    parts = data.split(b"\n")
    return parts[:-1] if parts[-1] == b"" else parts


@pytest.mark.parametrize("split_bytes,read_bytes", [(7, 5), (64, 4 << 20), (1 << 20, 11)])
def test_the_index_holds_every_line(tmp_path, monkeypatch, split_bytes, read_bytes):
    monkeypatch.setattr(raw, "READ_BYTES", read_bytes)
    rng = random.Random(8)
    texts = [b"", b"\n", b"one", b"\n\n\na\n", b"last has no end\nx", *[b"\n".join(bytes(rng.choices(b"abc ", k=rng.randint(0, 20))) for _ in range(30)) + b"\n" * rng.randint(0, 1) for _ in range(6)]]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i:02d}.jsonl").write_bytes(t)
    reader = raw.LineReader({"path": str(tmp_path), "splitBytes": str(split_bytes)})
    found = []
    for split in reader.partitions():
        rows = [r for b in reader.read(split) for r in b.to_pylist()]
        assert [r["place"] for r in rows] == list(range(len(rows))) and all(split.start <= r["offset"] < split.end for r in rows)
        found += rows
    got = [open(r["file"], "rb").read()[r["offset"] : r["offset"] + r["length"]] for r in found]
    assert got == [x for t in texts for x in lines_of(t)]


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_near_ranges_are_read_once_and_far_ones_are_skipped():
    data = bytes(range(256)) * 4000
    f = Counted(data)
    ranges = [(0, 10), (10, 5), (40, 8), (500_000, 7), (500_003, 20), (999_990, 10)]
    assert list(raw.read_ranges(f, ranges, gap=64)) == [data[o : o + n] for o, n in ranges]
    assert f.taken == 48 + 23 + 10


def test_rows_by_number_out_of_many_files(spark, tmp_path):
    rows = [{"t": f"text {i} é" * (i % 9)} for i in range(700)]
    for k in range(7):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows[100 * k : 100 * (k + 1)]))
    index = raw.line_index(spark, str(tmp_path), split_bytes=500)
    assert [r.row for r in index.orderBy("row").collect()] == list(range(700))
    want = [3, 3, 99, 100, 101, 699, 4000, None]
    got = raw.lines_at(index, spark.createDataFrame([(i,) for i in want], "row long"), str(tmp_path)).collect()
    assert {r.row: json.loads(r.line) for r in got} == {i: rows[i] for i in (3, 99, 100, 101, 699)} and len(got) == 5
    assert raw.lines_at(index, spark.range(0).select(F.col("id").alias("row")), str(tmp_path)).count() == 0
