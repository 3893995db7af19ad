"""Filters on times reach the files: what isn't near is neither planned nor read, and the rows are the same."""

import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, IsNotNull, LessThan, LessThanOrEqual

from tidemark.model import LONG_MAX
from tidemark.sources import datasource, mcap

N, SIZE = 200, 2000


def written(path, chunk, codec="", finish=True):
    out = io.BytesIO()
    w = mcap.Writer(out, codec, chunk)
    for t in range(N):
        w.add(w.channel(f"/t{t % 3}", "json"), t, 1000 + t, 5000 - t, os.urandom(SIZE))
    w.close() if finish else w.flush()
    path.write_bytes(out.getvalue())


def read(path, filters, monkeypatch, **options):
    """log times of the rows, and bytes read, by driver and tasks."""
    seen = [0]
    true = datasource._reader

    def counted(p):
        fd, read_at = true(p)

        def at(place, n):
            data = read_at(place, n)
            seen[0] += len(data)
            return data

        return fd, at

    monkeypatch.setattr(datasource, "_reader", counted)
    batch = datasource._Batch({"path": str(path)} | options)
    assert list(batch.pushFilters(filters)) == filters
    parts = batch.partitions()
    rows = [r["log_ns"] for p in parts for b in batch.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(datasource, "_reader", true)
    return rows, seen[0], parts


LOG = ("log_ns",)


@pytest.mark.parametrize(("chunk", "finish"), [(0, True), (0, False), (20_000, True), (20_000, False)])
def test_only_what_is_near_is_read(tmp_path, monkeypatch, chunk, finish):
    written(tmp_path / "a.mcap", chunk, finish=finish)
    size = os.path.getsize(tmp_path / "a.mcap")
    every, whole, _ = read(tmp_path, [], monkeypatch)
    assert every == list(range(1000, 1000 + N)) and whole >= size * 0.99
    near, some, _ = read(tmp_path, [GreaterThanOrEqual(LOG, 1050), LessThan(LOG, 1056), IsNotNull(LOG)], monkeypatch)
    assert set(range(1050, 1056)) <= set(near) and len(near) <= 30
    # the messages' extents, what a look at each other chunk or message costs, and the list of chunks
    assert some < (70_000 if chunk and finish else 120_000 if chunk else size)
    none, few, parts = read(tmp_path, [GreaterThan(LOG, 10**6)], monkeypatch)
    assert none == [] and few < (30_000 if chunk and finish else size)


@pytest.mark.parametrize("filters", [[EqualTo(LOG, 1100)], [GreaterThan(LOG, 1099), LessThanOrEqual(LOG, 1100)], [EqualTo(("publish_ns",), 4900)], [EqualTo(("publish_ns",), 4900), GreaterThanOrEqual(LOG, -5)]])
def test_each_comparison(tmp_path, monkeypatch, filters):
    written(tmp_path / "a.mcap", 0)
    assert read(tmp_path, filters, monkeypatch)[0] == [1100]
    written(tmp_path / "a.mcap", 20_000)
    assert 1100 in read(tmp_path, filters, monkeypatch)[0]


@pytest.mark.parametrize("codec", ["", "zstd"])
def test_a_recording_is_scanned_in_several_tasks(spark, tmp_path, codec):
    written(tmp_path / "a.mcap", 20_000, codec)
    one = datasource.read(spark, str(tmp_path)).orderBy("offset", "inner_seq").collect()
    datasource.register(spark)
    for table in ("messages", "records", "channels"):
        load = lambda n, t=table: spark.read.format("mcap").option("path", str(tmp_path)).option("table", t).option("split_bytes", n).load()
        many, whole = load(50_000), load(1 << 30)
        assert many.rdd.getNumPartitions() >= 4 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(str, many.collect())) == sorted(map(str, whole.collect())) and many.count() > 0
    assert len(one) == N


def test_spark_pushes_filters_and_rows_are_the_same(spark, tmp_path):
    written(tmp_path / "a.mcap", 20_000, "zstd")
    written(tmp_path / "b.mcap", 0)
    all_ = datasource.read(spark, str(tmp_path), with_payload=False)
    for condition in ("log_ns between 1030 and 1041", "publish_ns > 4990", "log_ns = 1199 and publish_ns <= 4801", "log_ns < 0", "log_ns >= 1190 or log_ns < 1003", f"log_ns > {LONG_MAX - 1}"):
        got = sorted(tuple(r) for r in all_.filter(condition).select("recording_id", "offset", "inner_seq", "log_ns").collect())
        want = sorted(tuple(r) for r in all_.withColumn("x", F.expr(condition)).select("recording_id", "offset", "inner_seq", "log_ns", "x").filter(F.col("x") | F.rand().isNull()).drop("x").collect())
        assert got == want, condition


def test_lists_of_chunks_that_cant_be_true_are_not_followed(tmp_path):
    written(tmp_path / "a.mcap", 20_000)
    raw = (tmp_path / "a.mcap").read_bytes()
    read_at = lambda data: lambda at, n: data[at : at + n]
    index = mcap.chunk_index(read_at(raw), len(raw))
    assert len(index) > 10 and all(raw[o] == mcap.CHUNK for o, *_ in index)
    at = raw.rindex(index[3][0].to_bytes(8, "little"))
    moved = raw[:at] + (index[2][0] + 5).to_bytes(8, "little") + raw[at + 8 :]
    for data in (moved, raw[:-1], raw[:100], b"", raw[:-37] + b"\2" + b"\xff" * 28 + mcap.MAGIC):
        assert mcap.chunk_index(read_at(data), len(data)) == []
