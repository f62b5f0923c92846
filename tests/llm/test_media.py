import hashlib
import io
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import media
from millrace.operators import materialize as store

from .cases import TEXTS, documents, empty


def test_round_trip(spark):
    got = sorted((r["id"] or "", r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.round_trip(documents(spark)).collect())
    want = []
    for i, t in TEXTS:
        data = (t or "").encode()
        p = media.pad(data)
        want.append((str(i or ""), len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert media.round_trip(empty(spark)).count() == 0


def test_equal_texts_have_equal_values(spark):
    out = media.round_trip(documents(spark)).filter("id IN (1, 5)").select("media_sha256", "feature").distinct()
    assert out.count() == 1


def test_stored_form_is_wav_in_zip(spark):
    path = store.new_path(spark, "test")
    media.store(documents(spark), path)
    archive = media.load(spark, path).first()["archive"]
    with zipfile.ZipFile(archive.removeprefix("file://")) as z:
        name = z.namelist()[0]
        with wave.open(io.BytesIO(z.read(name))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
            assert w.getnframes() % 64 == 0


def test_ranges_read_each_member_once(spark):
    path = store.new_path(spark, "test")
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    media.store(rows, path, archive_bytes=5000)
    found = media.load(spark, path, range_bytes=1000, batch_bytes=300)
    assert found.rdd.getNumPartitions() > 20
    assert sorted(int(r["id"]) for r in found.select("id").collect()) == list(range(500))


def test_writes_add_up(spark):
    path = store.new_path(spark, "test")
    one = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id BIGINT, text STRING")
    ids = lambda: sorted(int(r["id"]) for r in media.load(spark, path).select("id").collect())
    media.store(one(1, 2), path)
    media.store(one(3, 4), path)
    media.store(one(), path)
    assert ids() == [1, 2, 3, 4]
    media.store(one(5), path, mode="overwrite")
    assert ids() == [5]


def test_ranges_hold_many_archives_and_are_bounded(spark, monkeypatch):
    path = store.new_path(spark, "test")
    rows = spark.range(300).repartition(6).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    media.store(rows, path, archive_bytes=500)
    assert media.load(spark, path).rdd.getNumPartitions() == 1
    monkeypatch.setattr(media, "MOST_RANGES", 7)
    reader = media.Reader({"path": path, "range_bytes": "10"})
    plan = reader.partitions()
    assert len(plan) == 7
    assert sorted(int(i) for r in plan for b in reader.read(r) for i in b.column(0).to_pylist()) == list(range(300))


class _Failing(media.Reader):
    """Every file breaks after a few reads, as often as told."""

    failures = 3

    def open(self, path):
        reader, f = self, super().open(path)

        class Broken:
            closed = False

            def seek(self, at):
                f.seek(at)

            def read(self, n):
                data = f.read(n)
                if reader.failures and n > 100 and reader.opened:
                    reader.failures -= 1
                    return data[:-1] + b"\x00"
                return data

            def close(self):
                f.close()

            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

        reader.opened = getattr(reader, "opened", -1) + 1
        return Broken()


def test_members_are_read_again_from_their_offset(spark):
    path = store.new_path(spark, "test")
    media.store(spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("text")).coalesce(1), path)
    reader = _Failing({"path": path, "wait": "0"})
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert (n, reader.failures) == (20, 0)
    reader = _Failing({"path": path, "wait": "0", "attempts": "2"})
    reader.failures = 1000
    with pytest.raises(RuntimeError):
        for p in reader.partitions():
            list(reader.read(p))


def test_what_failed_tasks_leave_is_not_read(spark):
    path = store.new_path(spark, "test")
    media.store(documents(spark), path)
    before = media.load(spark, path).count()
    system, name = media._open(path)
    with system.open_output_stream(name + "/left-over.zip") as f:
        f.write(b"PK")
    assert media.load(spark, path).count() == before
