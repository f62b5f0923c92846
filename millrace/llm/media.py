"""Media columns: payloads in zip archives, read by a data source of byte ranges.

`ArchiveSource` is a Spark data source over folders of zip archives.  Written
rows become members: 8-bit mono WAV files, deflated, whose samples are the
payload's bytes; each task writes archives of its own, and the commit lists the
finished ones in a manifest of that write, so what failed or repeated tasks left
is never read, and later writes add to earlier ones.  For reading, the driver plans
byte ranges over the listed archives from their sizes alone: large archives are
split, small ones put together, and with MOST_RANGES of them ranges grow instead.
A task takes its members from the archives' directories and streams them in Arrow
batches of bounded size.  A member that cannot be
read, or whose checksum is wrong, is read again from its own offset, with a file
opened anew, without touching the members around it.

Files go through pyarrow's file systems, so folders may be local, or in HDFS or
an object store.

Defined results: null and empty texts are one block of zeros; rows keep null ids;
repeated rows are members of their own; an empty table makes an empty manifest.
A payload of 4 GB or more is an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .arrow import frugal, pick
from ..operators.materialize import new_path

BLOCK = 64
#: Byte ranges of a read at most.
MOST_RANGES = 10_000
SCHEMA = "id string, archive string, offset bigint, media binary"
_ARROW = pa.schema([("id", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_ENTRY = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")


# ---- the stored form

def pad(data: bytes) -> bytes:
    """A positive multiple of 64 bytes."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(data: bytes) -> bytes:
    """8-bit mono samples at 8 kHz; the length before padding is kept in a chunk of its own."""
    payload = pad(data)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8) + struct.pack("<4sIQ", b"size", 8, len(data)) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(payload), b"WAVE") + head + payload


def from_wav(media: bytes) -> tuple[int, memoryview]:
    """(length before padding, payload)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    size, at, view = 0, 12, memoryview(media)
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"size":
            size = struct.unpack_from("<Q", media, at + 8)[0]
        elif name == b"data":
            return size, view[at + 8 : at + 8 + n]
        at += 8 + n
    raise ValueError("no samples")


def features(payload: memoryview) -> str:
    """Mean, root mean square and zero crossings of the samples around 128, and the energy in sixteen stretches, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = len(x)
    squares = x * x
    stretches = np.add.reduceat(squares, np.arange(16) * n // 16) * 16 // n
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={int(x.sum()) * 1000 // n};rms={int(np.sqrt(squares.sum() / n) * 1000)};crossings={crossings};energy=" + "".join(f"{min(int(v), 65535):04x}" for v in stretches)


# ---- archives

def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


class _ArchiveWriter:
    """A zip archive written from start to end."""

    def __init__(self, path: str):
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.at, self.entries = path, 0, []
        self.out = system.open_output_stream(name)

    def add(self, key: str | None, media: bytes) -> None:
        if len(media) >= 1 << 32:
            raise ValueError("a member of 4 GB or more")
        deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = deflate.compress(media) + deflate.flush()
        name = f"{len(self.entries):08d}.wav".encode()
        crc = zlib.crc32(media)
        note = b"" if key is None else b"=" + key.encode()
        self.out.write(_LOCAL.pack(b"PK\3\4", 20, 0, 8, 0, 33, crc, len(body), len(media), len(name), 0) + name)
        self.out.write(body)
        self.entries.append(_ENTRY.pack(b"PK\1\2", 20, 20, 0, 8, 0, 33, crc, len(body), len(media), len(name), 0, len(note), 0, 0, 0, self.at) + name + note)
        self.at += _LOCAL.size + len(name) + len(body)

    def close(self) -> dict:
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.out.write(directory)
        # Readers of our own take place and number from the manifest; other programs need no more than 65,535 members.
        self.out.write(_END.pack(b"PK\5\6", 0, 0, min(n, 65535), min(n, 65535), len(directory), self.at, 0))
        self.out.close()
        return {"path": self.path, "members": n, "directory": self.at, "directory_bytes": len(directory)}


@dataclass
class _Written(WriterCommitMessage):
    archives: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.archive_bytes = int(options.get("archive_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done, now = [], None
        for b in iterator:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None:
                    now = _ArchiveWriter(f"{self.path}/{uuid.uuid4().hex}.zip")
                now.add(key, to_wav(text or b""))
                if now.at >= self.archive_bytes or len(now.entries) >= 65535:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        return _Written(done)

    def commit(self, messages: list) -> None:
        system, name = _open(self.path)
        system.create_dir(name, recursive=True)
        old = _manifests(system, name) if self.overwrite else []
        new = f"{name}/manifest-{uuid.uuid4().hex}.jsonl"
        # Under its name only when it is complete.
        with system.open_output_stream(f"{new}.part") as out:
            for m in messages:
                for archive in m.archives if m else []:
                    out.write(json.dumps(archive).encode() + b"\n")
        system.move(f"{new}.part", new)
        for path in old:
            gone = _listed(system, path)
            system.delete_file(path)
            for archive in gone:
                system.delete_file(_open(archive["path"])[1])

    def abort(self, messages: list) -> None:
        for m in messages:
            for archive in m.archives if m else []:
                system, name = _open(archive["path"])
                system.delete_file(name)


def _manifests(system, name: str) -> list[str]:
    """Of all writes, in order of their names."""
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=False))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".jsonl"))


def _listed(system, path: str) -> list[dict]:
    with system.open_input_stream(path) as f:
        return [json.loads(line) for line in f.read().splitlines()]


@dataclass
class Range(InputPartition):
    """(archive, start, end): the members of archives that begin in [start, end)."""

    pieces: list[tuple[dict, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.attempts = int(options.get("attempts", 4))
        self.wait = float(options.get("wait", 0.2))

    def partitions(self) -> list[Range]:
        system, name = _open(self.path)
        archives = [a for path in _manifests(system, name) for a in _listed(system, path)]
        size = max(self.range_bytes, -(-sum(a["directory"] for a in archives) // MOST_RANGES))
        out, now, room = [], [], size
        for a in archives:
            at = 0
            while at < a["directory"]:
                end = min(at + room, a["directory"])
                now.append((a, at, end))
                room, at = room - (end - at), end
                if not room:
                    out.append(Range(now))
                    now, room = [], size
        return [*out, Range(now)] if now or not out else out

    def open(self, path: str):
        system, name = _open(path)
        return system.open_input_file(name)

    def _directory(self, archive: dict) -> bytes:
        with self.open(archive["path"]) as f:
            f.seek(archive["directory"])
            return f.read(archive["directory_bytes"])

    def _again(self, action, what: str):
        """The action's result, tried as often as `attempts`; it opens its file itself."""
        for attempt in range(self.attempts):
            try:
                return action()
            except (OSError, ValueError, zlib.error, struct.error) as e:
                if attempt + 1 == self.attempts:
                    raise RuntimeError(f"{what} cannot be read") from e
                time.sleep(self.wait * 2**attempt)

    def member(self, f, offset: int, packed: int, size: int, crc: int) -> bytes:
        f.seek(offset)
        head = f.read(_LOCAL.size)
        fields = _LOCAL.unpack(head)
        if fields[0] != b"PK\3\4":
            raise ValueError("no member begins here")
        f.seek(offset + _LOCAL.size + fields[9] + fields[10])
        media = zlib.decompress(f.read(packed), -15)
        if len(media) != size or zlib.crc32(media) != crc:
            raise ValueError("the checksum is wrong")
        return media

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for archive, start, end in partition.pieces:
            for row in self._members(archive, start, end):
                rows.append(row)
                held += len(row[3])
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, archive: dict, start: int, end: int) -> Iterator[tuple]:
        path, at = archive["path"], 0
        directory = self._again(lambda: self._directory(archive), f"the directory of {path}")
        shared = self._again(lambda: self.open(path), path)
        while at < len(directory):
            e = _ENTRY.unpack_from(directory, at)
            crc, packed, size, n_name, n_extra, n_note, offset = e[7], e[8], e[9], e[10], e[11], e[12], e[16]
            note = directory[at + _ENTRY.size + n_name + n_extra : at + _ENTRY.size + n_name + n_extra + n_note] if n_note else b""
            at += _ENTRY.size + n_name + n_extra + n_note
            if not start <= offset < end:
                continue
            try:
                media = self.member(shared, offset, packed, size, crc)
            except (OSError, ValueError, zlib.error, struct.error):

                def anew(offset=offset, packed=packed, size=size, crc=crc) -> bytes:
                    with self.open(path) as f:
                        return self.member(f, offset, packed, size, crc)

                media = self._again(anew, f"member at {offset} of {path}")
            yield note[1:].decode() if note else None, path, offset, media
        shared.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    """Options: path; for reading range_bytes, batch_bytes, attempts, wait; for writing archive_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


# ---- operator

def store(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", mode: str = "append", **options) -> None:
    """Writes every whole text, in UTF-8, as a member; mode `append` adds to what is there, `overwrite` replaces it."""
    documents.sparkSession.dataSource.register(ArchiveSource)
    rows = pick(documents, id=doc_id, text=text).select(F.col("id").cast("string").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    rows.write.format("media_archives").mode(mode).options(path=path, **{k: str(v) for k, v in options.items()}).save()


def load(spark, path: str, **options) -> DataFrame:
    """id, archive, offset and media of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for media in b.column(1):
            data = media.as_buffer().to_pybytes()
            n, payload = from_wav(data)
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
        columns = zip(*out, strict=True) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def describe(members: DataFrame) -> DataFrame:
    """id, and what the stored bytes say: lengths, digests and features."""
    return members.select("id", "media").mapInArrow(frugal(_describe), "id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def round_trip(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores all texts in the shared folder, and describes what is read back."""
    spark = documents.sparkSession
    path = new_path(spark, "media")
    store(documents, path, doc_id=doc_id, text=text)
    return describe(load(spark, path))
