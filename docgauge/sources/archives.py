"""Members of tar and zip archives as rows: a Spark data source over pre-staged files.

The directory is read by range reads alone (a zip's central directory, a tar's
headers), and each run of members of about `run` bytes is a partition whose task
reads its own bytes.  A compressed tar has no directory, it is one partition that
is read as a stream.  A damaged member is a row with an error and no content; a
damaged archive is a row without a member.

    register(spark)
    spark.read.format("archive").option("run", 64 << 20).load(folder)
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, size long, content binary, error string"
#: Bytes of members of a partition.
RUN = 64 << 20
STORED, DEFLATED = 0, 8
ZIP, TAR, STREAM, BROKEN = "zip", "tar", "stream", "broken"


class Run(InputPartition):
    """Members of one archive: (name, offset, bytes stored, bytes, method, checksum)."""

    def __init__(self, archive: str, kind: str, members: list[tuple], error: str | None = None):
        self.archive, self.kind, self.members, self.error = archive, kind, members, error


def _opened(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return store.open_input_file(path)


def _archives(uri: str) -> list[str]:
    """The archive, or those directly in the folder, by name."""
    from pyarrow import fs

    uri = uri if "://" in uri else "file://" + uri
    store, path = fs.FileSystem.from_uri(uri)
    root = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    if store.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(root + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")))


def _directory(uri: str) -> tuple[str, list[tuple]]:
    import tarfile
    import zipfile

    with _opened(uri) as f:
        if uri.lower().endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                return ZIP, [(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type if not i.flag_bits & 1 else -1, i.CRC) for i in z.infolist() if not i.is_dir()]
        if not uri.lower().endswith(".tar"):
            return STREAM, []
        with tarfile.open(fileobj=f, mode="r:") as t:
            return TAR, [(m.name, m.offset_data, m.size, m.size, STORED, None) for m in t if m.isfile()]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, run: int):
        self.path, self.run = path, run

    def partitions(self) -> list[Run]:
        out = []
        for uri in _archives(self.path):
            try:
                kind, members = _directory(uri)
            except Exception as e:
                out.append(Run(uri, BROKEN, [], f"{type(e).__name__}: {e}"))
                continue
            if kind == STREAM:
                out.append(Run(uri, kind, []))
            own, size = [], 0
            for m in sorted(members, key=lambda m: m[1]):
                own.append(m)
                size += m[2]
                if size >= self.run:
                    out.append(Run(uri, kind, own))
                    own, size = [], 0
            if own:
                out.append(Run(uri, kind, own))
        return out or [Run("", BROKEN, [])]

    def read(self, partition: Run):
        p = partition
        if p.kind == BROKEN:
            if p.error:
                yield (p.archive, None, None, None, p.error)
        elif p.kind == STREAM:
            yield from _streamed(p.archive)
        else:
            with _opened(p.archive) as f:
                for name, offset, stored, size, method, checksum in p.members:
                    try:
                        yield (p.archive, name, size, _member(f, p.kind, offset, stored, size, method, checksum), None)
                    except Exception as e:  # one damaged member must not stop the others
                        yield (p.archive, name, size, None, f"{type(e).__name__}: {e}")


def _member(f, kind: str, offset: int, stored: int, size: int, method: int, checksum: int | None) -> bytes:
    if kind == ZIP:
        head = f.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        offset += 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    raw = f.read_at(stored, offset)
    if len(raw) < stored:
        raise ValueError("the archive ends within the member")
    if method == DEFLATED:
        raw = zlib.decompressobj(-15).decompress(raw, size + 1)
    elif method != STORED:
        raise ValueError("encrypted, or packed by another method")
    if len(raw) != size or checksum is not None and zlib.crc32(raw) != checksum:
        raise ValueError("the member's checksum differs")
    return raw


def _streamed(uri: str):
    import tarfile

    try:
        with _opened(uri) as f, tarfile.open(fileobj=f, mode="r|*") as t:
            for m in t:
                if m.isfile():
                    raw = t.extractfile(m).read()
                    yield (uri, m.name, m.size, raw, None) if len(raw) == m.size else (uri, m.name, m.size, None, "the archive ends within the member")
    except Exception as e:
        yield (uri, None, None, None, f"{type(e).__name__}: {e}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("run", RUN)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def members(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """Rows as `SCHEMA` of an archive or of all archives in a folder."""
    register(spark)
    return spark.read.format("archive").option("run", run).load(path)


def save_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes member, content of each task's rows as a zip file, under its name only when complete; gives archive, n."""

    def write(batches):
        import uuid
        import zipfile

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        store.create_dir(root, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}.zip", 0
        part = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in _chain(first, batches):
                for member, content in zip(b.column(0).to_pylist(), b.column(1)):
                    z.writestr(zipfile.ZipInfo(member), content.as_py() or b"", zipfile.ZIP_DEFLATED)
                    n += 1
        store.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["archive", "n"])

    return rows.select("member", "content").mapInArrow(write, "archive string, n long")


def _chain(first, rest):
    yield first
    yield from rest
