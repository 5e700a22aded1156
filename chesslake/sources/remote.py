"""A PGN data source for files and for a remote archive of a user's games.

`spark.read.format("pgn").load(folder)` plans one partition per file and frames games inside the readers, and `df.write.format("pgn").mode("append")`
writes a new folder of files that appears whole or not at all;
`spark.read.format("pgn_remote").option("user", ...)` asks a transport for a user's games with the limits that the options
give; filters on played_on, color and opponent are pushed into the request. The transport is
a class name, so that tests and other archives can bring their own; none is built in, as there is no network to use one. It gives a status and bytes
or a stream of them.
"""

from __future__ import annotations

import importlib
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.columns import ARCHIVE_START_MS
from ..kernel import pgn as P

SCHEMA = "source string, source_game long, byte_offset long, raw binary, error string, first_line long"
#: What a remote game has beside: the day, and the side and opponent of the user asked for.
REMOTE_SCHEMA = SCHEMA + ", played_on int, color string, opponent string"
PLAIN_OPTIONS = ("user", "since", "until", "max", "vs", "color", "ongoing", "gameid", "token", "sort")


class GameNotFound(LookupError):
    pass


class AccessDenied(PermissionError):
    pass


class RateLimited(RuntimeError):
    pass


def check_status(status: int) -> None:
    """The exception of an HTTP status: 401 and 403, 404, 429, and any other but 200."""
    if status in (401, 403):
        raise AccessDenied(f"the archive refused access ({status})")
    if status == 404:
        raise GameNotFound("no such user or game")
    if status == 429:
        raise RateLimited("the archive asks to wait")
    if status != 200:
        raise OSError(f"the archive answered {status}")


def discover(paths: list[str]) -> list[str]:
    """Files in the order of their arguments, each folder's sorted; a folder without any is an error."""
    found = []
    for path in paths:
        if not os.path.isdir(path):
            found.append(path)
            continue
        own = sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.lower().endswith((".pgn", ".pgn.zst")))
        if not own:
            raise FileNotFoundError(f"no PGN files in {path}")
        found += own
    return found


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def _rows(name: str, frames: Iterator[P.Frame]) -> Iterator[tuple]:
    for f in frames:
        yield name, f.number, f.offset, f.raw, f.error, f.line


def _facts(raw: bytes, user: str) -> tuple[int | None, str | None, str | None]:
    """Day, side and opponent of a game as the user's."""
    tags = P.parse_game(raw, strict=False)["tags"]
    date = tags.get("Date", tags.get("UTCDate", b"")).decode("utf-8", "replace").replace("-", ".")
    try:
        day = datetime.strptime(date, "%Y.%m.%d").year * 10000 + int(date[5:7]) * 100 + int(date[8:10])
    except ValueError:
        day = None
    names = [tags[k].decode("utf-8", "replace") if k in tags else None for k in ("White", "Black")]
    for side, own, other in (("white", *names), ("black", *names[::-1])):
        if own is not None and own.lower() == user.lower():
            return day, side, other
    return day, None, None


class _Files(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Part(p) for p in discover(self.paths)]

    def read(self, partition):
        with open(partition.name, "rb") as file:
            stream = file
            if partition.name.lower().endswith(".zst"):
                import zstandard

                stream = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
            yield from _rows(partition.name, P.frame_stream(stream.read))


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Games as PGN files of a folder that appears at once, whole.

    A task writes a file of its own beside the folder to be. When all tasks are done, what failed or repeated tasks left is removed and the folder
    gets its name; a job that fails leaves nothing. An existing folder is an error, or is replaced with `overwrite`.
    With `frame_bytes` files are Zstandard, of independent frames of about so many bytes of text, each ending with a game, so that readers share a file.
    """

    def __init__(self, path: str, column: int, overwrite: bool, frame_bytes: int | None = None):
        self.path, self.column, self.overwrite, self.frame_bytes = path.rstrip("/"), column, overwrite, frame_bytes
        self.temporary = f"{self.path}._tmp-{uuid.uuid4().hex}"
        if not overwrite and self._kind(self.path) != fs.FileType.NotFound:
            raise FileExistsError(path)
        store, folder = self._at(self.temporary)
        store.create_dir(folder, recursive=True)  # tasks don't make it: one that still runs when the job was given up must not bring it back

    @staticmethod
    def _at(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _kind(self, path: str) -> fs.FileType:
        store, at = self._at(path)
        return store.get_file_info(at).type

    def write(self, iterator):
        from pyspark import TaskContext

        store, folder = self._at(self.temporary)
        name, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pgn{'.zst' if self.frame_bytes else ''}", None
        held = bytearray()

        def frame():
            if held:
                import zstandard

                out.write(zstandard.ZstdCompressor(write_checksum=True).compress(bytes(held)))
                held.clear()

        try:
            for batch in iterator:
                for raw in batch.column(self.column).to_pylist():
                    if raw is None:
                        continue
                    if out is None:
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    text = (raw.encode() if isinstance(raw, str) else raw).strip(b" \t\r\n\f") + b"\n\n"
                    if not self.frame_bytes:
                        out.write(text)
                        continue
                    held += text
                    if len(held) >= self.frame_bytes:
                        frame()
            frame()
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages):
        store, folder = self._at(self.temporary)
        _, target = self._at(self.path)
        kept = {m.name for m in messages if m is not None and m.name}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in kept:
                store.delete_file(info.path)
        old = None
        if self._kind(self.path) != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(folder)
                raise FileExistsError(self.path)
            old = f"{target}._old-{uuid.uuid4().hex}"
            store.move(target, old)
        store.move(folder, target)
        if old is not None:
            store.delete_dir(old)

    def abort(self, messages):
        store, folder = self._at(self.temporary)
        if self._kind(self.temporary) != fs.FileType.NotFound:
            store.delete_dir(folder)


class PgnSource(DataSource):
    """Options: path, or paths separated by commas. Files lie where every executor sees them.

    Written are the texts of the column `pgn`, else of the first column of bytes or text, a file a partition in the order of its rows; with the option
    `compression` zstd in Zstandard frames of about `frameBytes` (4 MiB) of text.
    """

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Files([p for p in (self.options.get("paths") or self.options["path"]).split(",")])

    def writer(self, schema, overwrite):
        texts = [i for i, f in enumerate(schema.fields) if f.name == "pgn"] or [i for i, f in enumerate(schema.fields) if f.dataType.simpleString() in ("binary", "string")]
        if not texts:
            raise ValueError("no column of texts to write")
        compression = self.options.get("compression", "none").lower()
        if compression not in ("none", "zstd"):
            raise ValueError(f"unknown compression {compression}")
        return _Writer(self.options["path"], texts[0], overwrite, max(1, int(self.options.get("frameBytes", 4 << 20))) if compression == "zstd" else None)


def _day_ms(day: int, last: bool) -> int:
    """Unix milliseconds of the first or last moment of a day, not before the archive's start."""
    moment = datetime(day // 10000, day // 100 % 100, day % 100, tzinfo=timezone.utc)
    return max(int(moment.timestamp()) * 1000 + (86_399_999 if last else 0), ARCHIVE_START_MS)


class _Remote(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k: v for k, v in options.items() if k in PLAIN_OPTIONS}
        self.transport = options["transport"]
        if not self.options.get("user") and not self.options.get("gameid"):
            raise ValueError("user or gameId is needed")

    def pushFilters(self, filters):
        """Bounds of the day, the side and the opponent become limits of the request; Spark applies all filters again."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "played_on" and isinstance(value, int):
                try:
                    if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                        self.options["since"] = str(max(int(self.options.get("since", 0)), _day_ms(value, False)))
                    if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                        self.options["until"] = str(min(int(self.options.get("until", 1 << 62)), _day_ms(value, True)))
                except ValueError:  # no day: Spark finds that nothing matches
                    pass
            elif isinstance(f, EqualTo) and name in ("color", "opponent") and isinstance(value, str):
                self.options.setdefault({"color": "color", "opponent": "vs"}[name], value)
            yield f

    def partitions(self):
        return [_Part(self.options.get("user") or self.options["gameid"])]

    def read(self, partition):
        module, _, name = self.transport.rpartition(".")
        status, content = getattr(importlib.import_module(module), name)().fetch(self.options)
        check_status(status)
        frames = P.frame_stream((io.BytesIO(content) if isinstance(content, bytes) else content).read)
        for row in _rows(partition.name, frames):
            yield (*row, *_facts(row[3], self.options.get("user", "")))


class RemoteGames(DataSource):
    """Options: transport, user or gameId, and since, until, max, vs, color, ongoing, token for the archive."""

    @classmethod
    def name(cls) -> str:
        return "pgn_remote"

    def schema(self) -> str:
        return REMOTE_SCHEMA

    def reader(self, schema):
        return _Remote(dict(self.options))


def register(spark) -> None:
    """Make the sources known to a session; its filters are pushed to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PgnSource)
    spark.dataSource.register(RemoteGames)
