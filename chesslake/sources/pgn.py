"""PGN sources and sinks.

Files are listed on the driver and streamed by the tasks, plain or Zstandard, in blocks: a task holds a game and a
block or two, whatever the file's size. Large files are read in ranges that begin where a game does, plain ones cut anywhere, Zstandard ones between frames. Games are
parsed one by one; a fault in a game is a row's `error`, never an exception. Positions come from
replaying each game's moves in the same pass, without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..kernel import board as B
from ..kernel import pgn as P
from ..kernel import structure

FRAMES = "source string, source_game long, byte_offset long, raw binary, error string, first_line long"
#: Files are read in ranges of about so many bytes.
RANGE_BYTES = 64 << 20
EVENTS = "source string, source_game long, seq int, kind string, start long, `end` long, text binary, number long, dots int, depth int, error string"
_ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", T.LongType())])
PARSED = T.StructType(
    [
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw_date", T.StringType()),
        T.StructField("raw_date_tag", T.StringType()),
        T.StructField("raw_utc_date", T.StringType()),
        T.StructField("moves", T.ArrayType(T.StringType())),
        T.StructField("plies", T.IntegerType()),
        T.StructField("outcome", T.IntegerType()),
        T.StructField("error", _ERROR),
        T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    ]
)


#: Games whose parsed values a task holds as Python objects at once.
_PARSED_AT_ONCE = 1000


def _with(rows: DataFrame, raw: str, fn, schema: T.StructType) -> DataFrame:
    """Columns of `rows` and the fields that `fn` gives for the bytes of `raw`, batch by batch."""
    full = T.StructType([*rows.schema.fields, *schema.fields])
    place = rows.columns.index(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in (whole.slice(i, _PARSED_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, _PARSED_AT_ONCE)):
            got = [fn(x) for x in batch.column(place).to_pylist()]
            own = [pa.array([g[f.name] for g in got], type=arrow.field(f.name).type) for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)), *own], schema=arrow)

    return rows.mapInArrow(run, full)


def discover(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """(file, bytes) in the order of the arguments: a folder's `.pgn` and `.pgn.zst` files in the order of their paths, and any named file.

    A folder without any is an error, as is a path that is not there.
    """
    hadoop, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for path in paths:
        root = hadoop(path)
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            raise FileNotFoundError(path)
        if store.getFileStatus(root).isFile():
            status = store.getFileStatus(root)
            found.append((status.getPath().toString(), status.getLen()))
            continue
        listing, own = store.listFiles(root, True), []
        while listing.hasNext():
            status = listing.next()
            if status.getPath().getName().lower().endswith((".pgn", ".pgn.zst")):
                own.append((status.getPath().toString(), status.getLen()))
        if not own:
            raise FileNotFoundError(f"no PGN files in {path}")
        found += sorted(own)
    return found


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return store.open_input_file(path)


def _zstd(uri: str) -> bool:
    return uri.lower().endswith(".zst")


class _Reader:
    """The text of a file's bytes from `seek` to `until`, decompressed, without its first `skip` bytes and no more than `size`, in blocks."""

    def __init__(self, uri: str, seek: int = 0, until: int | None = None, skip: int = 0, size: int | None = None):
        self.file = self.text = _open(uri)
        self.file.seek(seek)
        self.raw_left, self.left = None if until is None else until - seek, size
        self.take = self._raw
        if _zstd(uri):
            import zstandard

            self.take = zstandard.ZstdDecompressor().stream_reader(_Readable(self._raw), read_across_frames=True).read
        while skip > 0 and (gone := self.take(min(skip, 1 << 20))):
            skip -= len(gone)

    def _raw(self, size: int) -> bytes:
        if self.raw_left is not None:
            size = min(size, self.raw_left)
        data = self.file.read(size)
        if self.raw_left is not None:
            self.raw_left -= len(data)
        return data

    def read(self, size: int) -> bytes:
        if self.left is not None:
            size = min(size, self.left)
        data = self.take(size) if size else b""
        if self.left is not None:
            self.left -= len(data)
        return data

    def close(self) -> None:
        self.file.close()


class _Readable:
    def __init__(self, read):
        self.read = read


def _framed(uri: str, start: int, stop: int | None, seek: int, skip: int) -> Iterator[P.Frame]:
    """The games of a source between two places of its text; `seek` and `skip` tell where the file has the first."""
    reader = _Reader(uri, seek, None, skip, None if stop is None else stop - start)
    try:
        for f in P.frame_stream(reader.read):
            f.offset += start
            yield f
    finally:
        reader.close()


#: Tasks a core that ranges are shared by, where ranges are so small that there are more.
_TASKS_A_CORE = 16
_PARTS = "position int, source string, slot int, part int, low long, high long, final boolean"
_SUMMARIES = "position int, source string, slot int, part int, low long, summary string"
RANGES = "position int, source string, slot int, part int, start long, stop long, seek long, skip long, games_before long, lines_before long"


def _parts_of_zstd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of Zstandard files (position, source, length, slot, size): a part has the frames that begin in its `size` bytes."""
    from .zstd_frames import frames, windowed

    for batch in batches:
        for position, source, length, slot, size in zip(*(c.to_pylist() for c in batch.columns)):
            file = _open(source)

            def read(at, n, file=file):
                file.seek(at)
                return file.read(n)

            parts: dict[int, list[int]] = {}
            for low, high in frames(windowed(read), length):
                parts.setdefault(low // size, [low, high])[1] = high
            file.close()
            rows = [(position, source, slot + k, i, low, high, i == len(parts) - 1) for i, (k, (low, high)) in enumerate(parts.items())]
            if rows:
                types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["position", "source", "slot", "part", "low", "high", "final"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary for each part; a file of one part needs none."""
    for batch in batches:
        rows = []
        for position, source, slot, part, low, high, final in zip(*(c.to_pylist() for c in batch.columns)):
            summary = None
            if not (part == 0 and final):
                own, tail = _Reader(source, low, high), None if final else _Reader(source, high)
                try:
                    summary = json.dumps(structure.summarise(own.read, tail and tail.read, part == 0))
                finally:
                    own.close()
                    if tail:
                        tail.close()
            rows.append((position, source, slot, part, low, summary))
        if rows:
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["position", "source", "slot", "part", "low", "summary"])


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file from the summaries of its parts."""
    fold, out = structure.Fold(P.MAX_GAME_BYTES), []
    for row in rows.sort_values("part").itertuples():
        begun = fold.add(json.loads(row.summary)) if row.summary else (0, 0, 0, 0)
        if begun:
            start, games, lines, base = begun
            if out:
                out[-1][5] = start
            seek, skip = (row.low, start - base) if _zstd(row.source) else (start, 0)
            out.append([row.position, row.source, row.slot, row.part, start, None, seek, skip, games, lines])
    told = pd.DataFrame(out, columns=["position", "source", "slot", "part", "start", "stop", "seek", "skip", "games_before", "lines_before"])
    return told.astype({"stop": "Int64"})


def plan_ranges(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of files to read: slot (their order, which partitions follow), position (of the file), source, part, start and stop (of its text), seek and skip
    (where the file has its start: a byte, and bytes of text after it), games_before and lines_before. No job is run for it.

    Files of more than `range_bytes` are cut there, Zstandard files between the frames that begin in such ranges of the file. Parts are summarised
    for every state that they may begin in, and the summaries folded through each file, so that a range begins where a game does, whatever comments look
    like, and games and lines are numbered as in one pass. A file's summaries, a row a part, meet in one task; texts don't. Small files share a
    partition up to a like share of all bytes. Where ranges are small and many, consecutive ones share a partition, so that there are no more tasks than _TASKS_A_CORE
    a core or one for RANGE_BYTES.
    """
    share = min(range_bytes, max(1 << 20, sum(n for _, n in files) // spark.sparkContext.defaultParallelism))
    whole, plain, packed, slot, held = [], [], [], 0, None
    for i, (file, n) in enumerate(files):
        parts = max(1, -(-n // range_bytes))
        if parts > 1:
            (packed if _zstd(file) else plain).append((i, file, n, slot, range_bytes))
            slot, held = slot + parts, None
        else:
            if held is None or held[1] + n > share:
                held = [slot, 0]
                slot += 1
            held[1] += n
            whole.append((i, file, held[0], 0, 0, None, 0, 0, 0, 0))
    most = max(_TASKS_A_CORE * spark.sparkContext.defaultParallelism, sum(n for _, n in files) // RANGE_BYTES)
    together = max(1, -(-slot // most))
    tasks, task = max(1, -(-slot // together)), (F.col("slot") / together).cast("int")
    cut = None
    if plain:
        rows = spark.createDataFrame(plain, "position int, source string, length long, slot int, size long")
        last = F.ceil(F.col("length") / F.col("size")) - 1
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("low", F.col("part") * F.col("size"))
        cut = rows.select("position", "source", (F.col("slot") + F.col("part")).alias("slot"), "part", "low", F.least(F.col("low") + F.col("size"), "length").alias("high"), (F.col("part") == last).alias("final"))
    if packed:
        rows = spark.createDataFrame(packed, "position int, source string, length long, slot int, size long")
        parts = rows.repartition(len(packed)).mapInArrow(_parts_of_zstd, _PARTS)
        cut = parts if cut is None else cut.unionByName(parts)
    ranges = spark.createDataFrame(whole, RANGES)
    if cut is not None:
        told = cut.repartitionById(tasks, task).mapInArrow(_summaries, _SUMMARIES)
        ranges = ranges.unionByName(told.groupBy("position").applyInPandas(_folded, RANGES))
    return ranges.repartitionById(tasks, task)


def balanced_parts(games: DataFrame, size: int = 100_000, block: int = 4096) -> DataFrame:
    """Adds `part` to games (source, source_game from 1, n bytes): ranges of whole games of about `size` bytes in each source.

    Bytes before a game are those of the blocks of games before its own and of the games before it there, so no task holds a source.
    """
    rows = games.withColumn("block", F.floor((F.col("source_game") - 1) / block))
    blocks = rows.groupBy("source", "block").agg(F.sum("n").alias("bytes"))
    up_to = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "block", F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "block").orderBy("source_game").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["source", "block"])
    return placed.withColumn("part", F.floor((F.col("start") + F.col("inside")) / size)).drop("block", "start", "inside")


def repeated_game(spark: SparkSession, game: bytes, size: int = 8 << 20) -> DataFrame:
    """A synthetic source (source, source_game, raw) of one game over and over, of `size` bytes at least; made where it is used."""
    return spark.range(-(-size // max(1, len(game)))).select(F.lit("synthetic").alias("source"), F.col("id").alias("source_game"), F.lit(bytearray(game)).alias("raw"))


def read_frames(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The games of files and folders, plain or Zstandard: source, source_game, byte_offset, raw, error, first_line.

    A game is a row; the last row of a source has `error` if its text does not end with an outcome. Places are those in the
    decompressed text, `first_line` counts the line ends before the game.
    """
    return frames_of_files(spark, discover(spark, *paths), range_bytes)


def frames_of_files(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As `read_frames`, for files that are listed with their sizes."""
    ranges = plan_ranges(spark, files, range_bytes)

    def cut(batches):
        for batch in batches:
            for source, start, stop, seek, skip, games, lines in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches(source, _framed(source, start, stop, seek, skip), games, lines)

    return ranges.select("source", "start", "stop", "seek", "skip", "games_before", "lines_before").mapInArrow(cut, FRAMES)


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """Games of the driver's standard input (or another binary stream), framed as they come; its source is named stdin."""
    import sys

    stream = stream or sys.stdin.buffer
    rows = [("stdin", f.number, f.offset, f.raw, f.error, f.line) for f in P.frame_stream(stream.read)]
    return spark.createDataFrame(rows, FRAMES)


def _batches(source: str, frames: Iterator[P.Frame], games: int = 0, lines: int = 0, most: int = 2000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for f in frames:
        held.append((source, games + f.number, f.offset, f.raw, f.error, lines + f.line))
        size += len(f.raw)
        if len(held) == most or size > most_bytes:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["source", "source_game", "byte_offset", "raw", "error", "first_line"])


def frames_of_texts(texts: DataFrame) -> DataFrame:
    """Games of a relation of whole texts (source string, content binary): each text is framed by itself."""

    def cut(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(source, P.frame(content or b""))

    return texts.select("source", "content").mapInArrow(cut, FRAMES)


def _parse(strict: bool, counted: bool = True):
    def parse(raw: bytes | None) -> dict:
        g = P.parse_game(raw or b"", strict, counted)
        tags = {k: v.decode("utf-8", "replace") for k, v in g["tags"].items()}
        date = g["raw_tags"].get("Date", g["raw_tags"].get("UTCDate"))
        return {
            "tags": tags, "raw_date": None if date is None else date.decode("utf-8", "replace"), "raw_date_tag": _text(g["raw_tags"].get("Date")), "raw_utc_date": _text(g["raw_tags"].get("UTCDate")),
            "moves": g["moves"], "plies": len(g["moves"]), "outcome": g["outcome"], "error": g["error"], "counts": g["counts"],
        }

    return parse


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def parse_games(frames: DataFrame, raw: str = "raw", strict: bool = True, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Adds tags (the first of a name wins), raw_date, raw_date_tag, raw_utc_date, moves, plies, outcome, error and event counts.

    With `fields` only those of them, and of `frames` no column that is not needed: what a query does not ask for is
    neither sent to Python nor back.
    """
    frames = frames.withColumnRenamed("error", "frame_error") if "error" in frames.columns else frames
    return _with(frames, raw, *_parser(strict, fields))


def _parser(strict: bool, fields: tuple[str, ...] | None):
    """A function of a game's bytes that gives (at least) some fields, and their schema."""
    wanted = PARSED if fields is None else T.StructType([f for f in PARSED.fields if f.name in fields])
    if {f.name for f in wanted.fields} <= {"plies", "outcome", "error"}:
        return (lambda raw: P.count_game(raw or b"", strict)), wanted
    return _parse(strict, "counts" in {f.name for f in wanted.fields}), wanted


def read_games(spark: SparkSession, *paths: str, fields: tuple[str, ...] | None = None, strict: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The parsed games of files and folders: source, source_game, byte_offset, frame_error and fields of `parse_games`.

    Games are framed and parsed in one pass; their texts don't leave it.
    """
    ranges = plan_ranges(spark, discover(spark, *paths), range_bytes)
    parse, wanted = _parser(strict, fields)
    counts_only = {f.name for f in wanted.fields} <= {"plies", "outcome", "error"}
    schema = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("source_game", T.LongType()), ("byte_offset", T.LongType()), ("frame_error", T.StringType()))] + wanted.fields)
    names = [f.name for f in wanted.fields]

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch_of(held):
            places, games = zip(*held)
            columns = [*zip(*places), *([g[n] for g in games] for n in names)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for source, start, stop, seek, skip, before in zip(*(c.to_pylist() for c in batch.columns)):
                held = []
                for f in _framed(source, start, stop, seek, skip):
                    held.append(((source, before + f.number, f.offset, f.error), P.count_frame(f, strict) if counts_only else parse(f.raw)))
                    if len(held) == 5000:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return ranges.select("source", "start", "stop", "seek", "skip", "games_before").mapInArrow(cut, schema)


def game_rows(parsed: DataFrame) -> DataFrame:
    """The metadata columns of parsed games."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    return parsed.withColumns(
        {
            "event": tag("Event"), "site": tag("Site"), "white": tag("White"), "black": tag("Black"),
            "date_text": C.effective_date(tag("Date"), tag("UTCDate")), "time_control": tag("TimeControl"),
            "white_elo": C.parse_u32(tag("WhiteElo")), "black_elo": C.parse_u32(tag("BlackElo")),
            "fen": tag("FEN"), "variant": tag("Variant"),
            "result": F.coalesce("outcome", F.lit(0)), "mainline_plies": F.col("plies").cast("bigint"), "pgn_bytes": F.length("raw").cast("bigint") if "raw" in parsed.columns else F.length("pgn").cast("bigint"),
        }
    ).withColumns({"white_key": C.ascii_fold(F.col("white")), "black_key": C.ascii_fold(F.col("black")), "played_on": C.parse_date(F.col("date_text"))})


def read_events(frames: DataFrame, strict: bool = True) -> DataFrame:
    """One row per structural event, in order, and one with `error` where a game breaks off."""

    def run(batches):
        for batch in batches:
            rows = []
            for source, game, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seq = -1
                try:
                    for seq, e in enumerate(P.events(raw or b"", strict)):
                        rows.append((source, game, seq, e.kind, e.start, e.end, e.text, e.number, e.dots, e.depth, None))
                except P.PgnError as fault:
                    rows.append((source, game, seq + 1, None, fault.offset, fault.offset, None, None, None, None, fault.kind))
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            names = ["source", "source_game", "seq", "kind", "start", "end", "text", "number", "dots", "depth", "error"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return frames.select("source", "source_game", "raw").mapInArrow(run, EVENTS)


_STEP = T.StructType([T.StructField(n, t) for n, t in (("ply", T.IntegerType()), ("san", T.StringType()), ("uci", T.StringType()), ("board", T.StringType()), ("fen", T.StringType()), ("position_key", T.BinaryType()))])
_REPLAY = T.StructType([T.StructField("steps", T.ArrayType(_STEP)), T.StructField("replay_error", T.StructType([T.StructField("kind", T.StringType()), T.StructField("ply", T.IntegerType())]))])


def replay_line(line: str | None) -> dict:
    """Positions of a line `fen|san san ...`, ply 0 first, and the first move that can't be played."""
    if line is None:
        return {"steps": None, "replay_error": None}
    from ..kernel.batch import Replay

    fen, _, text = line.partition("|")
    return _stepped(Replay.of([(fen, text.split(" ") if text else [])])).to_pylist()[0]


def _stepped(run) -> pa.Array:
    """`steps` and `replay_error` of the lines of a `Replay`, line by line; what the games of a batch share is told once."""
    parts = list(run.steps())
    counts = np.zeros(len(run.sizes), dtype=np.int64)
    for _, games, _, _ in parts:
        counts[games] += 1
    offsets = np.concatenate(([0], np.cumsum(counts)))
    at, base = np.zeros(int(offsets[-1]), dtype=np.int64), 0
    nodes: dict[str, list] = {"ply": [], "san": [], "uci": [], "board": [], "fen": [], "position_key": []}
    for ply, games, node, own in parts:
        at[offsets[games] + ply] = base + node
        base += len(own["san"])
        nodes["ply"] += [ply] * len(own["san"])
        for name, values in own.items():
            nodes[name] += values
    types = {"ply": pa.int32(), "position_key": pa.binary()}
    told = pa.StructArray.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in nodes.items()], names=list(nodes)).take(pa.array(at))
    steps = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told)
    errors = [e and {"kind": e, "ply": int(n) + (0 if e.startswith("invalid_fen") else 1)} for e, n in zip(run.error, run.done)]
    error = pa.array(errors, pa.struct([("kind", pa.string()), ("ply", pa.int32())]))
    return pa.StructArray.from_arrays([steps, error], names=["steps", "replay_error"])


def line_of(fen, moves):
    """The text that identifies a line: its start and its moves."""
    return F.concat(F.coalesce(fen, F.lit("")), F.lit("|"), F.array_join(moves, " "))


def replay(rows: DataFrame) -> DataFrame:
    """Adds `steps` and `replay_error` to games with fen, variant and moves; other variants get nulls.

    A batch's games are replayed together where they are; what they share is worked out once.
    """
    told = _over_lines(rows, _stepped, T.StructField("__told", _REPLAY))
    return told.select(*rows.columns, "__told.*")


def _over_lines(rows: DataFrame, fn, field: T.StructField) -> DataFrame:
    """Adds a column that `fn` gives for a batch's lines, as one `Replay`; null for other variants than the standard one and for null moves."""
    standard = (F.col("variant").isNull() | (C.ascii_fold(F.col("variant")) == "standard")) & F.col("moves").isNotNull()
    named = rows.withColumn("__fen", F.when(standard, F.coalesce("fen", F.lit(""))))
    full = T.StructType([*rows.schema.fields, field])
    fen_at, moves_at = len(rows.columns), rows.columns.index("moves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..kernel.batch import Replay

        arrow = to_arrow_schema(full)
        for batch in batches:
            fens = batch.column(fen_at)
            own = fens.is_valid()
            got = fn(Replay.of_arrow(fens.filter(own).to_pylist(), batch.column(moves_at).filter(own)))
            at = np.cumsum(own.to_numpy(zero_copy_only=False)) - 1
            told = got.take(pa.array(at, mask=~own.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns[:fen_at])), told.cast(arrow.field(fen_at).type)], schema=arrow)

    return named.mapInArrow(run, full)


def with_position_keys(rows: DataFrame) -> DataFrame:
    """Adds `keys` to games with fen, variant and moves: the keys of the positions that the mainline visits, by ply; null for other variants.

    A batch's games are replayed together; only keys are computed, and they alone come back from Python.
    """

    def keys(run) -> pa.Array:
        words, counts = run.keys()
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(words), [None, pa.py_buffer(words.astype("<u8").tobytes())]).cast(pa.binary())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat)

    return _over_lines(rows, keys, T.StructField("keys", T.ArrayType(T.BinaryType())))


def first_plies(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds `first_ply` to games with fen, variant and moves: the first ply at which the mainline has the position of the key, else null.

    A batch's games are replayed together, each no further than to the position; only the ply comes back from Python.
    """

    def first(run) -> pa.Array:
        plies = run.first_plies(key)
        return pa.array(plies.astype(np.int32), mask=plies < 0)

    return _over_lines(rows, first, T.StructField("first_ply", T.IntegerType()))


def position_rows(replayed: DataFrame) -> DataFrame:
    """position_key, game_id, ply of every position that a game's mainline visits."""
    return replayed.select("game_id", F.explode("steps").alias("s")).select("s.position_key", "game_id", "s.ply")


def move_rows(replayed: DataFrame) -> DataFrame:
    return replayed.select("game_id", F.explode("steps").alias("s")).select("game_id", "s.ply", "s.san", "s.uci", "s.board", "s.fen").where("ply > 0")


def position_key(fen: str) -> bytes:
    """The key that positions are searched by; raises ValueError for a FEN that is none."""
    return B.Board(fen).key()


def write_pgn(games: DataFrame, path: str, raw: str = "pgn", suffix: str | None = None) -> None:
    """The games' texts, each with a blank line after it, in the order of game_id, as text files; `suffix` names them otherwise than .txt."""
    text = F.concat(F.btrim(F.col(raw).cast("string"), F.lit(" \t\r\n\f")), F.lit("\n"))
    games.repartitionByRange("game_id").sortWithinPartitions("game_id").select(text).write.text(path)
    if suffix:
        spark = games.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(root):
            name = status.getPath().getName()
            if name.endswith(".txt"):
                store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, name.removesuffix(".txt") + suffix))


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.text(path)


def stage_and_publish(df: DataFrame, path: str, write) -> None:
    """Write to a new folder beside `path`, then rename it: readers see all of it or nothing."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, temporary = hadoop(path), hadoop(f"{path}._tmp-{uuid.uuid4().hex}")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    write(df, temporary.toString())
    if not store.rename(temporary, target):
        raise OSError(f"could not publish {path}")
