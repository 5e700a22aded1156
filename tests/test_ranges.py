"""Files read in ranges: summaries of parts for every state at their start, Zstandard frames, plans without jobs."""

import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from chesslake.kernel import pgn as P
from chesslake.kernel import structure as S
from chesslake.sources import pgn, zstd_frames

BITS = [
    b"{", b"}", b";", b"\n", b"\r", b"(", b")", b"[", b"]", b'"', b"\\", b"%", b" ", b" 1-0 ", b"0-1\n", b"1/2-1/2 ", b"*", b" * ", b"e4", b"1", b"-", b"0", b"/2",
    b"\n1-0\n", b'[A "x"]\n', b"{c}", b"(Nf3)", b"\n%x\n",
]


def ranges(data: bytes, size: int, block: int, most: int) -> list[tuple[int, int, int, int]]:
    fold, out = S.Fold(most), []
    for a in range(0, max(1, len(data)), size):
        own, tail = io.BytesIO(data[a : a + size]), io.BytesIO(data[a + size :]) if a + size < len(data) else None
        begun = fold.add(S.summarise(own.read, tail and tail.read, a == 0, block))
        if begun:
            out.append(begun)
    return out


def told(data: bytes, most: int, games: int = 0, at: int = 0, lines: int = 0) -> list[tuple]:
    return [(games + f.number, at + f.offset, f.raw if f.error != "game_too_large" else None, f.error, lines + f.line) for f in P.frame(data, most)]


def same(data: bytes, size: int, block: int, most: int = P.MAX_GAME_BYTES) -> int:
    parts = ranges(data, size, block, most)
    stops = [p[0] for p in parts[1:]] + [len(data)]
    got = [row for (start, games, lines, _), stop in zip(parts, stops) for row in told(data[start:stop], most, games, start, lines)]
    assert got == told(data, most), (data, size, block, most)
    return len(parts)


@pytest.mark.parametrize("seed", range(8))
def test_parts_of_any_text_give_the_games_of_one_pass(seed):
    rng = random.Random(seed)
    several = 0
    for _ in range(25):
        data = b"".join(rng.choices(BITS, [rng.choice((0.2, 1, 3)) for _ in BITS], k=rng.randint(0, 120)))
        several += same(data, rng.choice((3, 7, 20, 50)), rng.choice((1, 5, 16, 64)), rng.choice((5, 20, 1 << 20))) > 1
    assert several


def test_parts_in_comments_tags_and_variations():
    game = b'[Event "a ] \\" b"]\n\n1. e4 (1. d4 (1. c4 {*\n1-0\n} c5) d5\n) e5 ; 0-1\n1-0\n\n'
    deep = b"1. e4 " + b"(\n" * 50 + b"1-0\n" + b")\n" * 50 + b"1-0\n"
    for data in (b"", b"\n", b"1-0", game * 9, deep * 3 + game, b")\n" * 30 + game * 3, b"{" + game * 5, b"1. e4 {\n" + b"\n1-0\n" * 40 + b"}\n*\n" + game * 2, b"no line ends 1-0 " * 30, b'[A "\n' + game * 3, b"\n1-0\r\n%1-0\r1-0\r\n" * 4):
        for size in (1, 2, 5, 17, 64):
            same(data, size, 13)


def test_a_part_keeps_one_summary_for_each_start():
    """Ends at any depth are told apart by the level that closing brings the depth to."""
    told = S.summarise(io.BytesIO(b"\n1-0\n)\n0-1\n").read, None, False)
    assert told["runs"][S.TEXT] == [S.TEXT, -1, -1, [[0, 1, 4, 0, 4, 0], [-1, 1, 10, 2, 10, 0]]]
    assert told["runs"][S.BRACE][3] == [] and told["lines"] == 3 and told["size"] == 11


def test_zstd_frames_are_told_from_headers():
    rng = random.Random(1)
    blobs = [b"", b"a", b"x" * 500_000, bytes(rng.randrange(256) for _ in range(300_000)), b"1. e4 *\n" * 9]
    parts = []
    for i, blob in enumerate(blobs):
        made = zstandard.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i % 3 != 0)
        parts += [made.compress(blob), (0x184D2A50 + i).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"]
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    parts.append(stream.compress(blobs[3]) + stream.flush())
    data = b"".join(parts)
    found = list(zstd_frames.frames(zstd_frames.windowed(lambda a, n: data[a : a + n], 100), len(data)))
    assert [zstandard.ZstdDecompressor().decompressobj().decompress(data[a:b]) for a, b in found] == [*blobs, blobs[3]]
    assert sum(b - a for a, b in found) == len(data) - 11 * len(blobs)
    cut = list(zstd_frames.frames(lambda a, n: data[: len(data) - 5][a : a + n], len(data) - 5))
    assert cut[:-1] == found[:-1] and cut[-1] == (found[-1][0], len(data) - 5)
    assert list(zstd_frames.frames(lambda a, n: b"not zstd"[a : a + n], 8)) == [(0, 8)] and not list(zstd_frames.frames(lambda a, n: b"", 0))


def _games(n: int) -> bytes:
    rng = random.Random(n)
    return b"".join(b'[Event "E%d"]\n\n1. e4 {%s} e5 (1... c5\n*) %s\n\n' % (i, b"1-0\n" * rng.randint(0, 5), rng.choice((b"1-0", b"*", b"1/2-1/2"))) for i in range(n))


def test_multi_frame_files_are_read_by_frames(spark, tmp_path):
    """A file of twenty frames that cut games anywhere is read in twenty tasks, each with its own games."""
    data = _games(400)
    size = len(data) // 20 + 1
    frames = [zstandard.compress(data[i : i + size]) for i in range(0, len(data), size)]
    (tmp_path / "many.pgn.zst").write_bytes(b"".join(frames))
    (tmp_path / "plain.pgn").write_bytes(data)
    (tmp_path / "one.pgn.zst").write_bytes(zstandard.compress(data))
    read = lambda name, n: pgn.read_frames(spark, str(tmp_path / name), range_bytes=n)
    rows = lambda df: df.select("source_game", "byte_offset", "raw", "error", "first_line").orderBy("source_game").collect()
    want = rows(read("plain.pgn", 1 << 30))
    assert len(want) == 400 and rows(read("one.pgn.zst", 100)) == want
    many = read("many.pgn.zst", min(map(len, frames)))
    assert rows(many) == want
    assert many.select(F.spark_partition_id().alias("p")).distinct().count() == len(frames) == 20
    assert rows(read("plain.pgn", 700)) == want and rows(read("many.pgn.zst", 1 << 20)) == want


def test_plans_start_no_job(spark, tmp_path):
    (tmp_path / "a.pgn").write_bytes(_games(50))
    (tmp_path / "b.pgn.zst").write_bytes(zstandard.compress(_games(30)) + zstandard.compress(_games(20)))
    sc = spark.sparkContext
    sc.setJobGroup("planning", "")
    try:
        frames, games = pgn.read_frames(spark, str(tmp_path), range_bytes=300), pgn.read_games(spark, str(tmp_path), fields=("plies",), range_bytes=300)
        assert len(sc.statusTracker().getJobIdsForGroup("planning")) == 0
        assert frames.count() == games.count() == 100
        assert len(sc.statusTracker().getJobIdsForGroup("planning")) > 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_what_follows_a_game_too_large_is_not_read():
    data = _games(20) + b"1. e4 {" + b"x\n" * 300 + b"} *\n" + _games(20)
    for most in (400, 700):
        for size in (50, 333, 5000):
            same(data, size, 64, most)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02}.pgn").write_bytes(_games(2))
    plan = pgn.plan_ranges(spark, pgn.discover(spark, str(tmp_path)))
    assert plan.count() == 30 and plan.select("slot").distinct().count() == 1
    assert pgn.read_frames(spark, str(tmp_path)).groupBy("source").count().where("count = 2").count() == 30


def test_files_are_written_in_frames(spark, tmp_path):
    from chesslake.sources import remote

    remote.register(spark)
    rows = spark.range(0, 500, 1, 1).select(F.format_string('[Site "%d"]\n\n1. e4 *', "id").alias("pgn"))
    rows.write.format("pgn").mode("append").option("compression", "zstd").option("frameBytes", 1000).save(str(tmp_path / "out"))
    (name,) = [p for p in (tmp_path / "out").iterdir()]
    data = name.read_bytes()
    found = list(zstd_frames.frames(lambda a, n: data[a : a + n], len(data)))
    texts = [zstandard.ZstdDecompressor().decompress(data[a:b]) for a, b in found]
    assert name.name.endswith(".pgn.zst") and len(texts) > 10 and all(t.endswith(b" *\n\n") and len(t) < 1100 for t in texts)
    sites = pgn.read_frames(spark, str(tmp_path / "out"), range_bytes=200).select("source_game", F.regexp_extract(F.col("raw").cast("string"), "Site .([0-9]+)", 1).cast("int").alias("s"))
    assert sites.where("source_game = s").count() == 500
    with pytest.raises(Exception, match="unknown compression"):
        rows.write.format("pgn").mode("append").option("compression", "lz4").save(str(tmp_path / "other"))


def test_files_that_arrive_are_read_once(spark, tmp_path):
    """Between two runs of a stream files arrive; a restart, a batch given again and files that were there before change nothing."""
    from chesslake.streaming import folders

    inbox, table, log = (str(tmp_path / n) for n in ("inbox", "table", "log"))
    (tmp_path / "inbox" / "deep").mkdir(parents=True)
    run = lambda **k: folders.collect_games(spark, inbox, table, log, **k).awaitTermination()
    (tmp_path / "inbox" / "a.pgn").write_bytes(_games(5))
    (tmp_path / "inbox" / "notes.txt").write_bytes(_games(5))
    run()
    run()
    (tmp_path / "inbox" / "deep" / "b.pgn.zst").write_bytes(zstandard.compress(_games(7)))
    (tmp_path / "inbox" / "c.pgn").write_bytes(_games(40))
    run(range_bytes=200)
    counts = {(r["batch"], r["source"].rsplit("/", 1)[1]): r["count"] for r in folders.collected(spark, table).groupBy("batch", "source").count().collect()}
    assert counts == {(0, "a.pgn"): 5, (1, "b.pgn.zst"): 7, (1, "c.pgn"): 40}
    (tmp_path / "log" / "commits" / "1").unlink()  # as if the driver had died after writing
    (tmp_path / "log" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert folders.collected(spark, table).count() == 52
    for name in "de":
        (tmp_path / "inbox" / f"{name}.pgn").write_bytes(_games(3))
    run(files_per_batch=1)
    assert folders.collected(spark, table).where("batch >= 2").groupBy("batch").count().where("count = 3").count() == 2
