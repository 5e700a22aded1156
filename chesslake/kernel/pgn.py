"""PGN text: cutting a stream into games, and a game into events.

Both are lexers built on one regular expression each. `frame` finds game ends (outcome markers
outside tags, comments and variations); `events` gives the structural tokens of a game with their
byte offsets, and the first error.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

MAX_GAME_BYTES = 16 << 20
_SPACE = rb"\t\n\x0c\r "
_COMMENTS = rb"\{[^}]*(?:\}|\Z)|;[^\r\n]*|(?:(?<=[\r\n])|\A)%[^\r\n]*"
_FRAME = re.compile(
    rb"(?P<skip>" + _COMMENTS + rb"|\[(?:[^\]\"]|\"(?:\\.|[^\"\\])*(?:\"|\\?\Z))*(?:\]|\Z))"
    rb"|(?P<open>\()|(?P<close>\))"
    rb"|(?P<end>(?:(?<=[" + _SPACE + rb"{};()$!?\[\]])|\A)(?:1/2-1/2|1-0|0-1|\*)(?=[" + _SPACE + rb"{};()$!?\[\]]|\Z))",
    re.DOTALL,
)
_END = rb"(?=[" + _SPACE + rb"{;()$!?\[]|\Z)"
_TOKEN = re.compile(
    rb"(?P<outcome>(?:1/2-1/2|1-0|0-1|\*)" + _END + rb")"
    rb"|(?P<number>[0-9]+)(?P<dots>\.+)"
    rb"|(?P<san>[^" + _SPACE + rb"{};()$!?\[]+)"
    rb"|\{(?P<brace>[^}]*)\}|(?P<line>;[^\r\n]*)|(?P<open>\()|(?P<close>\))"
    rb"|\$(?P<nag>[0-9]+)|(?P<glyph>[!?]+)",
)
_ESCAPE = re.compile(rb"%[^\r\n]*")
_TAG = re.compile(rb'\[[ \t]*([A-Za-z0-9_]+)[ \t]*"((?:[^"\\\r\n]|\\[^\r\n])*)"[ \t]*\]', re.DOTALL)
_BLANK = re.compile(rb"[" + _SPACE + rb"]*")
OUTCOMES = {b"*": 0, b"1-0": 1, b"0-1": 2, b"1/2-1/2": 3}
U32 = 4294967295


@dataclass
class Frame:
    number: int
    offset: int
    raw: bytes
    error: str | None = None
    line: int = 0  # line ends before it
    easy: re.Match | None = None  # how it was told, if it is easy


#: What a game's text is made of where it is easy to tell: blanks, comments in braces, glyphs, and moves with or without a number.
_EASY_ITEMS = (
    rb"(?:[1-9][0-9]{0,8}+\.(?:\.\.)?+[ ]*+)?+[a-hKQRBNO][^" + _SPACE + rb"{};()$!?\[\].%]*+(?:[ \n]++|(?=[{$!?)]))"
    rb"|\{[^}]*+\}[ \n]*+|[!?]++[ \n]*+|\$[0-9]{1,9}+(?:[ \n]++|(?=[{)]))|[ \n]++"
)
#: An easy game: tag pairs, such items and variations of such items without further ones, and the outcome. One match tells all of it.
_EASY_GAME = (
    rb"[" + _SPACE + rb"]*+((?:\[[A-Za-z0-9_]++[ \t]++\"[^\"\\\r\n]*+\"\][" + _SPACE + rb"]*+)*+)"
    rb"((?:" + _EASY_ITEMS + rb"|\((?:" + _EASY_ITEMS + rb")*+\))*+)(?<=[" + _SPACE + rb"{}()!?\]])(1/2-1/2|1-0|0-1|\*)"
)
_EASY = re.compile(_EASY_GAME + rb"[" + _SPACE + rb"]*\Z")
_EASY_START = re.compile(_EASY_GAME + rb"(?=[" + _SPACE + rb"])")
_BRACES, _NAGS, _GLYPHS, _ASIDES = (re.compile(x) for x in (rb"\{[^}]*\}", rb"\$[0-9]+", rb"[!?]+", rb"\([^()]*\)"))


def _game_end(data: bytes, start: int, last: bool) -> int | None:
    """Where the game that begins at `start` ends; None if the data does not tell. `last`: nothing follows the data."""
    depth = 0
    view = memoryview(data)[start:]  # lookbehinds see the byte before a game only as its start
    for m in _FRAME.finditer(view):
        kind = m.lastgroup
        if m.end() == len(view) and not last:  # what follows may be part of it
            return None
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "end" and depth == 0:
            return start + m.end()
    return None


def frame_stream(read: Callable[[int], bytes], max_bytes: int = MAX_GAME_BYTES, chunk: int = 1 << 18) -> Iterator[Frame]:
    """The games of a stream in order; the last may be an error frame with what is left.

    `read` gives up to so many bytes, none at the end. A game keeps the blanks before it. What follows an error is not
    read. No more is held than a game and a chunk or two.
    """
    data, at, base, number, line, last = b"", 0, 0, 0, 0, False
    while True:
        easy = _EASY_START.match(data, at)
        end = easy.end() if easy else _game_end(data, at, last) if at < len(data) else None
        if end is None and not last and len(data) - at <= max_bytes:
            more = read(max(chunk, len(data) - at))
            last = not more
            data, base, at = data[at:] + more, base + at, 0
            continue
        if end is None or end - at > max_bytes:
            rest = data[at:]
            if len(rest) > max_bytes:
                yield Frame(number, base + at, b"" if end is not None else rest[: max_bytes + 1], "game_too_large", line)
            elif rest.strip(b"\t\n\x0c\r "):
                yield Frame(number, base + at, rest, "missing_outcome", line)
            return
        raw = data[at:end]
        yield Frame(number, base + at, raw, None, line, easy)
        at, number, line = end, number + 1, line + raw.count(b"\n")


def frame(data: bytes, max_bytes: int = MAX_GAME_BYTES) -> Iterator[Frame]:
    """The games of a source that is held whole."""
    return frame_stream(io.BytesIO(data).read, max_bytes, max(1, len(data)))


@dataclass
class Event:
    kind: str
    start: int
    end: int
    text: bytes = b""
    number: int | None = None
    dots: int | None = None
    depth: int = 0


class PgnError(ValueError):
    def __init__(self, kind: str, offset: int):
        super().__init__(kind)
        self.kind, self.offset = kind, offset


def _tag_error(data: bytes, at: int) -> PgnError:
    """What is wrong with the tag pair that begins here."""
    def blanks(i: int) -> int:
        while data[i : i + 1] in (b" ", b"\t"):
            i += 1
        if data[i : i + 1] in (b"\r", b"\n"):
            raise PgnError("newline_in_tag", i)
        return i

    try:
        i = blanks(at + 1)
        name = re.compile(rb"[A-Za-z0-9_]*").match(data, i).end()
        if name == i:
            return PgnError("expected_tag_name", i)
        i = blanks(name)
        if data[i : i + 1] != b'"':
            return PgnError("expected_tag_value", i)
        i = re.compile(rb'(?:[^"\\\r\n]|\\[^\r\n])*', re.DOTALL).match(data, i + 1).end()
        if data[i : i + 1] == b"\\":
            i += 1
        if i >= len(data):
            return PgnError("unterminated_tag_value", len(data))
        if data[i : i + 1] != b'"':
            return PgnError("newline_in_tag", i)
        return PgnError("expected_closing_bracket", blanks(i + 1))
    except PgnError as error:
        return error


def events(data: bytes, strict: bool = True) -> Iterator[Event]:
    """The events of all games in `data`; raises PgnError at the first fault.

    Not strict: a last game may lack its outcome, and a tag pair outside variations begins a game.
    """
    at = _BLANK.match(data).end()
    while at < len(data):
        yield Event("game_start", at, at)
        while data[at : at + 1] == b"[":
            m = _TAG.match(data, at)
            if not m:
                raise _tag_error(data, at)
            yield Event("tag", at, m.end(), m[1] + b"\0" + m[2])
            at = _BLANK.match(data, m.end()).end()
        yield Event("movetext_start", at, at)
        depth = 0
        while True:
            at = _BLANK.match(data, at).end()
            if at == len(data):
                if depth:
                    raise PgnError("unclosed_variation", at)
                if strict:
                    raise PgnError("missing_outcome", at)
                yield Event("game_end", at, at)
                return
            first = data[at : at + 1]
            if first == b"[":
                if strict or depth:
                    raise PgnError("unexpected_header", at)
                yield Event("game_end", at, at)
                break
            if first == b"%" and (at == 0 or data[at - 1 : at] == b"\n"):
                m = _ESCAPE.match(data, at)
                yield Event("comment_escape", at, m.end(), m[0][1:], depth=depth)
                at = m.end()
                continue
            m = _TOKEN.match(data, at)
            if not m:
                raise PgnError({b"{": "unterminated_comment", b"$": "invalid_nag"}.get(first, "unexpected_byte"), at)
            kind, text = m.lastgroup, m[m.lastgroup]
            if kind == "close" and depth == 0:
                raise PgnError("unmatched_variation_end", at)
            if kind == "dots":
                number = int(m["number"])
                if len(text) not in (1, 3) or number > U32:
                    raise PgnError("invalid_move_number", at)
                yield Event("move_number", at, m.end(), m[0], number, len(text), depth)
            elif kind == "nag":
                if int(text) > U32:
                    raise PgnError("invalid_nag", at)
                yield Event("nag_numeric", at, m.end(), text, int(text), depth=depth)
            else:
                depth += kind == "open"
                name = {"brace": "comment_brace", "line": "comment_line", "open": "variation_start", "close": "variation_end", "glyph": "nag_glyph"}.get(kind, kind)
                yield Event(name, at, m.end(), text[1:] if kind == "line" else text, depth=depth)
                depth -= kind == "close"
            at = m.end()
            if kind == "outcome" and depth == 0:
                yield Event("game_end", at, at)
                break
        at = _BLANK.match(data, at).end()


def tag_value(raw: bytes) -> bytes:
    """A tag's value with its escapes undone: a backslash goes, the byte after it stays."""
    return re.sub(rb"\\(.)", rb"\1", raw, flags=re.DOTALL)


_EASY_TAG = re.compile(rb'\[([A-Za-z0-9_]+)[ \t]+"([^"]*)"')
_EASY_MOVE = re.compile(rb"(?<![^ \n.])[a-hKQRBNO][^ \n]*")


def easy_game(raw: bytes) -> tuple[list[tuple[bytes, bytes]], bytes, bytes] | None:
    """Tag pairs, text and outcome of an easy game; None for any other. The text has moves, numbers and variations, blanks for all else."""
    m = _EASY.match(raw)
    return (_EASY_TAG.findall(m[1]), _bare(m[2]), m[3]) if m else None


def _bare(text: bytes) -> bytes:
    """The text of an easy game without its comments and glyphs."""
    for sign, of in ((b"{", _BRACES), (b"$", _NAGS), (b"!", _GLYPHS), (b"?", _GLYPHS)):
        if sign in text:
            text = of.sub(b" ", text)
    return text


def mainline(text: bytes) -> bytes:
    """A bare text without its variations."""
    return _ASIDES.sub(b" ", text) if b"(" in text else text


def easy_moves(text: bytes) -> list[bytes]:
    """The mainline's moves of a bare text."""
    return _EASY_MOVE.findall(mainline(text))


def _moves(text: bytes) -> int:
    """The moves of a bare text: its words, without the numbers that stand by themselves."""
    return len(text.split()) - text.count(b". ")


def parse_game(raw: bytes, strict: bool = True, counted: bool = True) -> dict:
    """One framed game: first-wins tags, mainline moves, outcome and the first error, and the events' counts if asked for.

    Easy games, which most are, are told by one match; all others go through `events`.
    """
    m = _EASY.match(raw)
    if m is None:
        return _parse_events(raw, strict)
    pairs, text = _EASY_TAG.findall(m[1]), m[2]
    tags = {name.decode(): value for name, value in reversed(pairs)}
    if not counted:
        moves = [x.decode("utf-8", "replace") for x in easy_moves(_bare(text))]
        return {"tags": tags, "raw_tags": tags, "moves": moves, "outcome": OUTCOMES[m[3]], "error": None, "counts": None}
    counts = {"game_start": 1, "movetext_start": 1, "outcome": 1, "game_end": 1}
    bare = text
    for kind, sign, of in (("comment_brace", b"{", _BRACES), ("nag_numeric", b"$", _NAGS), ("nag_glyph", b"!", _GLYPHS), ("nag_glyph", b"?", _GLYPHS)):
        if sign in bare:
            bare, n = of.subn(b" ", bare)
            counts[kind] = n
    main, every = bare, bare
    if b"(" in bare:
        main, n = _ASIDES.subn(b" ", bare)
        counts["variation_start"] = counts["variation_end"] = n
        every = bare.replace(b"(", b" ").replace(b")", b" ")
    threes = bare.count(b"...")
    for kind, n in (("tag", len(pairs)), ("move_number", bare.count(b".") - 2 * threes), ("san", _moves(every))):
        if n:
            counts[kind] = n
    moves = [x.decode("utf-8", "replace") for x in _EASY_MOVE.findall(main)]
    return {"tags": tags, "raw_tags": tags, "moves": moves, "outcome": OUTCOMES[m[3]], "error": None, "counts": counts}


def _counted(m: re.Match) -> dict:
    return {"plies": _moves(mainline(_bare(m[2]))), "outcome": OUTCOMES[m[3]], "error": None}


def count_frame(f: Frame, strict: bool = True) -> dict:
    """As `count_game`, without looking at an easy game twice."""
    return _counted(f.easy) if f.easy else count_game(f.raw, strict)


def count_game(raw: bytes, strict: bool = True) -> dict:
    """Mainline plies, outcome and first error of a framed game, and nothing else of it."""
    m = _EASY.match(raw)
    if m:
        return _counted(m)
    g = _parse_events(raw, strict)
    return {"plies": len(g["moves"]), "outcome": g["outcome"], "error": g["error"]}


def _parse_events(raw: bytes, strict: bool) -> dict:
    """As `parse_game`, event by event. A text of blanks alone holds no game, so it lacks its outcome."""
    tags: dict[str, bytes] = {}
    raw_tags: dict[str, bytes] = {}
    moves: list[str] = []
    outcome, error, counts = None, None, {}
    try:
        for e in events(raw, strict):
            counts[e.kind] = counts.get(e.kind, 0) + 1
            if e.kind == "tag":
                name, value = e.text.split(b"\0", 1)
                if name.decode() not in tags:
                    tags[name.decode()], raw_tags[name.decode()] = tag_value(value), value
            elif e.kind == "san" and e.depth == 0:
                moves.append(e.text.decode("utf-8", "replace"))
            elif e.kind == "outcome" and e.depth == 0:
                outcome = OUTCOMES[e.text]
        if strict and not counts:
            raise PgnError("missing_outcome", len(raw))
    except PgnError as fault:
        error = {"kind": fault.kind, "offset": fault.offset}
    return {"tags": tags, "raw_tags": raw_tags, "moves": moves, "outcome": outcome, "error": error, "counts": counts}
