"""Chess rules for many games at once: bitboards as numpy words, advanced ply by ply.

The lines of a batch form a trie: at each ply the games that agree so far are one node, and a node is one column of the
arrays. A move is looked up in a table of parsed notations, resolved against the attacks of its target square, and tested for
its own king's safety, all as operations on whole arrays. Moves, faults and keys are those of `board.Board`; a line stops at its first
fault, whose name is kept. A claimed mate is looked into by the board, as is a start that is no position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

from . import board as B

U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)
_KINDS = "PNBRQK"
#: Order of the boards within the key's pieces: white P N B R Q K, then black in the key's order.
_PLACES = np.array([B._KEY_PIECES.index(c) for c in _KINDS + _KINDS.lower()])
_P, _N, _BI, _R, _Q, _K, _SHORT, _LONG, _BAD = range(9)
_ILLEGAL, _AMBIGUOUS, _SUFFIX = "illegal_move", "ambiguous_move", "invalid_check_suffix"


def _bits(squares) -> int:
    out = 0
    for s in squares:
        out |= 1 << s
    return out


@cache
def _tables() -> dict[str, np.ndarray]:
    """Squares that each square sees: steps of knights, kings and pawns, and lines by the occupancy of a rank, file or diagonal."""
    words = lambda rows: np.array(rows, dtype=U)
    t = {name: words([_bits(r[0] for r in B._REACH[name][s]) for s in range(64)]) for name in "NK"}
    t["pawn_from"] = words([[_bits(r[0] for r in B._PAWN_FROM[white][s]) for s in range(64)] for white in (True, False)])
    lines = np.zeros((4, 64, 256), dtype=U)
    masks = np.zeros((2, 64), dtype=U)
    for line, steps in enumerate((((0, 1), (0, -1)), ((1, 0), (-1, 0)), ((1, 1), (-1, -1)), ((1, -1), (-1, 1)))):
        for s in range(64):
            rays = []
            for dx, dy in steps:
                x, y, ray = s % 8 + dx, s // 8 + dy, []
                while 0 <= x < 8 and 0 <= y < 8:
                    ray.append(y * 8 + x)
                    x, y = x + dx, y + dy
                rays.append(ray)
            if line >= 2:
                masks[line - 2, s] = _bits(sum(rays, []))
            index = np.arange(256)
            for ray in rays:
                free = np.ones(256, bool)
                for q in ray:
                    lines[line, s] |= np.where(free, _ONE << U(q), U(0))
                    free &= (index >> (q // 8 if line == 0 else q % 8)) & 1 == 0
    t["lines"], t["masks"] = lines, masks
    t["bit"] = words([1 << s for s in range(64)] + [0])
    t["file"] = words([_bits(range(f, 64, 8)) for f in range(8)] + [int(_ALL)])
    t["rank"] = words([0xFF << (8 * r) for r in range(8)] + [int(_ALL)])
    corner = np.zeros(65, dtype=np.uint8)
    for s, right in B._CORNER_RIGHTS.items():
        corner[s] = B._CASTLING[right]
    t["corner"] = corner
    return t


_FILES, _SPREAD, _GATHER = U(0x0101010101010101), U(0x0102040810204080), U(0x0101010101010101)


def _rook(square: np.ndarray, taken: np.ndarray) -> np.ndarray:
    lines = _tables()["lines"]
    by_file = (((taken >> (square & 7).astype(U)) & _FILES) * _SPREAD) >> U(56)
    by_rank = (taken >> (square & 56).astype(U)) & U(255)
    return lines[0, square, by_file] | lines[1, square, by_rank]


def _bishop(square: np.ndarray, taken: np.ndarray) -> np.ndarray:
    t = _tables()
    lines, masks = t["lines"], t["masks"]
    one = ((taken & masks[0, square]) * _GATHER) >> U(56)
    two = ((taken & masks[1, square]) * _GATHER) >> U(56)
    return lines[2, square, one] | lines[3, square, two]


def _square(bit: np.ndarray) -> np.ndarray:
    """The square of words of one bit."""
    return np.bitwise_count(bit - _ONE).astype(np.int64)


def notations(sans: Sequence[str]) -> tuple[np.ndarray, list[str | None]]:
    """Moves parsed: kind, target, hints, captures, promotion, claimed check; and the fault of those that are none."""
    rows, faults = np.zeros((len(sans), 7), dtype=np.int64), []
    for n, san in enumerate(sans):
        fault, row = None, (_BAD, 0, 8, 8, 0, 0, 0)
        try:
            body, check = B._split_check(san)
            claim = {"": 0, "+": 1, "#": 2}[check]
            if body in ("O-O", "0-0", "O-O-O", "0-0-0"):
                row = (_SHORT if len(body) == 3 else _LONG, 0, 8, 8, 0, 0, claim)
            else:
                kind, file, rank, takes, to, promotion = B._parse_san(body)
                row = (_KINDS.index(kind), to, 8 if file is None else file, 8 if rank is None else rank, int(takes), _KINDS.index(promotion) if promotion else 0, claim)
        except B.SanError as error:
            fault = str(error)
        rows[n] = row
        faults.append(fault)
    return rows, faults


class Boards:
    """The positions of a batch's nodes at one ply."""

    __slots__ = ("pieces", "black", "rights", "ep", "half", "full")

    def __init__(self, pieces: np.ndarray, black: np.ndarray, rights: np.ndarray, ep: np.ndarray, half: np.ndarray, full: np.ndarray):
        self.pieces, self.black, self.rights, self.ep, self.half, self.full = pieces, black, rights, ep, half, full

    @classmethod
    def of(cls, boards: Sequence[B.Board]) -> Boards:
        pieces = np.zeros((12, len(boards)), dtype=U)
        for i, b in enumerate(boards):
            for square, c in enumerate(b.cells):
                if c != ".":
                    pieces[_KINDS.index(c.upper()) + (0 if c.isupper() else 6), i] |= _ONE << U(square)
        return cls(pieces, np.array([not b.white for b in boards]), np.array([sum(B._CASTLING[c] for c in b.rights) for b in boards], dtype=np.uint8), np.array([64 if b.ep is None else b.ep for b in boards], dtype=np.int64), np.array([b.half for b in boards], dtype=np.int64), np.array([b.full for b in boards], dtype=np.int64))

    def take(self, at: np.ndarray) -> Boards:
        return Boards(self.pieces[:, at], self.black[at], self.rights[at], self.ep[at], self.half[at], self.full[at])

    def board(self, i: int) -> B.Board:
        """One of them as a board."""
        out = B.Board.__new__(B.Board)
        out.cells = ["."] * 64
        for k in range(12):
            word = int(self.pieces[k, i])
            while word:
                low = word & -word
                out.cells[low.bit_length() - 1] = (_KINDS + _KINDS.lower())[k]
                word ^= low
        out.white, out.rights = not self.black[i], "".join(c for c in "KQkq" if int(self.rights[i]) & B._CASTLING[c])
        out.ep, out.half, out.full = None if self.ep[i] == 64 else int(self.ep[i]), int(self.half[i]), int(self.full[i])
        return out

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """The six boards of the side to move and of the other."""
        white, black = self.pieces[:6], self.pieces[6:]
        return np.where(self.black, black, white), np.where(self.black, white, black)

    def texts(self) -> tuple[list[str], list[str]]:
        """The 64 squares of each position as characters, and its FEN."""
        cells = np.full((len(self.black), 64), ord("."), dtype=np.uint8)
        squares = np.arange(64, dtype=np.uint64)
        for k, letter in enumerate(_KINDS + _KINDS.lower()):
            cells[(self.pieces[k][:, None] >> squares) & _ONE == _ONE] = ord(letter)
        boards = [row.tobytes().decode() for row in cells]
        fens = []
        for board, black, rights, ep, half, full in zip(boards, self.black.tolist(), self.rights.tolist(), self.ep.tolist(), self.half.tolist(), self.full.tolist()):
            placement = "/".join(board[r : r + 8] for r in range(56, -1, -8))
            if "." in placement:
                for n in range(8, 0, -1):
                    placement = placement.replace("." * n, str(n))
            castling = "".join(c for c in "KQkq" if rights & B._CASTLING[c])
            fens.append(f"{placement} {'b' if black else 'w'} {castling or '-'} {'-' if ep == 64 else B.SQUARES[ep]} {half} {full}")
        return boards, fens

    def keys(self) -> np.ndarray:
        """The two words of each position's key."""
        n = len(self.black)
        own, other = self.sides()
        ep = self.ep.copy()
        maybe = np.flatnonzero(ep < 64)
        if len(maybe):
            part = self.take(maybe)
            ep[maybe[~_ep_usable(part, own[:, maybe], other[:, maybe])]] = 64
        order = np.empty_like(self.pieces)
        order[_PLACES] = self.pieces
        data = np.empty((99, n), dtype=np.uint8)
        data[:96] = np.ascontiguousarray(order).view(np.uint8).reshape(12, n, 8).transpose(0, 2, 1).reshape(96, n)
        data[96], data[97], data[98] = self.black, self.rights, ep
        first, second = np.full(n, B._OFFSETS[0], dtype=U), np.full(n, B._OFFSETS[1], dtype=U)
        prime = U(B._PRIME)
        for row in data:
            np.bitwise_xor(first, row, out=first)
            np.multiply(first, prime, out=first)
            np.multiply(second, prime, out=second)
            np.bitwise_xor(second, row, out=second)
        return np.stack([first, second], axis=1)


def _attacked(square: np.ndarray, by: np.ndarray, by_black: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Whether squares are attacked by the six boards of a side, with the squares `taken` by any piece."""
    t = _tables()
    out = (t["N"][square] & by[_N]) | (t["K"][square] & by[_K]) | (t["pawn_from"][by_black.astype(np.int64), square] & by[_P])
    lines, diagonals = by[_R] | by[_Q], by[_BI] | by[_Q]
    return (out | (_rook(square, taken) & lines) | (_bishop(square, taken) & diagonals)) != 0


def _safe(own: np.ndarray, other: np.ndarray, black: np.ndarray, kind: np.ndarray, a: np.ndarray, to: np.ndarray, by_ep: np.ndarray) -> np.ndarray:
    """Whether the side to move is not in check after its piece of a kind goes from a to `to`."""
    bit = _tables()["bit"]
    gone = bit[np.where(by_ep, np.where(black, to + 8, to - 8) & 63, 64)]
    left = ~(bit[to] | gone)
    every = np.bitwise_or.reduce(own, axis=0) | np.bitwise_or.reduce(other, axis=0)
    taken = ((every & ~gone) & ~bit[a]) | bit[to]
    king = np.where(kind == _K, to, _square(own[_K]))
    return ~_attacked(king, other & left, ~black, taken)


def _ep_usable(b: Boards, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a pawn of the side to move may take on the en-passant square."""
    t = _tables()
    every = np.bitwise_or.reduce(b.pieces, axis=0)
    from_ = np.where((every & t["bit"][b.ep]) == 0, t["pawn_from"][b.black.astype(np.int64), b.ep] & own[_P], U(0))
    out = np.zeros(len(b.ep), bool)
    while True:
        at = np.flatnonzero((from_ != 0) & ~out)
        if not len(at):
            return out
        low = from_[at] & (~from_[at] + _ONE)
        out[at] = _safe(own[:, at], other[:, at], b.black[at], np.full(len(at), _P), _square(low), b.ep[at], np.ones(len(at), bool))
        from_[at] ^= low


def _castle(b: Boards, own: np.ndarray, other: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(allowed, from, to) of castling moves, of which `kind` tells the wing."""
    n = len(kind)
    fine, a, to = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.bitwise_or.reduce(b.pieces, axis=0)
    for (white, name), (right, king, king_to, rook, _, empty, calm) in B._CASTLES.items():
        at = np.flatnonzero((kind == (_SHORT if name == "O-O" else _LONG)) & (b.black != white))
        if not len(at):
            continue
        a[at], to[at] = king, king_to
        good = ((b.rights[at] & B._CASTLING[right]) != 0) & ((own[_K, at] >> U(king)) & _ONE == _ONE) & ((own[_R, at] >> U(rook)) & _ONE == _ONE) & ((every[at] & U(_bits(empty))) == 0)
        at = at[good]
        for s in calm:
            if len(at):
                at = at[~_attacked(np.full(len(at), s), other[:, at], ~b.black[at], every[at])]
        fine[at] = True
    return fine, a, to


def _seen(b_kind: np.ndarray, square: np.ndarray, every: np.ndarray) -> np.ndarray:
    """What pieces (no pawns) of a kind see from squares."""
    t, out = _tables(), np.zeros(len(square), dtype=U)
    for k in (_N, _BI, _R, _Q, _K):
        at = np.flatnonzero(b_kind == k)
        if len(at):
            s = square[at]
            out[at] = t["NK"[k == _K]][s] if k in (_N, _K) else (_bishop(s, every[at]) if k in (_BI, _Q) else U(0)) | (_rook(s, every[at]) if k in (_R, _Q) else U(0))
    return out


def play(b: Boards, moves: np.ndarray) -> tuple[Boards, np.ndarray, np.ndarray, np.ndarray]:
    """The positions after a move each (rows of `notations`), codes of faults, and from and to of the moves.

    Faults are 0 none, 1 no move, 2 illegal, 3 ambiguous, 4 wrong check suffix.
    """
    t = _tables()
    bit = t["bit"]
    kind, to, file, rank, takes, promotion, claim = moves.T
    n, black = len(kind), b.black
    side = black.astype(np.int64)
    own, other = b.sides()
    ours, theirs = np.bitwise_or.reduce(own, axis=0), np.bitwise_or.reduce(other, axis=0)
    every = ours | theirs
    target = bit[to]
    captures = (theirs & target) != 0
    fault = np.where(kind == _BAD, 1, 0)
    castles = (kind == _SHORT) | (kind == _LONG)

    seen = _seen(kind, to, every)
    pawn = kind == _P
    seen = np.where(~pawn & ((takes == 1) != captures), U(0), seen)
    if pawn.any():
        one = np.where(black, to + 8, to - 8)
        fits = (one >= 0) & (one < 64)
        step = bit[np.where(fits, one, 64)]
        home = to // 8 == np.where(black, 4, 3)
        two = bit[np.where(home & fits & ((every & step) == 0), np.where(black, to + 16, to - 16), 64)]
        push = np.where(captures, U(0), step | two)
        take = np.where(captures | (to == b.ep), t["pawn_from"][side, to], U(0))
        seen = np.where(pawn, np.where(takes == 1, take, push), seen)
    mine = own[np.minimum(kind, _K), np.arange(n)]
    found = np.where(castles | (fault > 0) | ((ours & target) != 0), U(0), seen & mine & t["file"][file] & t["rank"][rank])
    by_ep = pawn & (takes == 1) & ~captures
    a, fine = np.zeros(n, np.int64), np.zeros(n, np.int64)
    while True:
        at = np.flatnonzero(found)
        if not len(at):
            break
        low = found[at] & (~found[at] + _ONE)
        from_ = _square(low)
        whole = len(at) == n
        good = _safe(own if whole else own[:, at], other if whole else other[:, at], black[at], kind[at], from_, to[at], by_ep[at])
        fine[at] += good
        a[at] = np.where(good, from_, a[at])
        found[at] ^= low
    if castles.any():
        at = np.flatnonzero(castles)
        good, c_from, c_to = _castle(b.take(at), own[:, at], other[:, at], kind[at])
        fine[at], a[at] = good, c_from
        to = to.copy()
        to[at] = c_to
        target = bit[to]
    fault = np.where((fault == 0) & (fine == 0), 2, np.where((fault == 0) & (fine > 1), 3, fault))

    # the moves as if all were right; those with a fault go
    piece = np.where(castles, _K, np.minimum(kind, _K))
    lost_rook = (other[_R] & target) != 0
    gone = target | bit[np.where(by_ep, np.where(black, to + 8, to - 8) & 63, 64)]
    other_after = other & ~gone
    own_after = own & ~(bit[a] | np.where(by_ep, gone, U(0)))
    own_after[np.where(promotion > 0, promotion, piece), np.arange(n)] |= target
    if castles.any():
        at = np.flatnonzero(castles)
        for (white, name), (_, _, _, rook, rook_to, _, _) in B._CASTLES.items():
            which = at[(kind[at] == (_SHORT if name == "O-O" else _LONG)) & (black[at] != white)]
            own_after[_R, which] = (own_after[_R, which] & ~bit[rook]) | bit[rook_to]
    of_us, of_them = np.where(black, 12, 3).astype(np.uint8), np.where(black, 3, 12).astype(np.uint8)
    lost = np.where(piece == _K, of_us, 0) | np.where(piece == _R, t["corner"][a] & of_us, 0) | np.where(lost_rook, t["corner"][to] & of_them, 0)
    ep = np.where(pawn & (np.abs(a - to) == 16), (a + to) // 2, 64)
    after = Boards(np.where(black, np.concatenate([other_after, own_after]), np.concatenate([own_after, other_after])), ~black, b.rights & ~lost.astype(np.uint8), ep, np.where(pawn | (captures & ~castles), 0, np.minimum(b.half + 1, 65535)), np.where(black, np.minimum(b.full + 1, 65535), b.full))
    at = np.flatnonzero((claim > 0) & (fault == 0))
    if len(at):
        part = own_after[:, at]
        taken = np.bitwise_or.reduce(part, axis=0) | np.bitwise_or.reduce(other_after[:, at], axis=0)
        check = _attacked(_square(other_after[_K, at]), part, black[at], taken)
        fault[at[~check]] = 4
        for i in at[check & (claim[at] == 2)]:
            if after.board(int(i)).legal_moves():
                fault[i] = 4
    return after, fault, a, to


def told(b: Boards, after: Boards, kind: np.ndarray, promotion: np.ndarray, a: np.ndarray, to: np.ndarray) -> tuple[list[str], list[str]]:
    """The moves that led from positions to others, in standard notation with as few hints as they need, and in coordinates."""
    own, other = b.sides()
    every = np.bitwise_or.reduce(b.pieces, axis=0)
    bit, n = _tables()["bit"], len(kind)
    takes = ((every & bit[to]) != 0) | ((kind == _P) & (a % 8 != to % 8))
    rivals = np.where((kind > _P) & (kind < _K), _seen(kind, to, every) & own[np.minimum(kind, _K), np.arange(n)] & ~bit[a], U(0))
    others: dict[int, list[int]] = {}
    while True:
        at = np.flatnonzero(rivals)
        if not len(at):
            break
        low = rivals[at] & (~rivals[at] + _ONE)
        from_ = _square(low)
        good = _safe(own[:, at], other[:, at], b.black[at], kind[at], from_, to[at], np.zeros(len(at), bool))
        for i, square in zip(at[good].tolist(), from_[good].tolist()):
            others.setdefault(i, []).append(square)
        rivals[at] ^= low
    now, then = after.sides()
    check = _attacked(_square(now[_K]), then, ~after.black, np.bitwise_or.reduce(after.pieces, axis=0))
    sans, ucis = [], []
    for i, (k, p, x, y, take, in_check) in enumerate(zip(kind.tolist(), promotion.tolist(), a.tolist(), to.tolist(), takes.tolist(), check.tolist())):
        start, end = B.SQUARES[x], B.SQUARES[y]
        if k in (_SHORT, _LONG):
            text = "O-O" if k == _SHORT else "O-O-O"
        elif k == _P:
            text = (start[0] + "x" if take else "") + end + ("=" + _KINDS[p] if p else "")
        else:
            hint = ""
            if i in others:
                hint = start[0] if all(s % 8 != x % 8 for s in others[i]) else start[1] if all(s // 8 != x // 8 for s in others[i]) else start
            text = _KINDS[k] + hint + ("x" if take else "") + end
        if in_check:
            text += "+" if after.board(i).legal_moves() else "#"
        sans.append(text)
        ucis.append(start + end + (_KINDS[p].lower() if p else ""))
    return sans, ucis


def starts(fens: Sequence[str]) -> tuple[list[B.Board | None], list[str | None]]:
    """The boards of distinct starts ("" is the usual one), and what is wrong with those that are none."""
    boards: list[B.Board | None] = []
    errors: list[str | None] = []
    for fen in fens:
        try:
            boards.append(B.Board(fen or None))
            errors.append(None)
        except B.FenError as error:
            boards.append(None)
            errors.append(str(error))
    return boards, errors


class Replay:
    """A batch of lines and what became of each: `done` plies played, `error` of the next, or of the start.

    A line is its start ("" is the usual one) and `sizes` moves, which are numbers of `names`, line after line in `sans`.
    """

    def __init__(self, fens: Sequence[str], sizes: np.ndarray, sans: np.ndarray, names: Sequence[str]):
        self.sizes, self.sans = sizes, sans
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.table, self.faults = notations(names)
        known: dict[str, int] = {}
        self.start = np.array([known.setdefault(f, len(known)) for f in fens], dtype=np.int64)
        self.boards, fen_errors = starts(list(known))
        self.done = np.zeros(len(fens), dtype=np.int64)
        self.error: list[str | None] = [None if fen_errors[s] is None else f"invalid_fen:{fen_errors[s]}" for s in self.start]

    @classmethod
    def of(cls, lines: Sequence[tuple[str, Sequence[str]]]) -> Replay:
        """Lines as (start, moves)."""
        known: dict[str, int] = {}
        sans = [known.setdefault(m, len(known)) for _, own in lines for m in own]
        return cls([f for f, _ in lines], np.array([len(m) for _, m in lines], dtype=np.int64), np.array(sans, dtype=np.int64), list(known))

    @classmethod
    def of_arrow(cls, fens: Sequence[str], moves) -> Replay:
        """Lines whose moves are a list column of texts without nulls."""
        import pyarrow.compute as pc

        flat = moves.flatten().dictionary_encode()
        sizes = pc.list_value_length(moves).to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(fens, sizes, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist())

    def resolved(self, before: Boards, rows: np.ndarray) -> np.ndarray:
        """The rows of `notations` of moves told from positions."""
        return rows

    def plies(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, Boards]]:
        """Ply by ply: its number, the games that reach it, the node of each, and the positions of the nodes.

        Who asks for the next ply may send an array of the games that need not go on.
        """
        good = [i for i, b in enumerate(self.boards) if b is not None]
        if not good:
            return
        place = np.full(len(self.boards), -1)
        place[good] = np.arange(len(good))
        games = np.flatnonzero(place[self.start] >= 0)
        node = place[self.start[games]]
        here = Boards.of([self.boards[i] for i in good])
        ply, table = 0, self.table
        many = len(table)
        while len(games):
            stop = yield ply, games, node, here
            go = self.sizes[games] > ply
            if stop is not None:
                go &= ~np.isin(games, stop)
            games, node = games[go], node[go]
            if not len(games):
                return
            named, back = np.unique(node * many + self.sans[self.first[games] + ply], return_inverse=True)
            before = here.take(named // many)
            moves = self.resolved(before, table[named % many])
            here, fault, a, to = play(before, moves)
            ply += 1
            wrong = fault[back] > 0
            for g, f in zip(games[wrong].tolist(), fault[back][wrong].tolist()):
                self.error[g] = (None, self.faults[self.sans[self.first[g] + ply - 1]], _ILLEGAL, _AMBIGUOUS, _SUFFIX)[f]
            fine = np.flatnonzero(fault == 0)
            at = np.full(len(fault), -1)
            at[fine] = np.arange(len(fine))
            games, node = games[~wrong], at[back[~wrong]]
            if len(fine) < len(fault):
                here = here.take(fine)
            self.done[games] = ply
            self.last = before, fine, moves, a, to


    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys (two words) of all positions that the lines reach, line by line in the order of plies, and how many each line has."""
        parts = [(games, ply, here.keys()[node]) for ply, games, node, here in self.plies()]
        counts = np.zeros(len(self.sizes), dtype=np.int64)
        for games, _, _ in parts:
            counts[games] += 1
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros((int(offsets[-1]), 2), dtype=U)
        for games, ply, keys in parts:
            out[offsets[games] + ply] = keys
        return out, counts

    def first_plies(self, key: bytes) -> np.ndarray:
        """The first ply at which each line has the position of a key; -1 where it never has. Lines that had it go no further."""
        wanted = np.frombuffer(key, dtype="<u8")
        out = np.full(len(self.sizes), -1, dtype=np.int64)
        run, stop = self.plies(), None
        while True:
            try:
                ply, games, node, here = run.send(stop)
            except StopIteration:
                return out
            stop = games[(here.keys() == wanted).all(axis=1)[node]]
            out[stop] = ply

    def steps(self, positions: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, list]]]:
        """Ply by ply: its number, the games that reach it, the node of each, and of the nodes san and uci of the move and, if wanted, board, fen and position_key."""
        for ply, games, node, here in self.plies():
            own: dict[str, list] = {"san": [None] * len(here.black), "uci": [None] * len(here.black)}
            if ply:
                before, fine, moves, a, to = self.last
                moves = moves[fine]
                own["san"], own["uci"] = told(before.take(fine), here, moves[:, 0], moves[:, 5], a[fine], to[fine])
            if positions:
                own["board"], own["fen"] = here.texts()
                own["position_key"] = [k.tobytes() for k in here.keys().astype("<u8")]
            yield ply, games, node, own

    def finish(self) -> Replay:
        """Play all lines to their ends, without keys."""
        for _ in self.plies():
            pass
        return self


def coordinates(texts: Sequence[str]) -> np.ndarray:
    """Moves in coordinates: from, to and promotion; from 64 for what is none."""
    rows = np.zeros((len(texts), 3), dtype=np.int64)
    for n, text in enumerate(texts):
        a, to = B.SQUARE_OF.get(text[:2]), B.SQUARE_OF.get(text[2:4])
        if a is None or to is None or text[4:] not in ("", *"qrbn"):
            a, to, text = 64, 0, ""
        rows[n] = a, to, _KINDS.index(text[4].upper()) if text[4:] else 0
    return rows


class Coordinates(Replay):
    """A batch of lines whose moves are given in coordinates; what can't be played is an illegal move."""

    def __init__(self, fens: Sequence[str], sizes: np.ndarray, sans: np.ndarray, names: Sequence[str]):
        super().__init__(fens, sizes, sans, [])
        self.table, self.faults = coordinates(names), [_ILLEGAL] * len(names)

    def resolved(self, before: Boards, rows: np.ndarray) -> np.ndarray:
        bit = _tables()["bit"]
        a, to, promotion = rows.T
        own, other = before.sides()
        holds = (own & bit[a]) != 0
        kind = np.where(holds.any(axis=0), np.argmax(holds, axis=0), _BAD)
        pawn = kind == _P
        kind = np.where((promotion > 0) == (pawn & ((to // 8 == 0) | (to // 8 == 7))), kind, _BAD)
        takes = np.where(pawn, a % 8 != to % 8, (np.bitwise_or.reduce(other, axis=0) & bit[to]) != 0)
        for (white, name), (_, king, king_to, *_rest) in B._CASTLES.items():
            kind = np.where((kind == _K) & (before.black != white) & (a == king) & (to == king_to), _SHORT if name == "O-O" else _LONG, kind)
        return np.stack([kind, to, a % 8, np.minimum(a // 8, 7), takes.astype(np.int64), promotion, np.zeros(len(to), np.int64)], axis=1)

    def lines(self) -> tuple[list[list[str]], list[list[str]]]:
        """Notations of the moves of every line and the FENs of its positions, as far as it can be played."""
        sans, fens = [[] for _ in self.sizes], [[] for _ in self.sizes]
        for ply, games, node, here in self.plies():
            own = here.texts()[1]
            names = None
            if ply:
                before, fine, moves, a, to = self.last
                moves = moves[fine]
                names = told(before.take(fine), here, moves[:, 0], moves[:, 5], a[fine], to[fine])[0]
            for g, k in zip(games.tolist(), node.tolist()):
                fens[g].append(own[k])
                if names is not None:
                    sans[g].append(names[k])
        return sans, fens
