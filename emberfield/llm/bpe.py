"""Byte-level BPE encoding and decoding.

Encoding compiles the merge ranks into a finite-state transducer. A text piece is a correct BPE tokenisation
exactly when every token is its own tokenisation and every neighbouring pair is the tokenisation of its joined
bytes, so the transducer's paths are walks through the token trie that may return to the root, emitting a token,
where the pair with the token before is correct. The walk is nondeterministic; it is determinised lazily: a
deterministic state is the set of (pending tokens, trie node) pairs still alive, transitions are computed when a
byte first needs them and kept. Tokens that all alive paths share are emitted at once, so a token appears after a
lookahead of at most the longest token. Kept transitions and pieces are bounded and simply start anew when full.

Decoding joins the tokens' bytes chunk by chunk and runs an incremental UTF-8 state machine over them, so that
characters may span tokens and chunks.

Null texts count as empty and give no tokens. Repeated rows are encoded alike; other columns are carried along.
Ids are kept as binary, little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import codecs
import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from emberfield.llm.common import Batch, map_texts

ROOT = 0
#: Bytes up to which a piece outside the kept transitions is walked with a look back.
SHORT = 256
#: Ids decoded at a time.
CHUNK = 4096
Config = tuple[int, tuple[int, ...], int]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Lazily determinised transducer from the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 100_000) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.keep = keep
        # Trie: by node its children by byte (none: no longer token goes on from it) and its token (or -1).
        self.children: list[dict[int, int] | None] = [None]
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                if self.children[node] is None:
                    self.children[node] = {}
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.children.append(None)
                node = after
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, (), ROOT),)
        self.states: list[tuple[Config, ...]] = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _spines(self, token: int) -> tuple[list, list] | None:
        """The parts at the left and at the right end of a token while its bytes merge, each with the rank of the
        merge that makes it; None if merging its bytes does not give the token."""
        known = self.spines.get(token, False)
        if known is not False:
            return known
        raw = self.bytes_of[token]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            rank, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left.append((parts[0], rank))
            if i == len(parts) - 1:
                right.append((parts[-1], rank))
        made = self.spines[token] = (left, right) if len(parts) == 1 else None
        return made

    def _correct(self, before: int, token: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just them: no merge across their border comes first."""
        own = self._spines(token)
        if own is None:
            return False
        if before < 0:
            return True
        other = self._spines(before)
        if other is None:
            return False
        ahead, behind = other[1], own[0]
        i = j = 0
        never = len(self.ranks) + 256
        while True:
            across = self.ranks.get(ahead[i][0] + behind[j][0], never)
            grow_left = ahead[i + 1][1] if i + 1 < len(ahead) else never
            grow_right = behind[j + 1][1] if j + 1 < len(behind) else never
            # Of equal ranks the merge further left comes first.
            if across < grow_left and across <= grow_right and across != never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _step(self, configs: Iterable[Config], byte: int) -> tuple[list[Config], tuple[int, ...]]:
        """All walks that survive one more byte, and the tokens that they share and so are certain."""
        alive: list[Config] = []
        children, token_at, pairs = self.children, self.token_at, self.pairs
        ended = None
        for last, pending, node in configs:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node] is not None:
                alive.append((last, pending, node))
            if ended is None:  # every prefix has one correct tokenisation
                token = token_at[node]
                if token >= 0:
                    before = pending[-1] if pending else last
                    key = before << 20 | token
                    right = pairs.get(key)
                    if right is None:
                        right = pairs[key] = self._correct(before, token)
                    if right:
                        ended = (last, (*pending, token), ROOT)
        if ended is None:
            raise ValueError(f"no token ends at byte {byte:#04x}")
        if not alive:
            certain = ended[1]
            return [(certain[-1], (), ROOT)], certain
        alive.append(ended)
        first = alive[0][1]
        if not first:
            return alive, ()
        certain = os.path.commonprefix([pending for _, pending, _ in alive])
        if certain:
            cut, last = len(certain), certain[-1]
            alive = [(last, pending[cut:], node) for _, pending, node in alive]
        return alive, certain

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Compute, keep and return the transition: (next state, tokens that are now certain)."""
        alive, certain = self._step(self.states[state], byte)
        key = tuple(alive)
        after = self.number.get(key)
        if after is None:
            after = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.moves[state << 8 | byte] = (after, certain)
        return made

    def _walk(self, piece: bytes) -> list[int]:
        """The nondeterministic walk over a whole piece: ``ends`` holds the last token of every prefix's tokenisation."""
        children, token_at, pairs = self.children, self.token_at, self.pairs
        ends, alive = [-1], []
        for byte in piece:
            before_at = len(ends) - 1
            found, still = -2, []
            alive.append((before_at, ROOT))
            for start, node in alive:
                node = children[node].get(byte)
                if node is None:
                    continue
                if found == -2 and token_at[node] >= 0:
                    token = token_at[node]
                    key = ends[start] << 20 | token
                    right = pairs.get(key)
                    if right is None:
                        right = pairs[key] = self._correct(ends[start], token)
                    if right:
                        found = token
                if children[node] is not None:
                    still.append((start, node))
            if found == -2:
                raise ValueError(f"no token ends at byte {byte:#04x}")
            ends.append(found)
            alive = still
        out, at = [], len(piece)
        while at:
            out.append(ends[at])
            at -= len(self.bytes_of[ends[at]])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; reads every byte once, from left to right.

        Transitions met first are the common ones; once as many are kept as may be, pieces that need others are walked
        through without keeping them, as lazily determinised automata do when their tables are full. A long piece is
        walked with its tokens emitted as soon as they are certain, a short one with a look back from its end.
        """
        if len(self.pairs) >= 4 * self.keep:
            self.pairs.clear()
        out: list[int] = []
        moves, room = self.moves, self.keep - len(self.moves)
        state, configs = 0, None
        for byte in piece:
            if configs is None:
                move = moves.get(state << 8 | byte)
                if move is None and room > 0:
                    move = self._move(state, byte)
                if move is not None:
                    state, certain = move
                    if certain:
                        out += certain
                    continue
                if len(piece) <= SHORT:
                    return self._walk(piece)
                configs = self.states[state]
            configs, certain = self._step(configs, byte)
            if certain:
                out += certain
        for _, pending, node in self.states[state] if configs is None else configs:
            if node == ROOT:
                out += pending
        return out


class PieceIds(dict):
    """Piece text to its ids in little-endian bytes; filled by the transducer, started anew when full."""

    def __init__(self, transducer: Transducer, keep: int = 800_000) -> None:
        super().__init__()
        self.transducer = transducer
        self.keep = keep

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.transducer.ranks.get(raw)
        ids = [whole] if whole is not None else self.transducer.encode(raw)
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = packed
        return packed


class ChunkIds(dict):
    """Text between two single spaces, with the space before it, to its ids. ``public_tokenizers.PATTERN`` never
    matches across such a space, so the chunk's pieces do not depend on what surrounds it."""

    def __init__(self, ids: PieceIds, pieces: Callable[[str], list[str]], keep: int = 500_000) -> None:
        super().__init__()
        self.ids_of, self.pieces, self.keep = ids.__getitem__, pieces, keep

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.ids_of, self.pieces(" " + chunk)))
        if len(chunk) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[chunk] = packed
        return packed


class Encoder:
    """Ids of whole texts under one pattern."""

    def __init__(self, ids: PieceIds, pattern: str) -> None:
        self.ids_of = ids.__getitem__
        self.pieces = regex.compile(pattern).findall
        self.chunks = ChunkIds(ids, self.pieces).__getitem__ if pattern == public_tokenizers.PATTERN else None
        self.wide_space = re.compile(r"\s\s").search

    def __call__(self, text: str) -> bytes:
        if self.chunks is None or self.wide_space(text):
            return b"".join(map(self.ids_of, self.pieces(text)))
        first, *rest = text.split(" ")
        return b"".join((*map(self.ids_of, self.pieces(first)), *map(self.chunks, rest)))


_RANKS: dict[str, dict[bytes, int]] = {}
_PIECES: dict[str, PieceIds] = {}
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _ranks(path: str) -> dict[bytes, int]:
    if path not in _RANKS:
        _RANKS[path] = load_ranks(path)
    return _RANKS[path]


def _encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary and pattern, once per worker process."""
    if path not in _PIECES:
        gc.disable()  # tables of tuples without cycles; walking them over and over doubles the time
        _PIECES[path] = PieceIds(Transducer(_ranks(path)))
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(_PIECES[path], pattern)
    return _ENCODERS[path, pattern]


def _decoder(path: str, chunk: int) -> Callable[[bytes], str]:
    bytes_of = {rank: token for token, rank in _ranks(path).items()}

    def decode(raw: bytes | None) -> str:
        own = np.frombuffer(raw or b"", "<u4")
        return "".join(stream_decode((own[at : at + chunk] for at in range(0, len(own), chunk)), bytes_of))

    return decode


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns, and ``ids`` (binary, little-endian u32) and ``n_tokens``: every match of ``pattern`` by itself."""

    def factory():
        encode = _encoder(path, pattern)

        def run(batch: Batch) -> dict:
            ids = [encode(t) if t else b"" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

        return run

    return map_texts(df, text, factory, "ids binary, n_tokens bigint")


def stream_decode(chunks: Iterable[np.ndarray], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of id chunks; bytes of a character that is not complete yet wait in the state machine."""
    machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
    for chunk in chunks:
        yield machine.decode(b"".join(map(bytes_of.__getitem__, chunk.tolist())))
    yield machine.decode(b"", final=True)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """All columns and ``decoded``, the text of the ids; null ids decode to the empty text."""

    def factory():
        decode = _decoder(path, chunk)

        def run(batch: Batch) -> dict:
            return {"decoded": [decode(raw) for raw in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

        return run

    return map_texts(df, ids, factory, "decoded string")


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass, so that one worker process holds one set of tables."""

    def factory():
        encode, decode = _encoder(path, pattern), _decoder(path, chunk)

        def run(batch: Batch) -> dict:
            ids = [encode(t) if t else b"" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": list(map(decode, ids))}

        return run

    return map_texts(df, text, factory, "ids binary, n_tokens bigint, decoded string")
