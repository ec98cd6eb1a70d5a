"""Byte-level BPE encoding and decoding by a finite-state transducer that is determinised while it runs.

A sequence of tokens is what rank-ordered merging makes of its bytes exactly if every token is what merging makes of the
token's own bytes and every adjacent pair is what merging makes of the pair's bytes. So each prefix of a piece has one last
token, found among the tokens that end there. Only a start from which the bytes so far still begin some token can matter
later; those starts, each with the last token before it, are the transducer's state. Tokens are emitted once all live starts
agree on them, after bounded lookahead. States and transitions are made when first needed, are shared by all pieces, and
are dropped together when there are too many of them.

Null texts count as empty; an empty text has no tokens, an empty table no rows. Very long texts are read whole. Repeated rows are encoded alike. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearthline.llm.common import small_batches, text_or_empty


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Rank-ordered merging as it is defined: the lowest-ranked adjacent pair first, the leftmost among equals."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _substrings(token: bytes) -> Iterator[bytes]:
    return (token[i:j] for i in range(len(token)) for j in range(i + 1, len(token) + 1))


class _State:
    """Where a piece stands after some bytes: the bytes from the earliest start that still matters, and for each such start
    (ascending; the last one is the present end) the last token of what leads to it."""

    __slots__ = ("data", "next", "starts")

    def __init__(self, data: bytes, starts: tuple[tuple[int, bytes], ...]) -> None:
        self.data, self.starts, self.next = data, starts, {}


class Transducer:
    """ranks: bytes of a token to its id; all single bytes must be among them. max_states, max_memo: bounds of what is kept."""

    #: Bytes of a piece after which what all live starts agree on is handed out, should no state with one start come before.
    SPAN = 4096

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_memo: int = 700_000) -> None:
        self.ranks, self.max_states, self.max_memo = ranks, max_states, max_memo
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.beginnings = {t[:n] for t in ranks for n in range(1, len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.memo: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.start = self._state(b"", ((0, b""),))

    def _state(self, data: bytes, starts: tuple) -> _State:
        found = self.states.get((data, starts))
        if found is None:
            found = self.states[data, starts] = _State(data, starts)
        return found

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for single bytes and for tokens that merging cannot make."""
        if token not in self.halves:
            below = {t: r for t in _substrings(token) if t != token and (r := self.ranks.get(t)) is not None}
            parts = merge_by_rank(token, below)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _joins(self, a: bytes, b: bytes) -> bool:
        """Whether b may follow a (empty at a piece's beginning), by going back in time from the two whole tokens: undo the
        merge that came last and see whether the parts that then met at the border would have merged first."""
        found = self.joins.get((a, b))
        if found is None:
            found = self.joins[a, b] = self._made(b) if not a else self._undisturbed(a, b)
        return found

    def _made(self, token: bytes) -> bool:
        return len(token) == 1 or self._halves(token) is not None

    def _undisturbed(self, x: bytes, y: bytes) -> bool:
        if not self._made(y):
            return False
        ranks, never = self.ranks, 1 << 60
        until = never
        while ranks.get(x + y, never) >= until:
            rank_x, rank_y = ranks[x] if len(x) > 1 else -1, ranks[y] if len(y) > 1 else -1
            if rank_x == rank_y == -1:
                return True
            if rank_x > rank_y:
                until, x = rank_x, self._halves(x)[1]
            else:  # of equal ranks the left one merges first: a border pair as low as y goes before y
                until, y = rank_y + 1, self._halves(y)[0]
        return False

    def _step(self, at: _State, byte: int) -> tuple[_State, bytes]:
        """The next state, and the last token of all bytes so far."""
        data = at.data + bytes((byte,))
        for start, last in at.starts:  # ascending: the longest token first
            token = data[start:]
            if token in self.ranks and self._joins(last, token):
                break
        else:
            raise ValueError(f"no token ends at byte {byte}: a byte without an id")
        starts = [(s, t) for s, t in at.starts if data[s:] in self.beginnings]
        starts.append((len(data), token))
        cut = starts[0][0]
        return self._state(data[cut:], tuple((s - cut, t) for s, t in starts)), token

    def encode_bytes(self, piece: bytes) -> bytes:
        """Packed little-endian unsigned 32-bit ids of one piece."""
        if piece in self.packed:
            return self.packed[piece]
        if len(piece) >= self.SPAN:
            return b"".join(self.emitted(piece))
        if len(self.states) > self.max_states or len(self.joins) > 2 * self.max_states:
            self._clear()
        at, lasts = self.start, []
        for byte in piece:
            found = at.next.get(byte)
            if found is None:
                found = at.next[byte] = self._step(at, byte)
            at, token = found
            lasts.append(token)
        packed, out, end = self.packed, [], len(lasts)
        while end:
            token = lasts[end - 1]
            out.append(packed[token])
            end -= len(token)
        out.reverse()
        return b"".join(out)

    def emitted(self, piece: bytes) -> Iterator[bytes]:
        """The packed ids of a piece, in parts, each as soon as no later byte can change it."""
        if len(self.states) > self.max_states or len(self.joins) > 2 * self.max_states:
            self._clear()
        at, lasts = self.start, []
        for byte in piece:
            found = at.next.get(byte)
            if found is None:
                found = at.next[byte] = self._step(at, byte)
                if len(self.states) > 2 * self.max_states:  # within one long piece: only the present state is kept
                    self._clear()
                    found = self._state(found[0].data, found[0].starts), found[1]
            at, token = found
            lasts.append(token)
            if len(lasts) >= self.SPAN:
                chains = [self._chain(lasts, len(lasts) - len(at.data) + s) for s, _ in at.starts]
                same = min(map(len, chains))
                for chain in chains[1:]:
                    while chain[:same] != chains[0][:same]:
                        same -= 1
                if same:
                    del lasts[: sum(map(len, chains[0][:same]))]
                    yield b"".join(map(self.packed.__getitem__, chains[0][:same]))
        yield b"".join(map(self.packed.__getitem__, self._chain(lasts, len(lasts))))

    @staticmethod
    def _chain(lasts: list[bytes], end: int) -> list[bytes]:
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= len(out[-1])
        out.reverse()
        return out

    def encode(self, pieces: list[str]) -> bytes:
        """Packed ids of a text given as its pieces; the ids of short pieces are remembered."""
        memo = self.memo
        out = list(map(memo.get, pieces))
        if None in out:
            if len(memo) > self.max_memo:
                memo.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    ids = memo.get(piece)
                    if ids is None:
                        ids = self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
                        if len(piece) <= 64:
                            memo[piece] = ids
                    out[i] = ids
        return b"".join(out)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The UTF-8 state machine. A state is how many bytes a character still needs, and between which the next must lie; None
    if the byte cannot come here."""
    need, low, high = state
    if need:
        return (need - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return WHOLE
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


WHOLE = (0, 0x80, 0xBF)


class Utf8Stream:
    """Incremental UTF-8: bytes in, text out as soon as its characters are whole. The state machine says whether the character
    at the end is whole; the bytes of one that is not are held. Bytes that cannot begin or continue one become U+FFFD."""

    def __init__(self) -> None:
        self.held, self.state = b"", WHOLE

    def push(self, data: bytes) -> str:
        data = self.held + data
        # a byte that begins a character puts the machine into a known state, so it need only run from the last such byte on
        begin = len(data)
        while begin > max(0, len(data) - 4):
            begin -= 1
            if data[begin] & 0xC0 != 0x80:
                break
        self.state = WHOLE
        for byte in data[begin:]:
            self.state = utf8_step(self.state, byte) or WHOLE
        cut = begin if self.state[0] else len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held, self.state = self.held, b"", WHOLE
        return held.decode("utf-8", "replace")


class Codec:
    """A vocabulary file of base64 tokens and ranks, with the pattern that splits texts into pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> bytes:
        return self.transducer.encode(self.split(text))

    def decoded(self, packed: bytes, chunk: int = 8192) -> Iterator[bytes]:
        """The bytes of the ids, a chunk of ids at a time."""
        ids = np.frombuffer(packed, "<u4")
        for i in range(0, len(ids), chunk):
            yield b"".join(map(self.bytes_of.__getitem__, ids[i : i + chunk].tolist()))

    def decode_text(self, packed: bytes) -> Iterator[str]:
        stream = Utf8Stream()
        for data in self.decoded(packed):
            if text := stream.push(data):
                yield text
        if text := stream.close():
            yield text


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: the id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves (array<int>).

    The ids are decoded again from what was encoded, as a stream of characters. vocabulary is a path that every executor can open."""
    small_batches(docs.sparkSession)
    slim = docs.select(docs[id_column], text_or_empty(text_column).alias("text"))

    def run(batches):
        use = codec(vocabulary, pattern)
        for batch in batches:
            counts, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = use.encode(text)
                decoded = hashlib.sha256()
                for part in use.decode_text(packed):
                    decoded.update(part.encode("utf-8"))
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(decoded.hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = slim.schema[id_column].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode_table(encoded: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """Texts of a table with an ids column, through the incremental UTF-8 decoder. Null ids count as none."""
    small_batches(encoded.sparkSession)

    def run(batches):
        use = codec(vocabulary, pattern)
        for batch in batches:
            texts = ["".join(use.decode_text(np.asarray(x or [], dtype="<u4").tobytes())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(encoded[id_column], encoded["ids"]).mapInArrow(run, f"`{id_column}` {kind}, text string")
