"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (an identity with a space in front; spaces become U+2581) and cut where no merge can
reach: before a space that follows another character, if no piece of the vocabulary holds such a pair, and within these segments
between characters that stand next to each other in no piece. What is left is merged by an agenda of adjacent symbol pairs: the
pair whose joined piece has the highest score goes first, of equal scores the leftmost, and each merge enters the pairs with its
new neighbours. Symbols that are no piece fall back to bytes.

Segments repeat, so their ids are remembered (a bounded number of them). Those that an Arrow batch brings for the first time are
encoded by the sentencepiece library too, in one call, and a difference ends the job with an error; with whole=True the library
also encodes every whole text. Decoding is the library's own.

Null and empty texts have no ids and decode to an empty text. Null ids, repeated rows and other columns pass as they are: one
row goes out for each that comes in. Very long texts are encoded whole; a segment without any space is one agenda, of time
n log n. A U+2581 in a text counts as a space, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearthline.llm.common import small_batches, text_or_empty

SPACE = "▁"
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Segments longer than this are not remembered.
LONG = 200


class Memo:
    """What is known of strings: up to size of those met lately, twice as many for a while. Long ones are not kept."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old, self.long = size, {}, {}, []

    def of(self, keys: set[str], make) -> dict:
        """A dictionary that has all keys; make(list of keys) gives what is missing. Valid until the next call."""
        while self.long:
            self.new.pop(self.long.pop(), None)
        missing = [k for k in keys if k not in self.new]
        if len(self.new) + len(missing) > self.size:
            self.old, self.new = self.new, {}
            missing = list(keys)
        if missing:
            old = self.old
            self.new.update((k, old[k]) for k in missing if k in old)
            if fresh := [k for k in missing if k not in old]:
                self.new.update(make(fresh))
                self.long = [k for k in fresh if len(k) > LONG]
        return self.new


class Pieces:
    """A vocabulary and its agenda. max_memo bounds how many segments, and parts of them, are remembered."""

    def __init__(self, path: str, max_memo: int = 300_000) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        probe = " a  ﬁ½　é "
        if any(map(self.library.is_unused, ids)) or self.library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only vocabularies without unused pieces, whose normaliser keeps texts and adds a space, are supported")
        self.texts = [self.library.id_to_piece(i) for i in ids]
        special = [self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) for i in ids]
        self.ids = {self.texts[i]: i for i in ids if not special[i]}
        scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Lower goes first; pieces of one score share a rank.
        self.ranks = {p: place[s] for p, s in scores.items() if len(p) > 1}
        self.pairs = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        self.cut_at_spaces = not any(pair[1] == SPACE != pair[0] for pair in self.pairs)
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if self.library.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary lacks pieces for bytes")
        letters = sorted(set("".join(self.pairs)))
        if any(ord(c) > 0xFFFF for c in letters):
            raise ValueError("pieces with characters beyond the basic plane are not supported")
        #: The number of each character that some piece joins with another (0: of none), and which numbers are joined.
        self.number = np.zeros(1 << 16, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x, y in self.pairs:
            self.joined[self.number[ord(x)], self.number[ord(y)]] = True
        self.parts, self.memo = Memo(max_memo), Memo(max_memo)

    def merged(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of a text."""
        symbols, ranks = list(text), self.ranks.get
        n = len(symbols)
        agenda = [(rank, i, i + 1, p) for i in range(n - 1) if (rank := ranks(p := text[i : i + 2])) is not None]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, piece = heappop(agenda)
            if not (left := symbols[i]) or left + symbols[j] != piece:
                continue  # one of both has been merged since
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks(wider := piece + symbols[k])) is not None:
                    heappush(agenda, (rank, i, k, wider))
            h = before[i]
            if h >= 0 and (rank := ranks(wider := symbols[h] + piece)) is not None:
                heappush(agenda, (rank, h, i, wider))
        return [s for s in symbols if s]

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.ids.get
        out = [ids(symbol) for symbol in self.merged(part)]
        if None in out:
            out = []
            for symbol in self.merged(part):
                piece = ids(symbol)
                out += [piece] if piece is not None else [self.bytes[b] for b in symbol.encode()]
        return tuple(out)

    def _cut(self, segments: list[str]) -> list[list[str]]:
        """The segments, each cut between characters that no piece joins."""
        text = "".join(segments)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        numbers = self.number[np.where(codes > 0xFFFF, 0, codes)]
        cut = np.concatenate(([True], ~self.joined[numbers[:-1], numbers[1:]])) if len(numbers) else np.zeros(0, bool)
        starts = np.cumsum([0, *map(len, segments)])
        cut[starts[:-1]] = True
        cuts = np.flatnonzero(cut)
        of = np.searchsorted(cuts, starts).tolist()
        cuts = [*cuts.tolist(), len(text)]
        parts = [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return [parts[i:j] for i, j in zip(of, of[1:], strict=False)]

    def _segments(self, fresh: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of segments, by the agenda; checked against the library."""
        cut = self._cut(fresh)
        parts = self.parts.of(set(chain.from_iterable(cut)), lambda new: {p: self._part(p) for p in new})
        found = {s: tuple(chain.from_iterable([parts[p] for p in own])) for s, own in zip(fresh, cut, strict=True)}
        # the library puts a space in front itself; of a space alone it makes nothing, as of an empty text
        checked = [s for s in fresh if s[0] == SPACE and len(s) > 1]
        for s, ids in zip(checked, self.library.encode([s[1:] for s in checked], num_threads=1), strict=True):
            if tuple(ids) != found[s]:
                raise ValueError(f"the sentencepiece library encodes {s[:200]!r} otherwise")
        return found

    def encode_batch(self, texts: list[str], whole: bool = False) -> list[tuple[str, list[int]]]:
        """Of each text the ids, as decimals joined by commas and as a list."""
        cut = []
        for text in texts:
            shown = SPACE + text.replace(" ", SPACE) if text else ""
            cut.append(_SEGMENTS.findall(shown) if self.cut_at_spaces else [shown] * bool(shown))
        shown_ids = lambda new: {s: (",".join(map(str, ids)), ids) for s, ids in self._segments(new).items()}
        memo = self.memo.of(set(chain.from_iterable(cut)), shown_ids)
        out = []
        for segments in cut:
            parts = [memo[s] for s in segments]
            out.append((",".join([p[0] for p in parts]), list(chain.from_iterable([p[1] for p in parts]))))
        if whole:
            for text, (_, ids), own in zip(texts, out, self.library.encode(texts, num_threads=1), strict=True):
                if ids != own:
                    raise ValueError(f"the sentencepiece library encodes {text[:200]!r} otherwise")
        return out

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) if x else "" for x in ids]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mapped(rows: DataFrame, columns: list, path: str, run, schema: str, id_column: str) -> DataFrame:
    """run(vocabulary, values of the last column) gives the columns after the id, a batch at a time."""
    small_batches(rows.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches):
        vocabulary = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *run(vocabulary, batch.column(1).to_pylist())], [id_column, *names])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(*columns).mapInArrow(task, f"`{id_column}` {kind}, {schema}")


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """Per row: the id, and ids array<int> of the whole text."""

    def run(vocabulary, texts):
        return [pa.array([ids for _, ids in vocabulary.encode_batch(texts, whole)], pa.list_(pa.int32()))]

    return _mapped(docs, [docs[id_column], text_or_empty(text_column)], path, run, "ids array<int>", id_column)


def decoded(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: the id, and the text of its ids (null: empty)."""

    def run(vocabulary, ids):
        return [pa.array(vocabulary.decode_batch([x or [] for x in ids]), pa.string())]

    return _mapped(rows, [rows[id_column], rows[ids_column]], path, run, "text string", id_column)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from them)."""

    def run(vocabulary, texts):
        found = vocabulary.encode_batch(texts, whole)
        back = vocabulary.decode_batch([ids for _, ids in found])
        return [
            pa.array([len(ids) for _, ids in found], pa.int64()),
            pa.array([hashlib.sha256(shown.encode()).hexdigest() for shown, _ in found], pa.string()),
            pa.array([hashlib.sha256(text.encode()).hexdigest() for text in back], pa.string()),
        ]

    return _mapped(docs, [docs[id_column], text_or_empty(text_column)], path, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_column)
