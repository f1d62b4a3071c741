"""Byte-level BPE as a transducer: merges are compiled into an automaton that reads bytes and emits tokens.

Two facts carry it. A sequence of tokens is the encoding of its bytes if and only if each two neighbours are (the first
merge across a border would also be made in the two tokens alone), so encodings are a regular language whose
only memory is the last token. And every prefix has exactly one encoding. The nondeterministic transducer has states (last
token, place in the trie of tokens); it guesses where tokens end and checks each against the one before.

It is made deterministic as the text comes: a state is the set of paths still alive, each with the tokens it has and the
others do not. What all paths share is emitted at once, so a token leaves as soon as no later byte can change it; the tokens
held back are the lookahead, which the vocabulary bounds. Transitions are remembered per task, up to a fixed number.

Decoding runs the tokens' bytes through a UTF-8 state machine that keeps an unfinished character between tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textcore import spread

RANKS = "byte_bpe_50k.tiktoken"
#: Transitions that a task remembers; when there are more it starts anew. Pieces (of at most so many bytes) that it remembers,
#: twice: those met lately, and those of the time before, of which each that is met again moves on.
MOST_STEPS, MOST_PIECES, PIECE_BYTES = 1_000_000, 300_000, 64
#: Texts of more characters are split into pieces bit by bit; so many tokens at most leave in one batch.
LONG_TEXT, BLOCK, FLUSH = 1 << 18, 1 << 16, 1 << 20
START = -1
_NEVER = 1 << 62


def read_ranks(name: str) -> dict[bytes, int]:
    """Tokens and their ranks of a rank file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """How the bytes of each token merge, and which tokens can stand side by side in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a token")
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self._steps: dict[int, tuple | None] = {}
        self.known: dict[int, bool] = {}

    def steps(self, token: int) -> tuple[tuple[int, int, int], ...] | None:
        """(rank, size of the first part, size of the last part) after each merge of a token's bytes; None if they do not end as the token."""
        if token not in self._steps:
            whole = self.bytes_of[token]
            parts, done = [whole[i : i + 1] for i in range(len(whole))], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                done.append((rank, len(parts[0]), len(parts[-1])))
            self._steps[token] = tuple(done) if len(parts) == 1 else None
        return self._steps[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether the bytes of both, merged together, end as these two tokens (or, at the start, as this one)."""
        known = self.known.get(last << 32 | token)
        if known is None:
            if len(self.known) >= MOST_STEPS:
                self.known.clear()
            known = self.steps(token) is not None if last == START else self._no_merge_across(last, token)
            self.known[last << 32 | token] = known
        return known

    def _no_merge_across(self, last: int, token: int) -> bool:
        left, right = self.steps(last), self.steps(token)
        if left is None or right is None:
            return False
        a, b = self.bytes_of[last], self.bytes_of[token]
        i = j = 0
        x = y = 1  # sizes of the parts at the border
        while True:
            across = self.ranks.get(a[-x:] + b[:y], _NEVER)
            while True:  # the lowest rank merges next, of equal ones the leftmost
                here = left[i][0] if i < len(left) else _NEVER
                there = right[j][0] if j < len(right) else _NEVER
                if across < here and across <= there:
                    return False
                if here == there == _NEVER:
                    return True
                if here <= there:
                    size, i = left[i][2], i + 1
                    if size != x:
                        x = size
                        break
                else:
                    size, j = right[j][1], j + 1
                    if size != y:
                        y = size
                        break


class Encoder(dict):
    """The transducer. As a dict: the tokens of each piece of text, as 32-bit numbers, found when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.merges = Merges(ranks)
        self.trie: dict[int, int] = {}
        self.token, self.grows = [-1], bytearray(1)
        for raw, rank in ranks.items():
            node = 0
            for byte in raw:
                self.grows[node] = 1
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(0)
                node = child
            self.token[node] = rank
        self.lookahead = 0
        self._forget()

    def _forget(self) -> None:
        """Only the start is known. A state is a flat tuple of its paths: place in the trie, last token, tokens held back."""
        self.states: dict[tuple, int] = {}
        self.paths: list[tuple] = []
        self.table: dict[int, int] = {}
        self.emits: dict[int, tuple] = {}
        self._state((0, START, ()))

    def _state(self, paths: tuple) -> int:
        number = self.states.get(paths)
        if number is None:
            number = self.states[paths] = len(self.paths)
            self.paths.append(paths)
        return number

    def _determinise(self, state: int, byte: int) -> int:
        """The next state, doubled, and one more if tokens are emitted on the way."""
        paths, trie, grows, token_at, merges = [], self.trie, self.grows, self.token, self.merges
        known, ended = merges.known, False
        own = iter(self.paths[state])
        for node, last, held in zip(own, own, own):
            child = trie.get(node << 8 | byte)
            if child is None:
                continue
            if grows[child]:
                paths += child, last, held
            token = token_at[child]
            if token >= 0 and not ended:  # what is read so far has one encoding: of the paths one can end here
                ended = known.get(last << 32 | token)
                if ended is None:
                    ended = merges.follows(last, token)
                if ended:
                    paths += 0, token, (*held, token)
        k, every = 0, paths[2::3]
        longest = max(map(len, every))
        if longest:
            shared = min(every, key=len)
            while k < len(shared) and all(held[k] == shared[k] for held in every):
                k += 1
            if longest - k > self.lookahead:
                self.lookahead = longest - k
            if k:
                paths[2::3] = [held[k:] for held in every]
        step = self._state(tuple(paths)) << 1 | (k > 0)
        self.table[state << 8 | byte] = step
        if k:
            self.emits[state << 8 | byte] = shared[:k]
        return step

    def read(self, state: int, raw: bytes) -> tuple[int, list[int]]:
        """The state after more bytes, and the tokens that no later byte can change."""
        out: list[int] = []
        table, emits = self.table, self.emits
        for byte in raw:
            step = table.get(state << 8 | byte)
            if step is None:
                if len(table) >= MOST_STEPS:
                    paths = self.paths[state]
                    self._forget()
                    table, emits = self.table, self.emits
                    state = self._state(paths)
                step = self._determinise(state, byte)
            if step & 1:
                out += emits[state << 8 | byte]
            state = step >> 1
        return state, out

    def rest(self, state: int) -> tuple[int, ...]:
        """The tokens held back at the end of a piece: those of the one path that ends with a token."""
        paths = self.paths[state]
        return next(held for node, held in zip(paths[::3], paths[2::3]) if not node)

    def __missing__(self, piece: str) -> bytes:
        tokens = self.before.pop(piece, None)
        if tokens is None:
            raw = piece.encode("utf-8", "surrogatepass")
            state, out = self.read(0, raw)
            out += self.rest(state)
            if len(out) > 1 and raw in self.merges.ranks:  # a token that merges do not lead to stands for a piece of its own
                out = [self.merges.ranks[raw]]
            tokens = array("i", out).tobytes()
            if len(raw) > PIECE_BYTES:
                return tokens
        if len(self) >= MOST_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = tokens
        return tokens

    def encode(self, text: str, pattern: regex.Pattern) -> np.ndarray:
        """Tokens of a text, each match of the pattern by itself."""
        if len(text) <= LONG_TEXT:
            return np.frombuffer(b"".join(map(self.__getitem__, pattern.findall(text))), np.int32)
        pieces, out = (m.group() for m in pattern.finditer(text)), bytearray()
        while block := list(islice(pieces, BLOCK)):
            out += b"".join(map(self.__getitem__, block))
        return np.frombuffer(out, np.int32)


class Utf8:
    """A UTF-8 state machine. A state is (bytes to come, least and largest next byte); 0 bytes to come is between characters."""

    BETWEEN = (0, 0, 255)
    WRONG = "�"

    @staticmethod
    def lead(byte: int) -> tuple[int, int, int] | None:
        """State after the first byte of a character; None if it can't be one."""
        if byte < 0x80:
            return Utf8.BETWEEN
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:  # no overlong forms, no surrogates
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:  # nothing beyond U+10FFFF
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    @staticmethod
    def run(state: tuple[int, int, int], begun: bytes, raw: bytes) -> tuple[tuple[int, int, int], bytes, str]:
        """(state, bytes of the unfinished character, characters finished) after more bytes. What can't be UTF-8 becomes U+FFFD."""
        out, held = [], bytearray(begun)
        for byte in raw:
            if state[0] and not state[1] <= byte <= state[2]:
                out.append(Utf8.WRONG)
                held.clear()
                state = Utf8.BETWEEN
            if state[0]:
                state = (state[0] - 1, 0x80, 0xBF) if state[0] > 1 else Utf8.BETWEEN
            else:
                state = Utf8.lead(byte)
                if state is None:
                    out.append(Utf8.WRONG)
                    state = Utf8.BETWEEN
                    continue
            held.append(byte)
            if not state[0]:
                out.append(held.decode())
                held.clear()
        return state, bytes(held), "".join(out)


class Decoder(dict):
    """Characters that each token finishes after an unfinished character, by (its bytes, token): composed once.

    ``texts`` has those of the tokens that begin and end between characters, by id; after one of them the machine is where it was. ``breaks`` marks the others.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        super().__init__()
        self.bytes_of = bytes_of
        self.texts = np.full(max(bytes_of, default=-1) + 2, "", object)
        self.breaks = np.ones(len(self.texts), bool)
        for token in bytes_of:
            left, self.texts[token] = self._composed(b"", token)
            self.breaks[token] = bool(left)

    def _composed(self, begun: bytes, token: int) -> tuple[bytes, str]:
        state, _, _ = Utf8.run(Utf8.BETWEEN, b"", begun)
        _, left, out = Utf8.run(state, begun, self.bytes_of.get(token, b"\xff"))
        return left, out

    def __missing__(self, key: tuple[bytes, int]) -> tuple[bytes, str]:
        if len(self) >= MOST_STEPS:
            self.clear()
        self[key] = self._composed(*key)
        return self[key]

    def stream(self, blocks: Iterable[list[int] | np.ndarray]) -> Iterator[str]:
        """Characters as the blocks of tokens finish them; an id outside the vocabulary and an unfinished end are U+FFFD."""
        begun, most = b"", len(self.texts) - 1
        for tokens in blocks:
            ids = np.asarray(tokens, np.int64)
            ids = np.where((ids < 0) | (ids > most), most, ids)  # the last place stands for all ids outside the vocabulary
            out, at = self.texts[ids], 0
            for i in chain([0] if begun else [], np.flatnonzero(self.breaks[ids]).tolist()):
                at = max(at, i)
                while at < len(ids) and (begun or self.breaks[ids[at]]):  # from a token that ends within a character to the next that does not
                    begun, out[at] = self[begun, int(ids[at])]
                    at += 1
            yield "".join(out.tolist())
        if begun:
            yield Utf8.WRONG

    def decode(self, tokens: pa.Array | np.ndarray | list[int]) -> str:
        if not isinstance(tokens, np.ndarray):
            tokens = pa.array(tokens, pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return "".join(self.stream(tokens[a : a + BLOCK] for a in range(0, len(tokens), BLOCK)))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(read_ranks(name))


@lru_cache(maxsize=2)
def decoder(name: str) -> Decoder:
    return Decoder({rank: token for token, rank in read_ranks(name).items()})


@lru_cache(maxsize=4)
def _compiled(pattern: str | None) -> regex.Pattern:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern)


def _encode(name: str, pattern: str | None, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = encoder(name), _compiled(pattern)
        for batch in batches:
            a, found, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                found.append(own.encode(text.as_py() or "", split))
                size += len(found[-1])
                if size >= FLUSH or i + 1 == len(batch):
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    cols = [batch.column(0).slice(a, len(found)), ids]
                    if back:
                        cols.append(pa.array([decoder(name).decode(x) for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])
                    a, found, size = i + 1, [], 0

    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str | None = None, back: bool = False) -> DataFrame:
    """One row per row: doc_id, ids (array of int): each match of ``pattern`` encoded by itself, without special tokens.

    ``pattern`` None is that of the rank files. With ``back``, a column decoded has what the ids decode to. Null and empty texts
    have no ids. Repeated rows and null ids are kept. A text or a word may be of any length: time grows with its bytes, and
    beside the text and its ids nothing does. Other columns are not read.
    """
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(data).mapInArrow(_encode(ranks, pattern, back), "doc_id long, ids array<int>" + ", decoded string" * back)


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(name)
        for batch in batches:
            a, size, texts = 0, 0, []
            for i, ids in enumerate(batch.column(1)):
                texts.append(own.decode(ids.values) if ids.is_valid else None)
                size += len(texts[-1] or "")
                if size >= 4 * FLUSH or i + 1 == len(batch):
                    part = batch.slice(a, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                    a, size, texts = i + 1, 0, []

    return run


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """One row per row: doc_id, ids, decoded (text).

    Bytes that are not UTF-8, ids outside the vocabulary and null ids within a list come out as U+FFFD; a null list as null.
    """
    data = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return data.mapInArrow(_decode(ranks), "doc_id long, ids array<int>, decoded string")
