"""Token counts of a unigram vocabulary without building tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches that end at each
character; dynamic programming carries the best score and its number of
pieces. Ties follow the tokenizers library: among the matches that end at a
place the one with the earliest start stays unless a later one scores more, and
a character without a piece of its own competes at the lowest score less 10.

No piece has a word mark after another character, so the best path of a text
is that of its words, each with its mark; a word is solved once per task while
it is remembered, and a word of any length in memory of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textcore import spread

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: So many words, of at most so many characters, are remembered by a task; a longer word keeps so many cells while it is solved.
MEMO_WORDS, MEMO_LETTERS, KEEP_CELLS = 400_000, 100, 4096


def read_vocabulary(name: str) -> tuple[list[tuple[str, float]], set[int]]:
    """(pieces and scores that can match a text, bytes that have a piece) of a sentencepiece file."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces, held = [], set()
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            held.add(int(model.id_to_piece(i)[1:-1], 16))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i)))
    return pieces, held


class Counter(dict):
    """Number of pieces of each word, solved when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]], held_bytes: set[int]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} spans words")
            if piece.count(MARK) <= 1:  # words are split at every mark
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces) + 1
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.held_bytes = held_bytes

    def fallback(self, char: str) -> int:
        """Pieces of a character that has none: its bytes if all have one; 0 stands for a part of an unknown run."""
        raw = char.encode("utf-8", "surrogatepass")
        return len(raw) if self.held_bytes.issuperset(raw) else 0

    def __missing__(self, word: str) -> int:
        # best score, pieces and whether the last one is unknown, of the prefixes that a piece can still continue
        best: list[float] = [0.0]
        count, lone = [0], [False]
        before, at, unknown, ends = 0, 0, self.unknown, ((len(word), None),)
        top, pieces, single = None, 0, False
        for end, match in chain(self.automaton.iter(word), ends):  # matches by their end, the earliest start first
            while at < end:  # no more matches end here
                if not single and (top is None or best[-1] + unknown > top):
                    more = self.fallback(word[at])
                    # unknown characters in a row are one piece
                    pieces = count[-1] + (more or int(not lone[-1]))
                    lone.append(not more)
                    top = best[-1] + unknown
                else:
                    lone.append(False)
                best.append(top)
                count.append(pieces)
                if len(best) > KEEP_CELLS:
                    gone = len(best) - self.longest
                    before += gone
                    del best[:gone], count[:gone], lone[:gone]
                at, top, single = at + 1, None, False
            if match is not None:
                size, score = match
                start = end + 1 - size - before
                s = best[start] + score
                if top is None or s > top:
                    top, pieces = s, count[start] + 1
                if size == 1:
                    single = True
        if len(word) <= MEMO_LETTERS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = count[-1]
        return count[-1]

    def of_text(self, text: str) -> int:
        """Pieces of a whole text; spaces mark words, and the first word gets a mark if it has none."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = marked.split(MARK)
        if marked[0] == MARK:
            words = words[1:]
        return sum(self[MARK + w] for w in words)


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(*read_vocabulary(name))


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(name)
        for batch in batches:
            n = pa.array([own.of_text(t.as_py() or "") for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens (the pieces of the best segmentation; no special tokens).

    Null and empty texts have 0. A character that no piece holds counts its bytes if the vocabulary has byte pieces,
    else a run of such characters in a word counts 1. Repeated rows and null ids are kept. Other columns are not read.
    """
    data = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return spread(data).mapInArrow(_count(vocabulary), "doc_id long, n_tokens long")
