"""The transducer against the tiktoken library, streaming against whole pieces, and the UTF-8 machine against Python's decoder."""

import random
from array import array

import pytest
import public_tokenizers
import regex

from plumbline.llm import bpe

PATTERN = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


LONG = ["a" * 5000, "ab" * 3000, "the" * 2000, "=" * 777, " " * 501, "é" * 300, "\n\n\t " * 99, "don't we'll 'S 's", "<|endoftext|> <P>", "\x00\x1c\x85​ 　", "👩‍👩‍👧‍👦🏳️‍🌈 naïve ½ ٣٤ x̂"]


def test_equals_the_library(library):
    own, rng = bpe.encoder(bpe.RANKS), random.Random(3)
    texts = LONG + ["".join(rng.choice("aab  e\nthes1é🙂<>ing.,") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += [f"a{c}a {c} {c}{c}1{c}  {c}\n" for c in map(chr, range(0, 0x110000, 997)) if not 0xD800 <= ord(c) < 0xE000]
    for text in texts:
        assert own.encode(text, PATTERN).tolist() == library.encode_ordinary(text), text
    assert own.lookahead < 16


def test_every_token_comes_from_its_merges():
    merges = bpe.encoder(bpe.RANKS).merges
    assert all(merges.steps(rank) is not None for rank in merges.ranks.values())


def small_ranks(*more: str) -> dict[bytes, int]:
    return {bytes([b]): b for b in range(256)} | {m.encode(): 256 + i for i, m in enumerate(more)}


def slow_merge(ranks, raw):
    """The definition: the pair of lowest rank merges, of equal ones the leftmost, until none does."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_equal_the_definition(seed):
    """Also where a pair ranks below its parts, and where merges do not lead to a token."""
    rng = random.Random(seed)
    tokens = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
    ranks = small_ranks(*tokens)
    own = bpe.Encoder(ranks)
    for _ in range(500):
        raw = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))).encode()
        state, out = own.read(0, raw)
        assert [*out, *own.rest(state)] == slow_merge(ranks, raw), raw
    unreached = [t for t in tokens if own.merges.steps(ranks[t.encode()]) is None]
    for t in unreached:  # the library gives a whole piece its own token
        assert own[t] == array("i", [ranks[t.encode()]]).tobytes()


def test_tokens_leave_early_and_memory_is_bounded(monkeypatch):
    own = bpe.Encoder(bpe.read_ranks(bpe.RANKS))
    state, seen, raw = 0, 0, b" international" * 40
    for i, byte in enumerate(raw):
        state, out = own.read(state, bytes([byte]))
        seen += len(out)
        assert max(map(len, own.paths[state][2::3])) <= own.lookahead
    assert seen >= 38
    monkeypatch.setattr(bpe, "MOST_STEPS", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    small, text = bpe.Encoder(bpe.read_ranks(bpe.RANKS)), " ".join(LONG[3:]) * 3
    assert small.encode(text, PATTERN).tolist() == own.encode(text, PATTERN).tolist()
    assert len(small.table) <= 50 and len(small) <= 5 and len(small.before) <= 5


def test_utf8_machine_equals_the_decoder():
    rng, own = random.Random(2), bpe.Decoder(dict(enumerate([bytes([b]) for b in range(256)] + ["é🙂".encode()[1:4], "🙂".encode()[2:]])))
    pool = [0xE0, 0xA0, 0x80, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xC2, 0x41, 0xFF, 0xBF, 256, 257]
    for _ in range(5000):
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 10))]
        assert own.decode(ids) == b"".join(own.bytes_of[i] for i in ids).decode("utf-8", "replace"), ids
    assert own.decode([65, None, 10**6, 66]) == "A��B"


def test_whole_operator(table, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 1 << 18)
    rows = [(i, t) for i, t in enumerate(LONG)] + [(None, None), (None, "null id"), (3, ""), (3, "again"), (3, "again"), (99, "very long é " * 60_000)]
    coded = bpe.encode_texts(table(rows), back=True)
    got = coded.collect()
    assert sorted(bpe.decode_ids(coded).collect(), key=str) == sorted(got, key=str)
    assert sorted(((r.doc_id, r.decoded, r.ids) for r in got), key=str) == sorted(((i, t or "", library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert bpe.decode_ids(bpe.encode_texts(table([]))).count() == 0


def test_null_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 65])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode_ids(rows).collect()}
    assert got[1] is None and got[2] == "" and got[3][0] == "�"


def test_a_text_in_blocks_equals_the_text_at_once(monkeypatch):
    own, text = bpe.encoder(bpe.RANKS), "one two  three\n\n4 five's " * 50
    whole = own.encode(text, PATTERN).tolist()
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert own.encode(text, PATTERN).tolist() == whole


def test_only_tokens_around_a_broken_character_are_stepped_through(library):
    """Before, one token that ends within a character sent its whole block of tokens through the machine one by one."""
    text = "whole words of many kinds, " * 50 + "a 🏳 b" + " and some more of them"
    ids = library.encode_ordinary(text)
    own = bpe.Decoder({rank: token for token, rank in bpe.read_ranks(bpe.RANKS).items()})
    assert own.decode(ids) == text and 0 < len(own) <= 6
    assert own.decode([ids[0], -5, 1 << 30, ids[1]]) == own.decode(ids[:1]) + "��" + own.decode(ids[1:2])
