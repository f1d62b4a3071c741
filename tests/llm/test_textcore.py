import numpy as np
import pyarrow as pa

from plumbline.llm import textcore
from plumbline.llm.textcore import ALNUM, SPACED, Words, covered, intervals, text_buffer


def words(texts, table=SPACED, **kw):
    return Words(*text_buffer(pa.array(texts, pa.string())), table, **kw)


def test_words_and_their_places():
    w = words(["a bb\tccc", None, "", " x ", "y"])
    assert w.counts.tolist() == [3, 0, 0, 1, 1]
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)] == ["a", "bb", "ccc", "x", "y"]
    assert words(["Ab-\u00e9Z 9_"], ALNUM, lower=True).counts.tolist() == [3]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(200)) for _ in range(5)] + ["q" * 500]
    whole = words(texts)
    names = [bytes(whole.data[s:e]) for s, e in zip(whole.start, whole.end)]
    assert len(set(whole.hash.tolist())) == len(set(names)) == len(set(zip(names, whole.hash.tolist())))
    monkeypatch.setattr(textcore, "SLICE_BYTES", 64)
    assert (words(texts).hash == whole.hash).all()


def test_windows_stay_inside_a_text():
    w = words(["a b c", "b c", "a b"])
    at, h = w.windows(2)
    assert at.tolist() == [0, 1, 3, 5] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert w.windows(4)[0].tolist() == []


def test_intervals():
    mask = covered(np.array([1, 2, 7]), 3, 9)
    assert mask.tolist() == [False, True, True, True, True, False, False, True, True]
    assert intervals(mask).tolist() == [[1, 5], [7, 9]]
