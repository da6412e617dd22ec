"""The line classifier on texts that are measured in parts."""

import random
import resource

import numpy as np
import pytest

from tallybrook.llm import crf

FIELD = crf.Field(np.linspace(0, 1, crf.MEASURES), np.linspace(1, 2, crf.MEASURES), np.linspace(-1, 1, 3 * crf.MEASURES + 3), np.array([[0.3, -0.2], [0.1, 0.4]]))


def lines(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "the", "ab#", "X!", "9.", "|", "über", "...", "word"])
    made = [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return "\n".join(rng.choice(made) for _ in range(n)).encode()


@pytest.mark.parametrize("size", [20, 33, 64, 500, 10**6])
@pytest.mark.parametrize("text", [b"", b"\n", b"\n\n", b"one", b"one two\n", b"the the the\nthe the", lines(1, 40), lines(2, 41) + b"\n", b"a " * 300, "漢字 é\n".encode() * 30])
def test_parts_have_the_counts_of_the_whole(text, size, monkeypatch):
    counts, seen = crf.long_counts(text, size)
    x, per_text, lengths = crf.line_measures([text])
    assert len(counts) == per_text[0]
    assert crf._as_measures(counts, seen) == pytest.approx(x)
    assert counts[:, crf.COUNTED.index("length")].tolist() == lengths.tolist()
    monkeypatch.setattr(crf, "PART_LINES", 7)
    assert FIELD.long_score(text, size) == pytest.approx(FIELD.scores([text])[0])


def test_scores_do_not_depend_on_the_batch():
    texts = [lines(k, 20) for k in range(6)] + [b"the", b"the", b""]
    together = FIELD.scores(texts)
    assert [FIELD.scores([t])[0] for t in texts] == pytest.approx(together.tolist())


def test_one_line_of_fifty_megabytes():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= FIELD.long_score(b"x" * 50_000_000, crf.PIECE_BYTES) <= 1
    assert 0 <= FIELD.long_score(b"many words, " * 4_000_000, crf.PIECE_BYTES) <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # kilobytes
