"""Matches that begin at the start of a text."""

import random

from storelens.llm import decontamination

from .conftest import words
from .test_text import distance


def test_deletions_at_the_start_of_a_text():
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, "en", 14))) for k in range(6)]
    matcher = decontamination.Matcher(items)
    texts = [t[1:] for _, t in items] + [t[1:] + " and more" for _, t in items] + [t[2:] for _, t in items]
    for _, t in items:
        first = len(decontamination.pieces(t, decontamination.budget(t))[0][1])
        texts += [t[:at] + t[at + 1 :] for at in range(first)]
    for text in map(decontamination.plain, texts):
        expected = {(i, d) for i, t in items if (d := distance(t, text)) <= decontamination.budget(t)}
        assert expected and {(i, d) for i, d, _ in matcher.matches(text)} == expected
