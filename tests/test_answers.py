"""Deltas of answers against the split of the whole text so far."""

import random

from cuemill.streaming import events as E


def plain(deltas):
    text, thought, said, out = "", "", "", []
    for d in deltas:
        text += d
        more, now = E.split_answer(text)
        out.append((now[len(said) :] if now.startswith(said) else now, more[len(thought) :] if more.startswith(thought) else more))
        thought, said = more, now
    return out


def test_deltas_as_the_whole_text_has_them():
    rng = random.Random(0)
    pieces = ["<think>", "</think>", "<thi", "nk>", "</", "think>", "<", " ", "\n", "word", "a b ", "", "</thi", "nk", ">", "é"]
    for n in range(3000):
        deltas = [rng.choice(pieces) for _ in range(rng.randint(1, 12))]
        if n % 3 == 0:  # the same text letter by letter
            deltas = list("".join(deltas))
        heard, got, text = E.Heard(), [], ""
        for d in deltas:
            got.append(heard.add(d, lambda t=text: t))
            text += d
        assert got == plain(deltas), deltas


def test_the_text_is_asked_for_once():
    heard, asked = E.Heard(), []
    for d in ["<think>why", " not", "</think> so", " it", " is </think>"]:
        heard.add(d, lambda: asked.append(1) or "<think>why not")
    assert len(asked) == 1
