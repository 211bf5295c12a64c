"""Invented texts for small fixtures, and plain models to hold operators against."""

import random
import re

WORD = re.compile(r"[^\W_]+")
NOUNS = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "ze", "lor", "pen", "sir") for b in ("den", "fal", "gor", "hin", "jam", "kel", "lum", "nat", "pol", "rus", "sev", "tor")]
VERBS = ["moved", "failed", "stopped", "grew", "fell", "waited", "broke", "slowed"]


def words(t):
    return WORD.findall(t.lower())


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of {rng.choice(NOUNS)} {rng.choice(VERBS)} after {rng.randrange(10, 999)} {rng.choice(NOUNS)} had {rng.choice(VERBS)} in {rng.choice(NOUNS)}."


def report(rng, n=12):
    return " ".join(sentence(rng) for _ in range(n))


def edited(rng, text, k):
    ws = text.split(" ")
    for _ in range(k):
        ws[rng.randrange(len(ws))] = rng.choice(NOUNS) + "x"
    return " ".join(ws)


def likeness(a, b):
    def runs(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def rng(seed=7):
    return random.Random(seed)
