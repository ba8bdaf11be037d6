"""Texts for the tests of this folder."""

import random

WORDS = [a + b for a in ("lo", "mi", "ta", "ren", "sol", "vek", "du", "pra") for b in ("na", "rit", "som", "el", "ka", "", "tu", "wen")]


def prose(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) or "a"
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)
