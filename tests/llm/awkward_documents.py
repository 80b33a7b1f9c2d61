"""Texts for the tests."""

import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "do", "ti", "ke", "lu", "ra"]) for _ in range(r.randint(1, 4))) for _ in range(n))
