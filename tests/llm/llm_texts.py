"""Made-up prose for the tests."""

import random


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(words))
