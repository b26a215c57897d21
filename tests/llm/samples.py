"""Texts made from seeds, and the odd cases every operator meets."""

import random


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    rng, w = random.Random(seed), text.split(" ")
    for at in range(every // 2, len(w), every):
        w[at] = "new" + str(rng.randint(0, 10**6))
    return " ".join(w)


LONG = words(120_000, 99)

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, LONG),
    (5, "one two three"),
    (5, "one two three"),
    (6, words(80, 1)),
    (7, words(80, 1)),
    (7, words(80, 2)),
    (None, words(80, 1)),
    (None, None),
    (8, "é　ü \x1c\x85 \U0001f600 <|endoftext|> it's 12,5!! \r\n\r\nEnd\n"),
    (9, "word " * 300),
]
