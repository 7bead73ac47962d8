"""Inputs that the tests share."""

import random


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


#: Nulls, empty and wordless texts, ties, repeated rows and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "A a B b"), (4, "A a B b"), (None, "no id"), (5, "É日本 <|im_end|> x y"), (6, "x" * 50_000), (7, "ab " * 30_000)]
