"""Awkward texts for the tests."""

import random

PARTS = ["the", "don't", "we'll", "Ünïcode", "日本語テキスト", "🙂🙂", "12345", "<|endoftext|>", "a" * 300, "x\u00a0y", "\u3000", "...", "--", "#*$", "", "\t", "\r\n", "\x1c", "é́", "İ"]
GAPS = [" ", " ", " ", " ", "  ", "\n", "\n\n", "   ", "\t", "", " \n "]


def awkward(seed: int, n: int) -> str:
    r = random.Random(seed)
    word = lambda: r.choice(PARTS) if r.random() < 0.3 else "".join(r.choice("abcdeftho") for _ in range(r.randint(1, 9)))
    return "".join(word() + r.choice(GAPS) for _ in range(n))


#: Rows of (doc_id, text): null and repeated ids, null, empty, white, repeated and long texts.
ROWS = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (3, "one"), (None, "two words"), (4, "x" * 200_000), (5, "word " * 30_000), *[(k, awkward(k, 200)) for k in range(6, 20)],
        (20, awkward(6, 200)), (6, awkward(6, 200))]
