import random

import numpy as np

from lagoon.llm import textkernel as K


def hashes(words):
    data, offsets = K.from_strings(words)
    starts, ends, _ = K.spans(data, offsets, K.SPACED)
    return K.word_hashes(data, starts, ends)


def test_words_of_two_letters_do_not_collide():
    for bits in (5, 6, 7, 10, 11, 12):
        word, other = "a", "b"
        for _ in range(bits):
            word, other = word + other, other + word
        h = hashes([word, other, f"x {word}y {other}y"])
        assert h[0] != h[1] and h[3] != h[4]


def test_a_hash_is_of_the_bytes_alone():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé語") for _ in range(n)) for n in [1, 2, 3, 10, 20, 21, 22, 63, 64, 65, 200, 3000]]
    alone = np.concatenate([hashes([w]) for w in words])
    together = hashes([" ".join(words), "\n ".join(reversed(words))])
    assert (together[: len(words)] == alone).all() and (together[len(words) :][::-1] == alone).all() and len(set(alone.tolist())) == len(words)
