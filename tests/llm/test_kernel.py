"""Span hashes."""

import numpy as np

from docspark.llm import kernel as K


def test_no_collision_of_complements():
    """The Thue-Morse word and its complement, on which every polynomial modulo a power of two agrees."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    data = np.array([97 + x for x in bits] + [98 - x for x in bits], np.uint8)
    a, b = K.hashes(K.prefix(data), np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b


def test_hash_is_of_the_bytes_alone():
    """Equal spans agree wherever they stand, in texts longer than the tables too."""
    data = np.random.default_rng(1).integers(0, 256, 3 * K.RUN).astype(np.uint8)
    at = np.array([100, K.RUN - 7, 2 * K.RUN - 50, len(data) - 300])
    for p in at[1:]:
        data[p : p + 300] = data[100:400]
    got = K.hashes(K.prefix(data), at, at + 300)
    alone = K.hashes(K.prefix(data[100:400]), np.array([0]), np.array([300]))
    assert len({*got.tolist(), *alone.tolist()}) == 1
    many = K.hashes(K.prefix(data), np.arange(50_000), np.arange(50_000) + 9)
    assert len(np.unique(many)) == len({data[i : i + 9].tobytes() for i in range(50_000)})
