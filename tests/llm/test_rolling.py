import numpy as np

from sigspark.llm import quality_rules
from sigspark.llm.common import _PRIME, Rolling, _product, steps


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_products_are_modular():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, _PRIME, 40_000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [_PRIME - 1, 0, _PRIME - 1], [_PRIME - 1, 5, 1]
    assert [int(x) for x in _product(a, b)] == [int(x) * int(y) % _PRIME for x, y in zip(a, b)]


def test_equal_ranges_have_equal_hashes_and_others_do_not():
    word = thue_morse(1024)
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba")) + word).encode(), np.uint8)
    at = np.array([0, 1024, 2048])
    h = Rolling.of_bytes(data).between(at, at + 1024)
    assert h[0] == h[2] != h[1]
    windows = Rolling.of_bytes(data).windows(1024)
    assert windows[at].tolist() == h.tolist()


def test_lines_of_a_word_and_its_complement_differ():
    import pyarrow as pa

    for n in (1024, 2048):
        word = thue_morse(n)
        text = word + "\n" + word.translate(str.maketrans("ab", "ba")) + "\n" + word
        ((_, _, data, at),) = steps(pa.array([text]))
        found = quality_rules.measure(data, at)
        assert found["n_dup_lines"].tolist() == [1] and found["dup_line_chars"].tolist() == [n]
