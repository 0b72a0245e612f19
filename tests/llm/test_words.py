"""Word hashes: as many as there are words, whatever the bytes."""

import random

from tidebars.llm.common import LOWER, NOT_ALNUM, scan_words


def alternating(n):
    """The sequence that makes every polynomial of its bytes agree with that of its complement modulo a power of two."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_alternating_sequences_differ():
    for n in (256, 1024, 4096):
        one = alternating(n)
        other = one.translate(str.maketrans("ab", "ba"))
        h = scan_words([one.encode(), other.encode()]).hashes
        assert h[0] != h[1]


def test_hashes_tell_words_apart_and_do_not_depend_on_the_segment():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 255, 256, 257, 600]))) for _ in range(3000)]
    swapped = ["x" * 100 + "y" + "x" * 255 + "z" + "x" * 50, "x" * 100 + "z" + "x" * 255 + "y" + "x" * 50]
    words += swapped
    texts = [" \n".join(words[i : i + 7]).encode() for i in range(0, len(words), 7)] + [b"", b"  ", b"\x0b"]
    whole, parts = scan_words(texts), scan_words(texts, segment=50)
    assert (whole.hashes == parts.hashes).all() and (whole.starts == parts.starts).all()
    seen = {}
    for w, h in zip(words, whole.hashes.tolist()):
        assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(words))


def test_folding():
    a, b = (scan_words([t], NOT_ALNUM, LOWER) for t in (b"It's ONE-word", b"it s one word"))
    assert (a.hashes == b.hashes).all() and len(a) == 4
