import itertools
import random
import string

from scriptorium.llm import words


def plain_words(text):
    bare = (text or "").lower().translate({ord(c): None for c in string.punctuation})
    return [w for w in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in bare).split(" ") if w]


def test_equal_words_have_equal_hashes_everywhere():
    rng = random.Random(4)
    vocabulary = ["a", "ab", "ba", "aba", "Straße", "été", "x1", "don't", "(a)", "...", "日本", "z" * 50]
    texts = [None, "", " ", " ".join(rng.choice(vocabulary) for _ in range(60_000)), "\n\t a\x0bb ", "q" * 300_000 + " a"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    hashes, counts = words.batch_word_hashes(texts)
    flat = [w for t in texts for w in plain_words(t)]
    assert counts.tolist() == [len(plain_words(t)) for t in texts] and len(hashes) == len(flat)
    by = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_lcs():
    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 80)) for _ in range(2))
        assert words.lcs_length(a, b) == slow(a, b)
