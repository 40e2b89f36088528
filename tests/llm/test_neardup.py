import re

from conftest import WORDS, sentence
from scriptorium.llm import neardup


def plain(rows):
    """Groups by definition: all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return {doc: (len(sets[i]), min(groups[find(i)])) for i, (doc, _) in enumerate(rows)}


def got(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}


def near_copies(rng, n, words, most_edits):
    base = sentence(rng, words).split()
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base if rng.random() < 0.7 else out[-1].split())
        for _ in range(rng.randint(0, most_edits)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        out.append(" ".join(copy))
    return out


def test_groups_equal_brute_force(documents, rng):
    texts = [sentence(rng, rng.randint(1, 90)) for _ in range(150)]
    for words, edits in ((60, 5), (120, 9), (30, 2), (8, 1)):
        texts += near_copies(rng, 40, words, edits)
    texts += ["A b  C", "a B c", "", None, "   ", "one", "one", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(documents(rows)) == plain(rows)


def test_a_bad_centre_loses_no_link(documents, rng):
    """Copies that are unlike each other but like the base, and chains."""
    base = sentence(rng, 100).split()
    rows = [(900, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(0, 100, 5), 3):
            copy[k] = f"x{i}y{k}"
        rows.append((i, " ".join(copy)))
    chain = list(base[::-1])
    for i in range(20):
        chain[(i * 7) % 100] = f"c{i}"
        rows.append((500 + i, " ".join(chain)))
    assert got(documents(rows)) == plain(rows)


def test_repeated_null_and_empty(documents):
    rows = neardup.near_duplicates(documents([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (7, "")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(False, 5, 5, True), (False, 5, 5, True), (False, 7, 7, True)]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["5", "None"]
    assert neardup.near_duplicates(documents([])).count() == 0
    columns = neardup.near_duplicates(documents([(1, "x" * 200_000 + " y" * 50_000)])).first()
    assert columns.n_shingles == 2


def test_parity_is_a_lower_bound(rng):
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.r_[a[: r.integers(0, len(a) + 1)], r.integers(0, 2**63, r.integers(0, 60), dtype=np.uint64)])
        differ = sum(int(x ^ y).bit_count() for x, y in zip(neardup.parity(a).view(np.uint64), neardup.parity(b).view(np.uint64), strict=True))
        assert differ <= len(np.setxor1d(a, b))
