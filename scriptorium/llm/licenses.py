"""Licence notices by a trained paragraph classifier.

A paragraph is what lines without letters part (blank lines, or comment marks alone); wraps and comment marks within it
don't count, as a word is a run of letters. Paragraphs are read in overlapping passages of PASSAGE words. A passage's
hashed 1- to 3-word n-grams go through a multinomial logistic regression over licence families and "unknown". The model
is trained here on variants made by rule from the passages of the notices, and for "unknown" on the UNKNOWN passages of
smallest hash of the whole corpus that share no three words with a notice, and on shuffled words of notices. A
temperature fitted on held-out variants calibrates the probabilities. The likeliest family at PROBABILITY or more
is confirmed by comparison with the family's templates: the longest common subsequence of a template and the passage
with its neighbourhood must cover TEMPLATE_SHARE of the template, within MOST_SPAN times as many words as it has. The
span of a notice is that of the words so aligned; spans of a family that touch are one notice. Many notices share
phrases: of families whose templates are alike, near each other, the one of more words in common stands.

Defined cases: null and empty texts have no paragraphs and no licences; texts are read whole; a passage goes to one
family, the alphabetically first of equal ones; repeated rows give a row each; null ids stay null; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import low_hash, saved, small_batches
from scriptorium.llm.notices import NOTICES, SPDX
from scriptorium.llm.words import MARKS, lcs_length

FAMILIES = (*sorted(NOTICES), "unknown")
NONE = len(FAMILIES) - 1
#: Words in half a passage, and in a passage.
HALF = 8
PASSAGE = 2 * HALF
BITS = 17
#: Bounds of the fit: passages of the corpus, variants of a family.
UNKNOWN, VARIANTS = 2048, 16
STEPS, SEED = 60, 5
PROBABILITY, TEMPLATE_SHARE, MOST_SPAN = 0.05, 0.7, 1.6
#: Words between two spans that are still one notice; bytes of text read at once.
GAP, PIECE = 8, 1 << 18
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LETTERS = np.array([chr(c).isalpha() or c >= 128 for c in range(128)] + [True] * 128)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of up to so many bytes are hashed side by side, longer ones one by one.
WORD_BYTES = 24


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def encoded(text: str) -> bytes:
    """Lower-cased UTF-8 of as many code points, with marks beyond ASCII as blanks."""
    return (text if text.isascii() else MARKS.sub(" ", text)).encode("utf-8", "surrogatepass").translate(LOWER)


class Words:
    """Words of several texts: hashes, byte spans in the joined text, text and paragraph of each."""

    def __init__(self, texts: list[bytes]):
        # three line ends: a line without letters lies between two texts
        self.begins = np.cumsum([0] + [len(t) + 3 for t in texts])[:-1]
        joined = b"\n\n\n".join(texts)
        a = np.frombuffer(joined, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], LETTERS[a], [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        length = self.end - self.start
        h = length.astype(np.uint64)
        own = np.arange(len(h))
        for k in range(WORD_BYTES):
            own = own[length[own] > k]
            if not len(own):
                break
            h[own] = h[own] * np.uint64(0x100000001B3) + a[self.start[own] + k]
        for i in np.flatnonzero(length > WORD_BYTES).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(joined[self.start[i] + WORD_BYTES : self.end[i]]))
        self.hash = mixed(h)
        line = np.searchsorted(np.flatnonzero(a == 10), self.start)
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1
        self.first = np.flatnonzero(np.r_[True, np.diff(line) > 1]) if len(h) else np.empty(0, int)
        self.last = np.append(self.first[1:], len(h))
        self.paragraph = np.repeat(np.arange(len(self.first)), self.last - self.first)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, paragraph) of each half passage."""
        n = -(-(self.last - self.first) // HALF)
        paragraph = np.repeat(np.arange(len(n)), n)
        return self.first[paragraph] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * HALF, paragraph

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(half, first word, end word) of each passage: two halves, or the only one of a paragraph."""
        start, paragraph = self.halves()
        follows = np.append(paragraph[1:] == paragraph[:-1], False) if len(paragraph) else np.empty(0, bool)
        alone = ~follows & ~np.insert(follows[:-1], 0, False) if len(paragraph) else follows
        half = np.flatnonzero(follows | alone)
        return half, start[half], np.minimum(start[half] + PASSAGE, self.last[paragraph[half]])


def ngram_buckets(w: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """For 1 to 3 words: the bucket of the n-gram that begins at each word, -1 where its part ends before."""
    out = []
    for n in (1, 2, 3):
        b = np.full(len(w), -1, np.int64)
        if len(w) >= n:
            h = sum((w[i : len(w) - n + 1 + i] * MIX[i] for i in range(n)), np.zeros(1, np.uint64)) + np.uint64(n)
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)
            b[: len(h)] = np.where(part[: len(h)] == part[n - 1 :], h, -1)
        out.append(b)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_words(text: str) -> np.ndarray:
    return Words([encoded(text)]).hash


def notice_words() -> dict[str, list[np.ndarray]]:
    """The words of each family's notices and SPDX tags."""
    return {family: [text_words(n) for n in (*notices, *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, ())))] for family, notices in NOTICES.items()}


def templates() -> dict[str, list[np.ndarray]]:
    """The families' templates: notices in pieces of at most a passage."""
    return {family: [p for w in given for p in np.array_split(w, max(1, -(-len(w) // PASSAGE)))] for family, given in notice_words().items()}


def known_templates() -> dict[str, list[tuple[list[int], frozenset]]]:
    """Of each family (template, other families with a notice that this template fits too)."""
    whole = {family: [w.tolist() for w in given] for family, given in notice_words().items()}
    pieces = {family: [p.tolist() for p in ps] for family, ps in templates().items()}
    return {family: [(p, frozenset(g for g, given in whole.items() if g != family and any(fits(p, *aligned(p, w)) for w in given))) for p in ps] for family, ps in pieces.items()}


class Classifier:
    """Weights of buckets (the last row is that of no bucket) for each family."""

    def __init__(self, weights: np.ndarray, temperature: float):
        self.weights, self.temperature = weights, temperature

    def probabilities(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, first word, end word) of all passages."""
        half, first, end = words.passages()
        if not len(half):
            return np.empty((0, len(FAMILIES))), first, end
        starts, _ = words.halves()
        grams = ngram_buckets(words.hash, words.paragraph)
        sums = np.add.reduceat(sum(self.weights[b] for b in grams), starts, axis=0)
        count = np.add.reduceat(sum((b >= 0).astype(int) for b in grams), starts)
        two = end - first > HALF
        after = np.minimum(half + 1, len(starts) - 1)
        total = sums[half] + np.where(two[:, None], sums[after], 0)
        n = count[half] + np.where(two, count[after], 0)
        return softmax(total / np.sqrt(np.maximum(n, 1))[:, None] / self.temperature), first, end


def variants(rng: np.random.Generator, plain: list[np.ndarray], known: dict[str, list[np.ndarray]]) -> tuple[list[np.ndarray], list[int]]:
    """Training passages: templates with words dropped, in contexts from the plain passages; and shuffled words as unknown."""
    texts, labels = [], []
    filler = np.concatenate(plain) if plain else np.empty(0, np.uint64)

    def context(n: int) -> np.ndarray:
        """n words that follow each other in a plain passage, or fewer."""
        own = plain[rng.integers(len(plain))] if plain else filler
        at = rng.integers(0, max(0, len(own) - n) + 1)
        return own[at : at + n]

    everything = np.concatenate([t for ts in known.values() for t in ts])
    pick = lambda pool, n: pool[rng.integers(len(pool), size=n)] if len(pool) else np.empty(0, np.uint64)
    for y, family in enumerate(FAMILIES[:-1]):
        # short templates have the least to go by
        for words in (t for t in known[family] for _ in range(VARIANTS if len(t) > HALF else 4 * VARIANTS)):
            if len(words) > 6:
                words = words[rng.random(len(words)) > 0.06]
            room = max(0, PASSAGE - len(words)) if rng.random() < 0.8 else 0
            before = rng.integers(0, room + 1)
            after = rng.integers(0, room - before + 1)
            texts.append(np.concatenate([context(before), words, context(after)]))
            labels.append(y)
    for i in range(20 * VARIANTS):
        texts.append(pick(filler if i % 2 and len(filler) else everything, rng.integers(3, PASSAGE)))
        labels.append(NONE)
    return texts, labels


def trained(unknown: list[np.ndarray]) -> Classifier:
    """Full-batch AdaGrad on the variants and unknown passages; a fifth of them is kept for the temperature."""
    rng = np.random.default_rng(SEED)
    known = templates()
    triples = lambda w: ngram_buckets(w, np.zeros(len(w), int))[2][: max(0, len(w) - 2)]
    of_notices = np.unique(np.concatenate([triples(t) for ts in known.values() for t in ts]))
    plain = [w for w in unknown if len(w) and not np.isin(triples(w), of_notices).any()]
    more, classes = variants(rng, plain, known)
    texts, labels = plain + more, np.array([NONE] * len(plain) + classes)
    word = np.concatenate(texts)
    part = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = ngram_buckets(word, part)
    b, part = np.concatenate(grams), np.tile(part, 3)
    b, part = b[b >= 0], part[b >= 0]
    by = np.argsort(part, kind="stable")
    b, part = b[by], part[by]
    # an n-gram of a single passage tells nothing about another
    pairs = np.unique(b * np.int64(len(texts)) + part) // len(texts)
    often = np.isin(b, pairs[1:][pairs[1:] == pairs[:-1]])
    size = np.maximum(1, np.bincount(part, minlength=len(texts)))
    b, part = b[often], part[often]
    value = (1 / np.sqrt(size))[part].astype(np.float32)
    used, column = np.unique(b, return_inverse=True)
    held = np.arange(len(texts)) % 5 == 0
    onehot = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    by_column = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[by_column], np.arange(len(used)))
    w = np.zeros((len(used), len(FAMILIES)), np.float32)
    squares = np.full_like(w, 1e-6)

    def logits() -> np.ndarray:
        z = np.zeros((len(texts), len(FAMILIES)), np.float32)
        z[part[first]] = np.add.reduceat(w[column] * value[:, None], first, axis=0)
        return z

    for _ in range(STEPS):
        error = (softmax(logits()) - onehot) * ~held[:, None] / len(texts)
        g = np.add.reduceat((error[part] * value[:, None])[by_column], edges, axis=0) + 1e-6 * w
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    z = logits()[held].astype(float)
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), labels[held]] + 1e-12).mean()
    temperature = min((0.25 * 1.25**i for i in range(15)), key=loss)
    full = np.zeros(((1 << BITS) + 1, len(FAMILIES)), np.float32)
    full[used] = w
    return Classifier(full, temperature)


def aligned(template: list[int], words: list[int]) -> tuple[float, int, int]:
    """(share of the template that is a common subsequence with the words, first and end word of the shortest such stretch from its end)."""
    best = lcs_length(template, words)
    if not best:
        return 0.0, 0, 0
    end = next_end(template, words, best)
    back = next_end(template[::-1], words[:end][::-1], best)
    return best / len(template), end - back, end


def next_end(template: list[int], words: list[int], wanted: int) -> int:
    """The number of words after which the common subsequence first has the wanted length."""
    masks: dict = {}
    for i, x in enumerate(template):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(template)) - 1
    v = full
    for n, y in enumerate(words, 1):
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        if len(template) - v.bit_count() == wanted:
            return n
    return len(words)


def fits(template: list[int], share: float, first: int, end: int) -> bool:
    """Whether an alignment confirms a template; of one of up to half a passage all words must be there."""
    return share >= (TEMPLATE_SHARE if len(template) > HALF else 1) and end - first <= MOST_SPAN * len(template)


def confirmed(words: Words, family: str, first: int, end: int, known: dict) -> tuple[float, int, int, float, frozenset] | None:
    """(share, first word, end word, words, families like it) of the template that fits best in the neighbourhood of a passage."""
    paragraph = words.paragraph[first]
    lo, hi = max(words.first[paragraph], first - HALF), min(words.last[paragraph], end + HALF)
    own = words.hash[lo:hi].tolist()
    best = None
    for t, like in known[family]:
        share, a, b = aligned(t, own)
        if fits(t, share, a, b) and (best is None or (share * len(t), share) > (best[3], best[0])):
            best = (share, lo + a, lo + b, share * len(t), like)
    return best


def settled(words: Words, hits: list[tuple]) -> list[list]:
    """[family, first word, end word, probability, share] of a text's notices, from (words, probability, family, share, first, end, like).

    Where two families stand near each other, over the same words or one by a template that fits notices of others too,
    the family of more words in common there stands, then the likelier one. What is left of a family and touches is one notice.
    """
    hits = sorted(set(hits), key=lambda h: (h[4], h[5], h[2]))
    near = lambda x, y: x[4] < y[5] + PASSAGE and y[4] < x[5] + PASSAGE and words.paragraph[x[4]] == words.paragraph[y[4]]
    rivals = lambda x, y: x[6] or y[6] or x[4] < y[5] and y[4] < x[5]

    def weight(x):
        own = {(h[4], h[5]): (h[0], h[1]) for h in hits if h[2] == x[2] and near(h, x)}
        return sum(n for n, _ in own.values()), max(q for _, q in own.values())

    kept = [x for x in hits if not any(y[2] != x[2] and near(x, y) and rivals(x, y) and (weight(y), x[2]) > (weight(x), y[2]) for y in hits)]
    joined: list[list] = []
    for _, q, family, share, a, b, _ in sorted(kept, key=lambda h: (h[2], h[4], h[5])):
        if joined and joined[-1][0] == family and a <= joined[-1][2] + GAP:
            joined[-1][2:] = [max(x, y) for x, y in zip(joined[-1][2:], (b, q, share), strict=True)]
        else:
            joined.append([family, a, b, q, share])
    return joined


def scan(texts: list[str | None], model: Classifier, known: dict) -> list[list[tuple[str, int, int, float, float]]]:
    """(family, start, end, probability, template share) of each text's notices, by place."""
    out: list[list] = []
    for group in groups([encoded(t or "") for t in texts]):
        words = Words(group)
        p, first, end = model.probabilities(words)
        found: list[list] = [[] for _ in group]
        best = p[:, :NONE].argmax(axis=1) if len(p) else np.empty(0, int)
        for k in np.flatnonzero(p[:, :NONE].max(axis=1, initial=0) >= PROBABILITY):
            hit = confirmed(words, FAMILIES[best[k]], first[k], end[k], known)
            if hit:
                found[words.text[first[k]]].append((hit[3], float(p[k, best[k]]), FAMILIES[best[k]], *hit[:3], hit[4]))
        for i, hits in enumerate(found):
            one = settled(words, hits)
            if one:  # code points before each byte of the text
                at = np.append(0, np.cumsum((np.frombuffer(group[i], np.uint8) & 0xC0) != 0x80))
                place = lambda byte: int(at[byte - words.begins[i]])  # noqa: B023, E731
                one = sorted([f, place(words.start[a]), place(words.end[b - 1]), round(q, 4), round(share, 4)] for f, a, b, q, share in one)
            out.append([tuple(n) for n in sorted(one, key=lambda n: (n[1], n[2], n[0]))])
    return out


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, PIECE bytes at once but for longer ones."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def unknown_passages(docs: DataFrame, text_col: str) -> list[np.ndarray]:
    """The words (hashes) of the UNKNOWN passages of smallest hash, over all passages of all texts."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kept = 0, {}
        for b in it:
            for group in groups([encoded(t or "") for t in b.column(0).to_pylist()]):
                words = Words(group)
                _, first, end = words.passages()
                n += len(first)
                total = np.append(np.uint64(0), np.cumsum(words.hash * np.uint64(2) + np.uint64(1)))
                h = mixed(total[end] - total[first])
                low = np.argsort(h, kind="stable")[:UNKNOWN]
                kept |= {int(h[i]): words.hash[first[i] : end[i]].tobytes() for i in low}
                if len(kept) > 4 * UNKNOWN:
                    kept = dict(sorted(kept.items())[:UNKNOWN])
        rows = [(0, n, None), *((1, h - 2**63, w) for h, w in sorted(kept.items())[:UNKNOWN])]
        kind, value, passage = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(passage, pa.binary())], names=["kind", "h", "words"])

    found = saved(docs.select(F.coalesce(text_col, F.lit(""))).mapInArrow(tasks, "kind int, h long, words binary"), "unknown")
    total = found.filter("kind = 0").agg(F.sum("h")).first()[0] or 0
    sample = found.filter((F.col("kind") == 1) & low_hash(F.col("h"), UNKNOWN, total)).select("h", "words").distinct().orderBy("h", "words").limit(UNKNOWN).collect()
    return [np.frombuffer(r.words, np.uint64) for r in sample]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, notices): for each row of docs its confirmed notices."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((trained(unknown_passages(docs, text_col)), known_templates()))  # BITS and the notices bound it
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ("family", "start", "end", "probability", "similarity")
    shape = pa.list_(pa.struct(list(zip(fields, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for b in it:
            found = [[dict(zip(fields, n, strict=True)) for n in x] for x in scan(b.column(1).to_pylist(), model, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=["id", "notices"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, notices array<struct<family:string,start:long,end:long,probability:double,similarity:double>>").withColumnRenamed("id", id_col)


def op3_license(docs: DataFrame) -> DataFrame:
    """(doc_id, n_notices, families, spans): families sorted and comma-joined; spans as family:start:end."""
    notices = F.col("notices")
    return scan_licenses(docs).select(
        "doc_id",
        F.size(notices).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda n: n["family"]))), ",").alias("families"),
        F.array_join(F.transform(notices, lambda n: F.concat_ws(":", n["family"], n["start"].cast("string"), n["end"].cast("string"))), ",").alias("spans"),
    )
