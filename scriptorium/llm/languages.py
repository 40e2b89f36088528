"""Languages of texts by spans: script ranges narrow the candidates, Viterbi labels the words.

A word is a run of letters. Its score for a language is the sum over its letters, and the boundary behind it, of the log
probabilities of the n-grams that end there, of one to ORDERS letters, averaged over the lengths; an n-gram may begin
with the boundary before the word. Languages that use the script of a word's first letter are its candidates; if none
does, all are. Viterbi finds the labels of a text's words with the highest sum of scores, each change of language costing
a penalty. Words of one label in a row are a span. A text has the language with most letters in its spans.

Counts come from at most SAMPLE documents of each language, those of smallest hash, whole; they are hashed to BUCKETS for
each length and smoothed towards the mean of the languages, so that n-grams which no language has count for none.
What goes to the tasks is one table of ORDERS x BUCKETS numbers a language.

Texts are scored in pieces of bounded size, and all of a batch go through Viterbi side by side.

Defined cases: a null text, and one without letters, is und with score 0; with nothing to learn from every text is;
documents of null language, null id or null text teach nothing; a null id is not held out; of equally many letters the
language goes first that more documents have, then the smaller name; texts and words may be of any length; repeated rows
are documents of their own; other columns, of any names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import low_hash, small_batches

#: Longest n-gram; buckets for each length; documents of a language that the counts come from.
ORDERS, BUCKETS, SAMPLE = 5, 1 << 15, 4096
#: What a change of language costs; weight of the languages' mean; a language's least share of letters in a script it uses.
PENALTY, MEAN_WEIGHT, SCRIPT_SHARE = 8.0, 0.1, 0.05
#: How much of a text's scores its confidence takes: neighbouring n-grams say much of the same.
TEMPER = 0.3
#: Characters scored at once.
PIECE = 1 << 20

#: First and last code point of the scripts' main blocks. Fixed values of the Unicode standard.
SCRIPTS = (
    ("Latin", 0x0041, 0x02AF), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Syriac", 0x0700, 0x074F),
    ("Arabic", 0x0750, 0x077F), ("Thaana", 0x0780, 0x07BF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Oriya", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF), ("Hangul", 0x3130, 0x318F), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x3134F),
)
NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))
OTHER = len(NAMES)
MIX, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@cache
def script_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([lo for _, lo, _ in SCRIPTS]), np.array([hi for _, _, hi in SCRIPTS]), np.array([NAMES.index(n) for n, _, _ in SCRIPTS])


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """The number of each code point's script; OTHER where it is in none."""
    lo, hi, number = script_table()
    at = np.searchsorted(lo, codes, side="right") - 1
    return np.where((at >= 0) & (codes <= hi[at]), number[at], OTHER)


def lowered(text: str) -> str:
    """Lower case of as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, text that each is of, place in it), a boundary around every text; long texts are cut, between words where there is one."""
    held, which, places, size = [], [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                end = next((i for i in range(end, max(at, end - 4096), -1) if not text[i].isalpha()), end)
            codes = np.frombuffer(lowered(text[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
            if size and size + len(codes) > PIECE:
                yield np.concatenate(held), np.concatenate(which), np.concatenate(places)
                held, which, places, size = [], [], [], 0
            held += [np.array([10], np.uint32), codes, np.array([10], np.uint32)]
            which += [np.full(len(codes) + 2, n)]
            places += [np.arange(at - 1, end + 1)]
            size += len(codes) + 2
            at = end
    if held:
        yield np.concatenate(held), np.concatenate(which), np.concatenate(places)


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end (exclusive)."""
    edge = np.flatnonzero(np.diff(letters()[codes].view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, buckets) for each length of n-grams. The places of a word are its letters and the boundary behind."""
    sizes = ends - starts + 1
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(first)) - first  # place in the word
    at = np.repeat(starts, sizes) + inside
    is_end = inside == np.repeat(sizes - 1, sizes)
    c = np.where(letters()[codes], codes, 32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        h = np.concatenate([[np.uint64(0)], h[:-1]]) * MIX + c + np.uint64(1)
        fits = inside + 2 >= n if n > 1 else ~is_end
        g = h[at[fits]]
        g = (g ^ (g >> np.uint64(29))) * FOLD
        yield np.flatnonzero(fits), (g >> np.uint64(64 - 15)).astype(np.int64)


assert BUCKETS == 1 << 15


def count_grams(languages: list[str]):
    """From batches (language, text): (language, place, n), sums of a task; the places are those of the table, then scripts."""
    width = ORDERS * BUCKETS + OTHER + 1
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(number[lang], np.zeros(width, np.int64))
                for codes, _, _ in pieces([text]):
                    starts, ends = words(codes)
                    for n, (_, bucket) in enumerate(grams(codes, starts, ends)):
                        own[n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    own[ORDERS * BUCKETS :] += np.bincount(scripts_of(codes[letters()[codes]]), minlength=OTHER + 1)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "place", "n"])

    return run


class Model:
    """Log probabilities (n-gram bucket x language), candidates of scripts, priors; languages in order of preference."""

    def __init__(self, languages: list[str], documents: list[int], counts: np.ndarray):
        self.languages = languages
        self.prior = np.log(np.array(documents, float) / sum(documents))
        n = counts[:, : ORDERS * BUCKETS].reshape(len(languages), ORDERS, BUCKETS).astype(float)
        share = n / np.maximum(1, n.sum(axis=2, keepdims=True))
        mean = share.mean(axis=0, keepdims=True) + 1e-9
        log = np.log((1 - MEAN_WEIGHT) * share + MEAN_WEIGHT * mean)
        log -= log.mean(axis=0)  # the same for all languages; Viterbi sees differences only
        self.table = np.ascontiguousarray(log.transpose(1, 2, 0) / ORDERS).astype(np.float32)
        script = counts[:, ORDERS * BUCKETS :].astype(float)
        uses = script >= SCRIPT_SHARE * np.maximum(1, script.sum(axis=1, keepdims=True))
        self.candidates = np.where(uses.any(axis=0), uses, True).T  # script x language

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts + 1
        total = np.zeros((int(sizes.sum()), len(self.languages)), np.float32)
        for n, (at, bucket) in enumerate(grams(codes, starts, ends)):
            total[at] += self.table[n, bucket]
        scores = np.add.reduceat(total, np.cumsum(sizes) - sizes, axis=0) if len(sizes) else total
        return np.where(self.candidates[scripts_of(codes[starts])], scores, -np.inf)


def viterbi(scores: np.ndarray, begins: np.ndarray, counts: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word, for sequences that begin at `begins` and have `counts` > 0 words. Staying wins ties."""
    order = np.argsort(-counts, kind="stable")
    off, length = begins[order], counts[order]
    longest = int(length.max(initial=0))
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences with a word at each step
    came, changed = np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    v = prior + scores[off].astype(float)
    for t in range(1, longest):
        a = active[t]
        own = v[:a]
        best = own.argmax(axis=1)
        least = own[np.arange(a), best] - penalty
        at = off[:a] + t
        leaves = own < least[:, None]
        came[at], changed[at] = best, leaves
        # sums stay near 0, so that long texts lose no precision
        v[:a] = np.where(leaves, 0.0, own - least[:, None]) + scores[at]
    label = np.zeros(len(scores), np.int32)
    state = v.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        a = active[t]
        at, own = off[:a] + t, state[:a]
        label[at] = own
        state[:a] = np.where(changed[at, own], came[at], own)
    label[off] = state
    return label


def label_texts(model: Model, texts: list[str | None]) -> tuple[list, list, list]:
    """Language, confidence and spans (start, end, language) of each text."""
    known = [t or "" for t in texts]
    scores, text_of, lo, hi = [], [], [], []
    for codes, which, places in pieces(known):
        starts, ends = words(codes)
        scores.append(model.word_scores(codes, starts, ends))
        text_of.append(which[starts])
        lo.append(places[starts])
        hi.append(places[ends - 1] + 1)
    none = ([None] * len(texts), [0.0] * len(texts), [[] for _ in texts])
    if not scores or not sum(map(len, scores)):
        return none
    scores, text_of, lo, hi = (np.concatenate(x) for x in (scores, text_of, lo, hi))
    begins = np.flatnonzero(np.diff(text_of, prepend=-1))
    label = viterbi(scores, begins, np.diff(np.append(begins, len(text_of))), model.prior, PENALTY)
    n = len(model.languages)
    size = np.bincount(text_of * n + label, hi - lo, len(texts) * n).reshape(-1, n)
    best = size.argmax(axis=1)
    # evidence of the text's own spans, for its language against each other one
    own = label == best[text_of]
    floor = np.where(np.isfinite(scores), scores, -50.0)
    evidence = np.stack([np.bincount(text_of, np.where(own, floor[:, j], 0.0), len(texts)) for j in range(n)], axis=1)
    gap = np.clip((evidence - evidence[np.arange(len(texts)), best][:, None]) * TEMPER, -50, 50)
    sure = 1 / np.exp(gap).sum(axis=1)
    total = size.sum(axis=1)
    confidence = np.where(total > 0, size[np.arange(len(texts)), best] / np.maximum(1, total) * sure, 0.0)
    turn = np.flatnonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    last = np.append(turn[1:], len(text_of)) - 1
    spans = none[2]
    for i, a, b, j in zip(text_of[turn].tolist(), lo[turn].tolist(), hi[last].tolist(), label[turn].tolist(), strict=True):
        spans[i].append((a, b, model.languages[j]))
    return [model.languages[j] if t else None for j, t in zip(best.tolist(), total.tolist(), strict=True)], np.clip(confidence, 0, 1).tolist(), spans


def remainder(ids: Column) -> Column:
    return F.crc32(ids.cast("string")) % 3


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """The model of the documents that may teach."""
    small_batches(docs.sparkSession)
    id_, text = F.col(id_col), F.col(text_col)
    own = docs.filter((remainder(id_) != 1) & F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(id_.cast("string"), text).alias("h"))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    chosen = F.lit(False)
    for x in languages:
        chosen |= (F.col("lang") == x) & low_hash(F.col("h"), sample, sizes[x])
    parts = own.filter(chosen).select("lang", "text").mapInArrow(count_grams(languages), "lang int, place int, n long")
    found = parts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()  # ORDERS x BUCKETS rows a language at most
    counts = np.zeros((len(languages), ORDERS * BUCKETS + OTHER + 1), np.int64)
    counts[found["lang"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, [sizes[x] for x in languages], counts)


SPANS = "array<struct<start:int,end:int,lang:string>>"


def label_languages(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, lang_pred (und: none), score and spans, in code points of the text, of every row."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    small_batches(docs.sparkSession)
    names = [f"__{i}" for i in range(len(keep))]
    given = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, spans = label_texts(model, b.column(0).to_pylist())
            spans = [[{"start": s, "end": e, "lang": x} for s, e, x in row] for row in spans]
            own = [pa.array([x or "und" for x in lang], pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *own], names=[*names, "lang_pred", "score", "spans"])

    kinds = ", ".join(f"`{n}` {given.schema[n].dataType.simpleString()}" for n in names)
    out = given.mapInArrow(run, f"{kinds}{', ' if names else ''}lang_pred string, score double, spans {SPANS}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score", "spans")


def op13_languages(docs: DataFrame) -> DataFrame:
    found = label_languages(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
