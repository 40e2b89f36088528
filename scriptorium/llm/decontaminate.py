"""Benchmark passages in documents by latent semantic retrieval.

Passages are windows of WINDOW words, one every STRIDE words, over whole texts. Document frequencies of the (hashed)
words are counted over all strides. A randomised SVD of TF-IDF passages A gives a latent space: in a second scan tasks
make their parts of A'(A Omega), of RANK + OVERSAMPLE random columns, which are added by term ranges; with their
orthonormal basis Q the tasks of a third scan sum B'B of the projection B = A Q, whose eigenvectors turn Q into the right
singular vectors, and the RANK of largest singular value stay. It is fitted on every passage of every document and of the
benchmark, which weighs as much as the documents.
Every passage of every document is then mapped into the space and searched by cosine against all of the benchmark's
passages, block by block, in one scan of the documents.

A candidate is confirmed on its words: the longest common subsequence with the benchmark passage must cover LCS_SHARE
of it, and its answer terms (those given, else the rarest third of its words) must occur near the hit.

Defined cases: null and empty texts hold nothing; benchmark texts of no words match nothing; an item longer than
ITEM_WORDS is cut into passages of its own, any of which counts; rows of the benchmark that share an id are one item;
repeated rows give a row each; rows without id keep a null id, and ids keep their type; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.llm.common import returned, small_batches
from scriptorium.llm.words import batch_word_hashes, lcs_length

STRIDE = 16
WINDOW = 2 * STRIDE
#: Hashed vocabulary, and columns of the latent space.
VOCABULARY, RANK, OVERSAMPLE = 1 << 15, 128, 16
ITEM_WORDS = 64
COSINE, LCS_SHARE, ANSWER_SHARE = 0.6, 0.65, 0.5
#: Benchmark passages in a block of cosines, and in a broadcast: a larger benchmark is dealt over several workers of the same scan.
ITEM_BLOCK, ITEM_GROUP = 1024, 1 << 16
#: Tokens mapped at once, strides multiplied at once, and ranges of terms in which partial products are added.
CHUNK, FIT_STRIDES, TERM_RANGES = 16384, 4096, 256
#: Terms that are added row by row and not term by term.
FEW_TERMS = 24
BUCKET = np.uint64(VOCABULARY - 1)


def batch_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's begin, the vocabulary index of every word padded to whole strides, and strides of each text."""
    words, counts = batch_word_hashes(texts)
    strides = -(-counts // STRIDE)
    begin = np.cumsum(counts) - counts
    flat = np.full(int(strides.sum()) * STRIDE, VOCABULARY, np.int32)
    flat[np.arange(len(words)) + np.repeat((np.cumsum(strides) - strides) * STRIDE - begin, counts)] = words & BUCKET
    return words, np.append(begin, len(words)), flat, strides


def window_starts(strides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of two strides: its first stride in the batch, and its text. A text of one stride has one window."""
    count = np.maximum(strides - 1, np.minimum(strides, 1))
    text = np.repeat(np.arange(len(strides)), count)
    first = np.cumsum(strides) - strides
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum()), text


def statistics(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int, int]:
    """Strides that hold each vocabulary index, number of strides, and number of windows."""

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, windows = np.zeros(VOCABULARY + 1, np.int64), 0, 0
        for b in it:
            _, _, flat, strides = batch_tokens(b.column(0).to_pylist())
            blocks = flat.reshape(-1, STRIDE)
            n += len(blocks)
            for at in range(0, len(blocks), 8192):
                s = np.sort(blocks[at : at + 8192].astype(np.uint16), axis=1)
                s[:, 1:][s[:, 1:] == s[:, :-1]] = VOCABULARY  # each index counts once
                df += np.bincount(s.ravel(), minlength=VOCABULARY + 1)
            windows += len(window_starts(strides)[0])
        used = np.flatnonzero(df[:VOCABULARY])
        kind, at, count = np.repeat([0, 1], [len(used), 2]), np.append(used, [0, 1]), np.append(df[used], [n, windows])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(count, pa.int64())], names=["kind", "at", "n"])
        del df
        returned()

    found = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(tasks, "kind int, at long, n long")
    df, totals = np.zeros(VOCABULARY, np.int64), [0, 0]
    for kind, at, n in found.groupBy("kind", "at").agg(F.sum("n")).collect():  # VOCABULARY + 2 rows at most
        if kind == 0:
            df[at] = n
        else:
            totals[at] = n
    return df, *totals


def add_rows(total: np.ndarray, tokens: np.ndarray, rows: np.ndarray) -> None:
    """Adds to total[t] the row of the stride of every token t."""
    order = np.argsort(tokens.astype(np.uint16), kind="stable")
    terms, own = tokens[order], order // STRIDE
    start = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    size = np.diff(np.append(start, len(terms)))
    falling = np.argsort(-size, kind="stable")
    start, size = start[falling], size[falling]
    sums = np.zeros((len(start), rows.shape[1]), np.float32)
    place = 0  # tokens of that place among those of their term are added at once, as long as these are many
    while (more := int(np.searchsorted(-size, -place))) >= FEW_TERMS:
        sums[:more] += rows[own[start[:more] + place]]
        place += 1
    for i in range(more):
        sums[i] += rows[own[start[i] + place : start[i] + size[i]]].sum(axis=0)
    total[terms[start]] += sums


def text_windows(flat: np.ndarray, strides: np.ndarray, space: np.ndarray, squares: np.ndarray) -> Iterator[tuple]:
    """(tokens, strides' projections, squared norms of windows of a stride and the next, of windows of one stride) of pieces of a batch.

    space has rows times their term's weight, and squares are those of the weights; norms are 0 where there is no window.
    Pieces share a stride, the last of one and the first of the next; as a window of its own it counts in the latter.
    """
    text, count = np.repeat(np.arange(len(strides)), strides), len(flat) // STRIDE
    for lo in range(0, count, FIT_STRIDES):
        hi = min(count, lo + FIT_STRIDES + 1)
        part, of = flat[lo * STRIDE : hi * STRIDE], text[lo:hi]
        norms = squares[part].reshape(-1, STRIDE).sum(axis=1)
        alone = norms * (strides[of] == 1)
        if hi - lo > FIT_STRIDES:
            alone[-1] = 0
        yield part, stride_vectors(part, space), (norms[:-1] + norms[1:]) * (of[:-1] == of[1:]), alone


def inverse(x: np.ndarray) -> np.ndarray:
    return np.divide(1, x, out=np.zeros_like(x), where=x > 0)


def add_windows(total: np.ndarray, pieces: Iterator[tuple]) -> None:
    """Adds to total the products A'(A Omega) of windows, but for the left factor's weights of terms."""
    for part, own, both, alone in pieces:
        y = (own[:-1] + own[1:]) * inverse(both)[:, None]
        rows = own * inverse(alone)[:, None]
        rows[:-1] += y
        rows[1:] += y
        add_rows(total, part, rows)


def window_gram(pieces: Iterator[tuple]) -> np.ndarray:
    """B'B of the projections B of windows."""
    out = 0
    for _, own, both, alone in pieces:
        for b, norms in ((own[:-1] + own[1:], both), (own[alone > 0], alone[alone > 0])):
            b *= np.sqrt(inverse(norms))[:, None]
            out = out + np.float64(b.T @ b)
    return out


def item_passages(passages: np.ndarray, space: np.ndarray, squares: np.ndarray, weight: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, projections, weights by squared norms) of passages of whole strides, one a row, that weigh `weight`."""
    parts = passages.shape[1] // STRIDE
    for i in range(0, len(passages), FIT_STRIDES // parts):
        some = passages[i : i + FIT_STRIDES // parts]
        norms = squares[some].sum(axis=1)
        yield some, stride_vectors(some.ravel(), space).reshape(len(some), parts, -1).sum(axis=1), np.float32(weight**2) * inverse(norms)


def random_columns() -> np.ndarray:
    rank = RANK + OVERSAMPLE
    return np.vstack([np.random.default_rng(11).standard_normal((VOCABULARY, rank), dtype=np.float32), np.zeros((1, rank), np.float32)])


def latent_space(spark, corpus: DataFrame | np.ndarray, items: list[np.ndarray], idf: np.ndarray, windows: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(VOCABULARY + 1) x RANK right singular vectors, each row times its term's idf; and the singular values.

    corpus is a table of texts, in one column, with so many windows; or an array of windows.
    """
    rank, ranges, terms = RANK + OVERSAMPLE, TERM_RANGES, VOCABULARY
    texts = None if isinstance(corpus, np.ndarray) else corpus
    passages = corpus if texts is None else np.empty((0, WINDOW), np.int32)
    # the benchmark weighs as much as the corpus
    weight = float(np.sqrt(max(1, windows + len(passages)) / max(1, len(items))))
    rows = [(passages[i : i + 2048].astype(np.uint16).tobytes(), 1.0, WINDOW) for i in range(0, len(passages), 2048)]
    for i in range(0, len(items), 2048):
        padded = np.full((min(2048, len(items) - i), ITEM_WORDS), terms, np.uint16)
        for j, w in enumerate(items[i : i + 2048]):
            padded[j, : len(w)] = w
        rows.append((padded.tobytes(), weight, ITEM_WORDS))
    given = spark.createDataFrame(rows, "tokens binary, weight double, width int").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))

    scale = np.append(idf, 0).astype(np.float32)

    def summed(add, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, total = random_columns() * scale[:, None], np.zeros((terms + 1, rank), np.float32)
        for b in it:
            add(b, total, omega, scale * scale)
        total *= scale[:, None]
        for r, block in enumerate(np.split(total[:terms], ranges)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["range", "sums"])
        del omega, total
        returned()

    def pieces_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, float]]:
        for tokens, weight, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield np.frombuffer(tokens, np.uint16).reshape(-1, width), weight

    def of_items(b: pa.RecordBatch, total: np.ndarray, omega: np.ndarray, squares: np.ndarray) -> None:
        for passages, weight in pieces_of(b):
            for some, y, inverses in item_passages(passages, omega, squares, weight):
                add_rows(total, some.ravel(), np.repeat(y * inverses[:, None], some.shape[1] // STRIDE, axis=0))

    def of_texts(b: pa.RecordBatch, total: np.ndarray, omega: np.ndarray, squares: np.ndarray) -> None:
        _, _, flat, strides = batch_tokens(b.column(0).to_pylist())
        add_windows(total, text_windows(flat, strides, omega, squares))

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(terms // ranges * rank)
        for p in parts["sums"]:
            total += np.frombuffer(p, np.float32)
        return pd.DataFrame({"range": parts["range"][:1], "sums": [total.astype(np.float32).tobytes()]})

    sums = given.mapInArrow(partial(summed, of_items), "range int, sums binary")
    if texts is not None:
        # a task's sums are as large as the vocabulary, so tasks are few
        sums = sums.union(texts.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(partial(summed, of_texts), "range int, sums binary"))
    g = np.zeros((ranges, terms // ranges * rank), np.float32)
    for r, row in sums.groupBy("range").applyInPandas(added, "range int, sums binary").toLocalIterator():  # one matrix, a range at a time
        g[r] = np.frombuffer(row, np.float32)
    q = np.zeros((terms + 1, rank), np.float32)
    q[:terms] = g.reshape(terms, rank)
    del g
    for _ in range(2):  # Cholesky QR, twice for accuracy; the matrix itself is never copied
        gram = sum((np.float64(part).T @ np.float64(part) for part in np.array_split(q, 64)), np.zeros((rank, rank)))
        values, axes = np.linalg.eigh(gram)
        keep = values > values.max(initial=0) * 1e-10
        turn = (axes[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        for part in np.array_split(q, 64):
            part[:, : turn.shape[1]] = part @ turn
            part[:, turn.shape[1] :] = 0
    q *= scale[:, None]
    basis = spark.sparkContext.broadcast(q)  # VOCABULARY and RANK bound it

    def projected(gram, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.zeros((rank, rank))
        for b in it:
            small += gram(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["part", "gram"])
        returned()

    def grams_added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": parts["part"][:1], "gram": [sum(np.frombuffer(x) for x in parts["gram"]).tobytes()]})

    def gram_of_items(b: pa.RecordBatch) -> np.ndarray:
        some = (y * np.sqrt(inverses)[:, None] for p, weight in pieces_of(b) for _, y, inverses in item_passages(p, basis.value, scale * scale, weight))
        return sum(np.float64(y.T @ y) for y in some)

    def gram_of_texts(b: pa.RecordBatch) -> np.ndarray:
        _, _, flat, strides = batch_tokens(b.column(0).to_pylist())
        return window_gram(text_windows(flat, strides, basis.value, scale * scale))

    grams = given.mapInArrow(partial(projected, gram_of_items), "part int, gram binary")
    if texts is not None:
        grams = grams.union(texts.mapInArrow(partial(projected, gram_of_texts), "part int, gram binary"))
    grams = grams.groupBy("part").applyInPandas(grams_added, "part int, gram binary").collect()  # 16 rows at most
    small = sum((np.frombuffer(r.gram).reshape(rank, rank) for r in grams), np.zeros((rank, rank)))
    basis.destroy()
    squares, axes = np.linalg.eigh(small)
    turn = axes[:, ::-1][:, :RANK].astype(np.float32)
    space = np.empty((terms + 1, RANK), np.float32)
    for i in range(0, terms + 1, 1024):
        space[i : i + 1024] = q[i : i + 1024] @ turn
    return space, np.sqrt(np.maximum(squares[::-1][:RANK], 0))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def stride_vectors(flat: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = np.empty((len(flat) // STRIDE, space.shape[1]), np.float32)
    for i in range(0, len(flat), CHUNK):
        part = flat[i : i + CHUNK].reshape(-1, STRIDE)
        here = out[i // STRIDE : i // STRIDE + len(part)]
        here[:] = space[part[:, 0]]
        for k in range(1, STRIDE):
            here += space[part[:, k]]
    return out


class Items:
    """Benchmark passages: words, answer terms, and vectors in the latent space."""

    def __init__(self, ids: list, words: list[np.ndarray], answers: list, space: np.ndarray):
        self.ids, self.words, self.answers = ids, words, answers
        self.vectors = unit(np.array([space[(w & BUCKET).astype(int)].sum(axis=0) for w in words], np.float32).reshape(len(words), -1))

    def confirm(self, j: int, words: np.ndarray, at: int) -> tuple[float, float]:
        """(LCS share, answer share) of passage j around the window that starts at word `at`."""
        item = self.words[j]
        near = words[max(0, at - len(item)) : at + WINDOW + len(item)]
        answers = self.answers[j]
        found = set(near.tolist())
        return lcs_length(item.tolist(), near.tolist()) / len(item), sum(a in found for a in answers) / len(answers)


def search(batch: pa.RecordBatch, items: Items, space: np.ndarray, text_at: int) -> list[tuple]:
    """(row of the batch, item, first word of the window, cosine, LCS share, answer share), the best for each pair."""
    words, begin, flat, strides = batch_tokens(batch.column(text_at).to_pylist())
    if not len(flat) or not len(items.ids):
        return []
    start, text = window_starts(strides)
    vectors = stride_vectors(flat, space)
    first = np.cumsum(strides) - strides
    best: dict[tuple, tuple] = {}
    for i in range(0, len(start), 8192):
        s, t = start[i : i + 8192], text[i : i + 8192]
        windows = vectors[s]
        more = strides[t] > 1
        windows[more] += vectors[s[more] + 1]
        windows = unit(windows)
        for block in range(0, len(items.ids), ITEM_BLOCK):
            cosines = windows @ items.vectors[block : block + ITEM_BLOCK].T
            for w, j in np.argwhere(cosines >= COSINE):
                at, item = int(s[w] - first[t[w]]) * STRIDE, block + int(j)
                lcs, answer = items.confirm(item, words[begin[t[w]] : begin[t[w] + 1]], at)
                if lcs >= LCS_SHARE and answer >= ANSWER_SHARE:
                    key, hit = (int(t[w]), items.ids[item]), (lcs, answer, float(cosines[w, j]), -at)
                    best[key] = max(best.get(key, hit), hit)
    return [(row, item, -at, cosine, lcs, answer) for (row, item), (lcs, answer, cosine, at) in best.items()]


def benchmark_passages(benchmark: DataFrame, idf: np.ndarray, id_col: str, text_col: str, answer_col: str | None) -> tuple[list, list, list]:
    """Ids, word ids and answer terms of the benchmark's passages: some 600 bytes each, in the driver."""
    ids, parts_of, answers = [], [], []
    rows = benchmark.select(id_col, text_col, F.col(answer_col) if answer_col else F.lit(None).cast("string")).filter(F.col(text_col).isNotNull())
    for item, text, answer in rows.orderBy(id_col, text_col).toLocalIterator():
        words = batch_word_hashes([text])[0]
        given = batch_word_hashes([answer])[0].tolist()
        for w in np.array_split(words, max(1, -(-len(words) // ITEM_WORDS))):
            if len(w):
                rare = sorted(set(w.tolist()), key=lambda x: (-idf[x & (VOCABULARY - 1)], x))
                ids.append(item)
                parts_of.append(w)
                answers.append(given or rare[: max(1, len(rare) // 3)])
    return ids, parts_of, answers


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep ..., hits) for each row of docs; keep names columns of docs (by default all). hits is an array of item_id,
    first_word, cosine, lcs_share and answer_share, one for each item found in the text, in the order of the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.columns if keep is None else keep
    kind = benchmark.schema[item_col].dataType
    hit = f"array<struct<item_id:{kind.simpleString()},first_word:long,cosine:double,lcs_share:double,answer_share:double>>"
    df, total, windows = statistics(docs, text_col)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)
    ids, words, answers = benchmark_passages(benchmark, idf, item_col, item_text_col, answer_col)
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    space = latent_space(spark, texts, [(w & BUCKET).astype(np.int32) for w in words], idf, windows)[0] if words else np.zeros((VOCABULARY + 1, RANK), np.float32)
    out = docs.select(*[F.col(c) for c in keep], F.coalesce(text_col, F.lit("")).alias("__text"), F.array().cast(hit).alias("hits"))
    width, ddl = len(keep), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for lo in range(0, len(ids), ITEM_GROUP):
        own = slice(lo, lo + ITEM_GROUP)
        shared = spark.sparkContext.broadcast((Items(ids[own], words[own], answers[own], space), space))  # ITEM_GROUP and VOCABULARY bound it

        def marked(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, space = shared.value
            fields = ("item_id", "first_word", "cosine", "lcs_share", "answer_share")
            shape = pa.list_(pa.struct(list(zip(fields, (to_arrow_type(kind), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))))
            for b in it:
                hits = [{h["item_id"]: h for h in x} for x in b.column(width + 1).to_pylist()]
                for row, *found in search(b, items, space, width):
                    h = dict(zip(fields, (found[0], found[1], *(round(float(x), 6) for x in found[2:])), strict=True))
                    # parts of one item may lie in two groups
                    last = hits[row].get(h["item_id"])
                    if last is None or (h["lcs_share"], h["answer_share"]) > (last["lcs_share"], last["answer_share"]):
                        hits[row][h["item_id"]] = h
                yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], pa.array([list(x.values()) for x in hits], shape)], names=b.schema.names)
            returned()

        out = out.mapInArrow(marked, ddl)
    return out.drop("__text")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item_id, first_word, cosine, lcs_share, answer_share): one row for each document and item found in it."""
    marked = mark_contamination(docs, benchmark, text_col, item_col, item_text_col, answer_col, keep=[id_col])
    return marked.select(id_col, F.explode("hits").alias("hit")).select(id_col, "hit.*")


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs, benchmark)
