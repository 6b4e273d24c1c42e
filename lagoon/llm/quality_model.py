"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of byte classes, word lengths, repetition of words and word pairs,
lines, entropy) are computed from its bytes, vectorised over a batch. The trees are grown on the driver
in numpy over binned statistics of at most about ``MAX_ROWS`` labelled rows, chosen by a hash of the
id, one of each id and label however often its documents are repeated; nothing else is bounded. They are flattened into arrays of complete binary trees, so that
scoring is a vectorised descent of all rows at once, without a Python step per row.

Defined cases: null and empty texts have the statistics of an empty text and get a score like others.
Where no labels, or labels of one class only, are there to learn from, the score is that class's share
of the labels (0.5 without labels). Rows of null id are not held out and never labelled. A
label that an id has repeatedly counts once, contradicting labels of an id once each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import fresh, lean
from lagoon.llm.language_id import held_out
from lagoon.llm.quality_rules import STOP_WORDS

MAX_ROWS = 20_000
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.int64)  # other punctuation
for _k, _bytes in enumerate(
    [range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"#*$%&<>^~=+@", b"|", b"\"'()[]{}-_/\\`", range(0xC0, 256), range(0x80, 0xC0)]
):
    _KIND[list(_bytes)] = _k
KINDS = ["lower", "upper", "digit", "space", "break", "stop", "comma", "mark", "symbol", "bar", "punct", "lead", "tail"]
FEATURES = [
    *(f"share_{k}" for k in KINDS), "entropy", "log_chars", "log_words", "mean_word", "sd_word", "max_word",
    "distinct_words", "distinct_pairs", "distinct_quads", "same_as_last", "stop_words", "capital_words", "shout_words", "tagged_words",
    "mean_line", "distinct_lines", "words_a_stop", "worst_part",
]


def _distinct_share(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Distinct values of each row over their number (1 where there are none)."""
    out = np.ones(len(begin) - 1)
    for r in range(len(out)):
        v = values[begin[r] : begin[r + 1]]
        if len(v):
            v = np.sort(v)
            out[r] = (1 + np.count_nonzero(v[1:] != v[:-1])) / len(v)
    return out


class Statistics:
    def __init__(self):
        data, off = K.from_strings(sorted(set(STOP_WORDS)))
        self.stops = np.sort(K.word_hashes(data, off[:-1], off[1:]))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in K.slices(offsets, K.CHUNK // 2)]
        return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        size = np.diff(offsets)
        row = np.repeat(np.arange(n), size)
        table = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
        kinds = np.stack([table[:, _KIND == k].sum(1) for k in range(len(KINDS))], axis=1)
        p = table / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        chars = size - kinds[:, KINDS.index("tail")]

        low = K.lower(data)
        starts, ends, first = K.spans(low, offsets, K.SPACED)
        words = K.word_hashes(low, starts, ends)
        count = np.diff(first)
        of = np.repeat(np.arange(n), count)
        length = (ends - starts).astype(float)
        some = np.maximum(count, 1)
        by_row = lambda x: np.bincount(of, weights=x, minlength=n)
        mean = by_row(length) / some
        sd = np.sqrt(np.maximum(by_row(length**2) / some - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        at = np.minimum(np.searchsorted(self.stops, words), len(self.stops) - 1)
        stop = self.stops[at] == words
        kind = _KIND[data]
        cap = kind[starts] == 1 if len(starts) else np.zeros(0, bool)
        ups = np.concatenate([[0], np.cumsum(kind == 1)])
        upper = ups[ends] - ups[starts]
        shout = (upper >= 2) & (2 * upper > ends - starts)
        last = kind[ends - 1] if len(ends) else np.zeros(0, np.int64)
        tagged = (last == 8) | (last == 9) | ((last == 7) & shout)
        pairs, pb = K.shingles(words, first, 2)
        quads, qb = K.shingles(words, first, 4)
        # the worst hundred words: a text may be junk in part
        odd = (same | shout | tagged).astype(float)
        block = np.arange(len(words)) - first[of] if len(words) else np.zeros(0, np.int64)
        block = block // 100
        worst = np.zeros(n)
        if len(words):
            cell = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])]))
            share = np.add.reduceat(odd, cell) / np.diff(np.append(cell, len(words)))
            np.maximum.at(worst, of[cell], share)
        lines, lb = self._lines(low, offsets)
        out = np.stack(
            [
                *(kinds / np.maximum(size, 1)[:, None]).T, entropy, np.log1p(chars), np.log1p(count), mean, sd, longest,
                _distinct_share(words, first), _distinct_share(pairs, pb), _distinct_share(quads, qb), by_row(same) / some, by_row(stop) / some,
                by_row(cap) / some, by_row(shout) / some, by_row(tagged) / some, chars / np.maximum(np.diff(lb), 1), _distinct_share(lines, lb),
                count / (1 + kinds[:, KINDS.index("stop")]), worst,
            ],
            axis=1,
        )
        return out.astype(np.float32)

    @staticmethod
    def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(256, bool)
        keep[10] = False
        starts, ends, first = K.spans(data, offsets, keep)
        return K.word_hashes(data, starts, ends), first


class Trees:
    """Boosted complete binary trees, flattened: feature and threshold of inner nodes, leaf values."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature = np.zeros((0, 2**depth - 1), dtype=np.int32)
        self.threshold = np.zeros((0, 2**depth - 1), dtype=np.float32)
        self.leaf = np.zeros((0, 2**depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 4.0, least: float = 6.0) -> Trees:
    """Grows the trees level by level on histograms of gradients and curvatures."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Trees(depth, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    model = Trees(depth, float(np.log(share / (1 - share))))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    margin = np.full(n, model.start)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        f, t = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            base, wide = 2**level - 1, 2**level
            local = node - base
            best = np.zeros(wide)
            for j in range(d):
                m = len(edges[j])
                if not m:
                    continue
                key = local * (m + 1) + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=wide * (m + 1)).reshape(wide, m + 1)
                hs = np.bincount(key, weights=h, minlength=wide * (m + 1)).reshape(wide, m + 1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], f[base + k], t[base + k] = top[k], j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        last = node - inner
        value = rate * np.bincount(last, weights=g, minlength=inner + 1) / (np.bincount(last, weights=h, minlength=inner + 1) + ridge)
        margin += value[last]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    model.feature, model.threshold, model.leaf = np.array(features), np.array(thresholds), np.array(leaves)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, max_rows: int = MAX_ROWS) -> Trees:
    """Trees learned from labelled rows outside the held-out fold."""
    use = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds, fold)).select(
        F.col(id_col).alias("_i"), (F.col(label_col) > 0).cast("double").alias("_y")
    ).distinct()
    n = use.count()
    if n > max_rows:  # about max_rows of them, by a hash of the id
        use = use.where(F.pmod(F.xxhash64("_i"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    stats = Statistics()

    def run(batches):
        for batch in batches:
            x = stats(*K.buffers(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "y", "x"])

    # the labels are a bounded sample of two numbers a row: broadcast, so that texts are not shuffled
    picked = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(use), F.col("_d") == F.col("_i"))
    # one row of each id and label, the smallest, so that repeated documents add nothing
    once = picked.select(F.xxhash64("_i").alias("h"), "_y", "_t").mapInArrow(lean(run), "h long, y double, x binary").groupBy("h", "y").agg(F.min("x").alias("x"))
    got = once.select("y", "x").collect()
    if not got:
        return Trees(4, 0.0)
    rows = sorted((r.x, r.y) for r in got)  # an order of its own: sums of floats depend on it
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(len(rows), -1)
    return fit(x, np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """id_col, score and boolean columns ``extra`` of each row; no shuffle."""
    extra = extra or []
    stats = Statistics()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = model.score(stats(*K.buffers(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), *[batch.column(2 + k) for k in range(len(extra))]], names=[id_col, "score", *extra])

    schema = f"`{id_col}` {kind}, score double" + "".join(f", `{e}` boolean" for e in extra)
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t"), *extra).mapInArrow(lean(run), schema)


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    model = train(docs, labels, folds=folds, fold=fold)
    base = docs.select("doc_id", "text", held_out("doc_id", folds, fold).alias("held_out"))
    out = score(base, model, extra=["held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, as they are; no shuffle."""
    model = train(docs, labels, text_col=text_col)
    stats = Statistics()

    def run(batches):
        for batch in batches:
            good = model.score(stats(*K.buffers(batch.column(batch.num_columns - 1)))) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(good))

    if not docs.columns:
        return docs
    return docs.withColumn(fresh(docs, "_text_to_score"), F.col(text_col).cast("string")).mapInArrow(lean(run), docs.schema)
