"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; a binary n-gram classifier predicts each bit. A bit's classifier is a
multinomial log-odds model of the n-gram counts of the languages whose bit is 1 against those whose
bit is 0, with a scale and offset fitted by logistic regression. Decoding is loss-weighted: a
codeword's loss is the sum of logistic losses of its bits' margins, each weighted by how well the bit
was predicted in training; the codeword of the least loss is chosen, and ``ambiguous`` marks answers
whose two best losses are closer than ``GAP``.

n-gram counts cover every training row: tasks count, then sum by (language, block of cells), and a
block's languages are added up to bits where they lie. What reaches the driver is the languages' names
and totals, and bits x cells weights, whose number grows with the logarithm of the languages: thousands
of dirty labels cost no more than 50 MB. A task holds the counts of ``HELD`` languages at once. Only the
scales are fitted on a bounded sample (``MAX_SCALE_ROWS`` rows, chosen by a hash of the id).

Defined cases: null texts and texts without a letter get ``und`` and score 0, as does every text where
nothing was learned; with one learned language every text with a letter gets it, score 1. Rows of null
id are not held out and are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import cut, lean, width

CELL_BITS = 15
SIZES = (2, 3, 4)
CELLS = len(SIZES) << CELL_BITS
BLOCK = 8192
GAP = 0.5
SLICE = K.CHUNK // 2  # bytes whose n-grams are held at once
MAX_SCALE_ROWS = 8000
HELD = 64

# ASCII other than letters counts as one space
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """(k x bits) of 0/1: exhaustive for up to 7 classes, else random of about 10 log2 k bits."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.int8)
    if k <= 7:
        bits = np.arange(1, 2 ** (k - 1))
        rest = ((bits[None, :] >> np.arange(k - 1)[:, None]) & 1).astype(np.int8)
        return np.vstack([np.zeros(len(bits), np.int8), rest])
    rng = np.random.default_rng(seed)
    n = int(np.ceil(10 * np.log2(k)))
    best, most = None, 0
    tries = 0
    while best is None or tries < min(50, 2 * 10**8 // k**2):  # the best of some draws, of as many as a distinct one takes
        tries += 1
        code = rng.integers(0, 2, (k, n)).astype(np.int8)
        code = code[:, (code.min(0) != code.max(0))]
        sign = (2 * code - 1).astype(np.float32)
        apart = code.shape[1]
        for i in range(0, k, 1024):  # codewords agree in (bits + product) / 2 places
            like = sign[i : i + 1024] @ sign.T
            like[np.arange(len(like)), np.arange(i, i + len(like))] = -code.shape[1]
            apart = min(apart, int(code.shape[1] - like.max()) // 2)
        if apart > most:
            best, most = code, apart
    return best


def grams(data: np.ndarray, offsets: np.ndarray):
    """(cell, row) of each n-gram of each row, for a bounded slice; n-grams don't cross rows."""
    c = _CLASS[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = len(c)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes to the row's end
    left = np.minimum(left, 99).astype(np.int8)
    for k, size in enumerate(SIZES):
        if n < size:
            continue
        m = n - size + 1
        code = c[:m].copy()
        for j in range(1, size):
            code = (code << np.uint32(8)) | c[j : j + m]
        ok = left[:m] >= size
        code *= np.uint32(2654435761)
        code >>= np.uint32(32 - CELL_BITS)
        cell = code.astype(np.int32) + np.int32(k << CELL_BITS)
        yield cell[ok], row[:m][ok]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter (Unicode L)."""
    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = hits[offsets[1:]] > hits[offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[r] = any(ch.isalpha() for ch in bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace"))
    return out


def _count(batches):
    """(lang, block, counts) of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = K.buffers(batch.column(1))
        for a, b in K.slices(offsets, SLICE):
            here = sorted(set(langs[a:b]))
            number = {x: i for i, x in enumerate(here)}
            kind = np.array([number[x] for x in langs[a:b]], dtype=np.int64)
            for cell, row in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                sums = np.bincount(kind[row] * CELLS + cell, minlength=len(here) * CELLS).reshape(len(here), CELLS)
                for x, s in zip(here, sums, strict=True):
                    total[x] = total[x] + s if x in total else s
                if len(total) > HELD:
                    yield _blocks(total)
                    total = {}
    if total:
        yield _blocks(total)


def _blocks(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    parts = [(x, b // BLOCK, s[b : b + BLOCK].astype("<i8").tobytes()) for x, s in total.items() for b in range(0, CELLS, BLOCK)]
    return _sums_batch(parts)


def _sums_batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], names=["lang", "block", "counts"])


def _sum(batches):
    """Sums of the rows of a stream sorted by (lang, block), with the number of n-grams in each."""
    key, acc = None, None

    def out():
        parts = _sums_batch([(*key, acc.tobytes())])
        return pa.RecordBatch.from_arrays([*parts.columns, pa.array([int(acc.sum())], pa.int64())], names=["lang", "block", "counts", "total"])

    for batch in batches:
        for lang, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, block) != key:
                if key is not None:
                    yield out()
                key, acc = (lang, block), np.zeros(BLOCK, "<i8")
            acc += np.frombuffer(raw, "<i8")
    if key is not None:
        yield out()


def _bit_weights(totals: dict[str, int], number: dict[str, int], code: np.ndarray):
    """Log-odds of a block's cells for each bit, from rows (lang, block, counts) sorted by block.

    Each language weighs the same, so that a rare one is as well told from the rest.
    """
    ones = code.sum(0)

    def run(batches):
        last, one, every = None, None, None

        def out():
            w = np.log(one / ones[:, None]) - np.log((every - one) / (len(code) - ones)[:, None])
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.ascontiguousarray(w.T, np.float32).tobytes()], pa.binary())], names=["block", "weights"])

        for batch in batches:
            for lang, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last:
                    if last is not None:
                        yield out()
                    last, one, every = block, np.zeros((code.shape[1], BLOCK)), np.zeros(BLOCK)
                share = (np.frombuffer(raw, "<i8") + 0.5) / (totals[lang] + 0.5 * CELLS)
                every += share
                one[code[number[lang]] == 1] += share
        if last is not None:
            yield out()

    return run


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        self.scale = np.full(code.shape[1], 8.0)
        self.offset = np.zeros(code.shape[1])
        self.trust = np.ones(code.shape[1])

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit (rows x bits)."""
        n = len(offsets) - 1
        out = np.zeros((n, self.code.shape[1]))
        number = np.zeros(n)
        for a, b in K.slices(offsets, SLICE):
            for cell, row in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                if not len(cell):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                at = row[heads] + a
                out[at] += np.add.reduceat(self.weights[cell], heads, axis=0, dtype=np.float64)
                number[at] += np.diff(np.append(heads, len(cell)))
        return out / np.maximum(number, 1)[:, None]

    def fit_scales(self, raw: np.ndarray, lang: np.ndarray) -> None:
        if not len(raw):
            return
        for b in range(self.code.shape[1]):
            y = self.code[lang, b].astype(float)
            x = raw[:, b]
            spread = x.std() or 1.0
            s, o = 1.0 / spread, 0.0
            for _ in range(30):  # Newton steps of a two-parameter logistic regression with a ridge
                p = 1 / (1 + np.exp(-np.clip(s * x + o, -30, 30)))
                w = p * (1 - p) + 1e-6
                g = np.array([((y - p) * x).sum() - 1e-3 * s * spread**2, (y - p).sum() - 1e-3 * o])
                h = np.array([[(w * x * x).sum() + 1e-3 * spread**2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
                d = np.linalg.solve(h, g)
                s, o = s + d[0], o + d[1]
                if np.abs(d).max() < 1e-6:
                    break
            self.scale[b], self.offset[b] = s, o
            self.trust[b] = max(0.05, 2 * ((s * x + o > 0) == (y > 0.5)).mean() - 1)

    def decode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of rows."""
        n, k = len(raw), len(self.langs)
        if k == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        margin = raw * self.scale + self.offset
        if_one, if_none = (np.logaddexp(0, x) * self.trust for x in (-margin, margin))
        loss = if_none.sum(1, keepdims=True) + (if_one - if_none) @ self.code.T
        # a class differs from another in about half of the bits: scale to one bit's loss
        loss *= 2 / self.trust.sum()
        order = np.sort(loss, axis=1)
        p = np.exp(order[:, :1] - loss)
        return loss.argmin(1), 1 / p.sum(1), order[:, 1] - order[:, 0] < GAP


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of all rows of ``docs`` that have an id and a language; None where there is none."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")
    )
    parts = width(docs.sparkSession)
    sums = cut(
        rows.select("lang", "text").mapInArrow(lean(_count), "lang string, block int, counts binary")
        .repartition(parts, "lang", "block").sortWithinPartitions("lang", "block").mapInArrow(_sum, "lang string, block int, counts binary, total long")
    )
    totals = {r.lang: r.n for r in sums.groupBy("lang").agg(F.sum("total").alias("n")).collect()}  # a name and a number each
    langs = sorted(totals)
    if not langs:
        return None
    code = codewords(len(langs))
    weights = np.zeros((CELLS, code.shape[1]), dtype=np.float32)
    if code.shape[1]:
        add = _bit_weights(totals, {x: i for i, x in enumerate(langs)}, code)
        blocks = sums.select("lang", "block", "counts").repartition(parts, "block").sortWithinPartitions("block", "lang").mapInArrow(lean(add), "block int, weights binary")
        for r in blocks.collect():  # CELLS x bits
            weights[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float32).reshape(BLOCK, -1)
    model = Model(langs, code, weights)
    if len(langs) > 1:
        n = rows.count()
        # of n rows about MAX_SCALE_ROWS, by a hash of the id
        sample = rows.where(F.pmod(F.col("h"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, MAX_SCALE_ROWS / max(n, 1))) + 1)
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            m = sent.value
            for batch in batches:
                raw = m.raw(*K.buffers(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in raw], pa.binary())], names=["lang", "raw"])

        got = sample.select("lang", "text").mapInArrow(lean(score), "lang string, raw binary").collect()
        number = {x: i for i, x in enumerate(langs)}
        if got:
            model.fit_scales(np.frombuffer(b"".join(r.raw for r in got)).reshape(len(got), -1), np.array([number[r.lang] for r in got]))
        sent.unpersist()
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """id_col, lang_pred, score and ambiguous of each row (and boolean columns ``extra`` as they are)."""
    extra = extra or []
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = sent.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            letter = has_letter(data, offsets)
            n = batch.num_rows
            if m is None:
                pred, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            else:
                best, score, unsure = m.decode(m.raw(data, offsets))
                pred = [m.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
                score, unsure = np.where(letter, score, 0.0), unsure & letter
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure), *[batch.column(2 + k) for k in range(len(extra))]],
                names=[id_col, "lang_pred", "score", "ambiguous", *extra],
            )

    schema = f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean" + "".join(f", {e} boolean" for e in extra)
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t"), *extra).mapInArrow(lean(run), schema)


def report(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from rows that aren't held out."""
    model = train(docs.where(~held_out("doc_id", folds, fold)))
    base = docs.select("doc_id", "text", held_out("doc_id", folds, fold).alias("held_out"))
    return predict(base, model, extra=["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
