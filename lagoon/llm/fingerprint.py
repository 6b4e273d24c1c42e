"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Each distinct word shingle is hashed once; the hash's bin keeps its smallest value. An empty bin
takes the value of a bin that a universal hash of (bin, attempt) chooses, the first non-empty one
(optimal densification). Of each bin ``BITS`` low-order bits of a value mixed with the bin's number
are stored, so that a value copied into many bins of a short text does not agree by one chance in all
of them. Two fingerprints that agree in a share m of bins have the estimated similarity
(m - c) / (1 - c), c = 2 ** -bits (bias correction), cut to 0..1.

Defined cases: a null text is an empty one; texts without words have the fingerprint ``""``, whose
likeness to itself is 1 and to any other 0. Rows of equal id follow each other by text; rows of null
id come first. An empty table gives no rows. Extra columns are ignored. Ids of the report that are no whole
numbers raise ValueError; ``fingerprints`` takes ids of any type. Rows of one id, and of null id, are one
range: they are streamed by one task in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import lean, whole_number, width

U64 = np.uint64
BINS = 512
BITS = 4
EMPTY = U64(2**64 - 1)
RANGES = 16_384  # ranges of ids at most: their bounds are in the plan; a range is streamed, whatever its size


def _probes(bins: int) -> np.ndarray:
    """(attempt, bin) -> the bin to try; the last attempt falls back to a scan."""
    attempt, slot = np.meshgrid(np.arange(64, dtype=U64), np.arange(bins, dtype=U64), indexing="ij")
    return (K.mix(attempt * U64(1 << 32) + slot, 61) % U64(bins)).astype(np.int64)


def densify(low: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row (rows with at least one filled bin)."""
    out = low.copy()
    bins = low.shape[1]
    r, c = np.nonzero(low == EMPTY)
    attempt = 0
    while len(r):
        if attempt < len(probes):
            pick = probes[attempt][c]
        else:
            pick = (K.mix(U64(attempt) * U64(1 << 32) + c.astype(U64), 61) % U64(bins)).astype(np.int64)
        got = low[r, pick]
        ok = got != EMPTY
        out[r[ok], c[ok]] = got[ok]
        r, c = r[~ok], c[~ok]
        attempt += 1
    return out


class Fingerprinter:
    def __init__(self, shingle: int = 5, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins: a power of two; bits: 1, 2, 4 or 8")
        self.shingle, self.bins, self.bits = shingle, bins, bits
        self.probes = _probes(bins)
        self.tags = K.mix(np.arange(bins, dtype=U64), 63)

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x bins codes, which rows have words)."""
        n = len(offsets) - 1
        low = np.full(n * self.bins, EMPTY, dtype=U64)
        has = np.zeros(n, bool)
        for a, b in K.slices(offsets):
            part, off = K.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            starts, ends, first = K.spans(part, off, K.SPACED)
            h, begin = K.shingles(K.word_hashes(part, starts, ends), first, self.shingle)
            row = np.repeat(np.arange(a, b), np.diff(begin))
            slot = row * self.bins + (h >> U64(40)).astype(np.int64) % self.bins
            np.minimum.at(low, slot, h << U64(24))
            has[a:b] = np.diff(begin) > 0
        low = low.reshape(n, self.bins)
        out = np.zeros((n, self.bins), dtype=np.uint8)
        live = np.flatnonzero(has)
        for i in range(0, len(live), 256):
            rows = live[i : i + 256]
            out[rows] = (K.mix(densify(low[rows], self.probes) ^ self.tags, 65) >> U64(64 - self.bits)).astype(np.uint8)
        return out, has

    def pack(self, codes: np.ndarray, has: np.ndarray) -> list[str]:
        """Hexadecimal text of the codes, most significant first."""
        per = 8 // self.bits
        packed = np.zeros((len(codes), self.bins // per), dtype=np.uint8)
        for k in range(per):
            packed |= codes[:, k::per] << np.uint8(8 - self.bits * (k + 1))
        return [p.tobytes().hex() if h else "" for p, h in zip(packed, has, strict=True)]

    def likeness(self, a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
        chance = 2.0**-self.bits
        raw = (a == b).mean(axis=1) if len(a) else np.zeros(0)
        est = np.clip((raw - chance) / (1 - chance), 0, 1)
        return np.where(has_a & has_b, est, (has_a == has_b).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """id_col, fingerprint of every row; no shuffle."""
    fp = Fingerprinter(**shape)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp.pack(*fp.codes(*K.buffers(batch.column(1)))), pa.string())], names=[id_col, "fingerprint"]
            )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(lean(run), f"`{id_col}` {kind}, fingerprint string")


def hex_likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Likeness of two packed fingerprints of 4 bits a bin, without Python."""
    if bits != 4:
        raise ValueError("one hexadecimal digit must be one bin")
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] == p["y"]))
    raw = same / F.greatest(F.length(a), F.lit(1))
    est = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - 2.0**-bits) / (1 - 2.0**-bits)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(est)


def _bounds(docs: DataFrame, id_col: str, parts: int) -> tuple[list[int], int | None, int]:
    """Ids that begin ranges of about equal rows (``parts`` - 1 values at most), the smallest id, rows."""
    q = [k / parts for k in range(1, parts)] or [0.5]
    row = docs.agg(
        F.min(id_col).alias("lo"), F.percentile_approx(id_col, q, 20 * parts).alias("q"),
        F.count("*").alias("n"), F.count(id_col).alias("known"),
    ).first()
    cuts = sorted(set(row.q or []) - {row.lo}) if parts > 1 else []
    return cuts, (None if row.known < row.n else row.lo), row.n


def _range_of(id_col: str, bounds: list[int]) -> Column:
    """Number of bounds not above the id, by a two-level search of about 2 * sqrt(n) steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*[F.lit(int(b)) for b in bounds])
    coarse = F.array(*[F.lit(int(b)) for b in bounds[::step]])
    key = F.col(id_col)
    group = F.size(F.filter(coarse, lambda b: b <= key))
    base = F.greatest(group - 1, F.lit(0)) * step
    inner = F.size(F.filter(F.slice(fine, base + 1, F.lit(step)), lambda b: b <= key))
    return F.when(key.isNull() | (group == 0), F.lit(0)).otherwise(base + inner)


def _pairs(fp: Fingerprinter):
    """Rows sorted by (range, copy, id, text): each with its successor, over bounded blocks."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def block(rows, after):
        """rows: (id, text); after: the text that follows the last."""
        texts = [t for _, t in rows] + [after]
        edited = []
        for t, u in zip(texts[:-1], texts[1:], strict=True):
            k = len(t) // 4
            edited.append((t[: len(t) - k] + u[:k]) if k else t)
        own, has = fp.codes(*K.from_strings(texts))
        new, has_new = fp.codes(*K.from_strings(edited))
        n = len(rows)
        cols = [
            [i for i, _ in rows], [len(t) for t in texts[:n]], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            fp.pack(own[:n], has[:n]), fp.pack(new, has_new),
            fp.likeness(own[:n], has[:n], new, has_new), fp.likeness(own[:n], has[:n], own[1:], has[1:]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        rows, size, part = [], 0, None
        for batch in batches:
            parts, copies, ids, texts = (batch.column(k) for k in range(4))
            for p, c, i, t in zip(parts.to_pylist(), copies.to_pylist(), ids.to_pylist(), texts, strict=True):
                t = t.as_py() or ""
                if p != part:
                    if rows:
                        raise RuntimeError("a range has no successor row")
                    part = p
                elif rows and (c or size > K.CHUNK or len(rows) >= 512):
                    yield block(rows, t)
                    rows, size = [], 0
                if c == 0:
                    rows.append((i, t))
                    size += len(t)
        if rows:
            raise RuntimeError("a range has no successor row")

    return run


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending id; after the last comes the first. Texts are shuffled
    once, by ranges of ids; the few rows that begin a range also go to the range before, so that
    every row meets its successor without a global window.
    """
    whole_number(docs, id_col)
    fp = Fingerprinter(**shape)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, min(RANGES, 2 * width(spark)))
    bounds, least, rows = _bounds(base, "id", parts)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not rows:
        return spark.createDataFrame([], schema)
    n = len(bounds) + 1
    part = _range_of("id", bounds)
    # a row whose id begins a range also goes to the range before, as the successor of its last row
    is_head = F.col("id").isin(bounds)
    is_head = (F.coalesce(is_head, F.lit(False)) if bounds else F.lit(False)) | (F.col("id").isNull() if least is None else F.coalesce(F.col("id") == least, F.lit(False)))
    own = F.struct(part.alias("part"), F.lit(0).alias("copy"))
    copy = F.struct(F.pmod(part - 1 + n, F.lit(n)).alias("part"), F.lit(1).alias("copy"))
    dealt = base.select(F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("c"), "id", "text").select("c.part", "c.copy", "id", "text")
    return (
        dealt.repartitionById(n, "part").sortWithinPartitions("part", "copy", F.col("id").asc_nulls_first(), "text")
        .mapInArrow(lean(_pairs(fp)), schema)
    )
