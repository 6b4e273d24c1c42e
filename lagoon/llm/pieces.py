"""SentencePiece sampling: forward-filtering backward-sampling over the piece lattice.

A text, with a space before it, is written with ``▁`` for spaces. Its lattice has an edge for every
piece that stands somewhere, and byte pieces for characters that no piece is. Forward filtering sums
path weights up to each place; backward sampling draws, from the end, each piece in proportion to the
weight of paths through it. So segmentations are drawn from the exact distribution over all of them,
piece probabilities raised to ``alpha``. Draws are a hash of (seed, row key, place of the word, step):
a row's segmentation is reproducible whatever its partition, batch or retry.

No piece has a ``▁`` after another character, so every path passes the place before each run of
spaces, and words (with the spaces before them) are filtered and sampled apart. Each distinct word of
a batch is filtered once, all words at the same place at once; a worker keeps the words it met first.
All occurrences are sampled a step at a time in numpy. Weights come from the model: log-probabilities if its scores are that, or, where scores
are merge ranks (byte-pair models), a Zipf law of the rank.

Decoding turns pieces to bytes, ``▁`` to spaces, and drops the space that was put before the text. A
``▁`` in the text itself is written in byte pieces, so decoding always gives the text back.

Defined cases: null texts have null ids; empty texts have no ids; rows of null key share one seed;
equal rows have equal ids. Work arrays are made for about ``SLICE`` bytes of text at a time (a
longer text takes as many as it needs). A unit is a run of characters without a space: its places are
filtered one after another, all units at once, so a single unbroken unit costs about 80 microseconds a
character whatever its length, and is one task's work.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import lean

U64 = np.uint64
SPACE = "▁"
_UNIT = re.compile(" *[^ ]+| +")
SLICE = 3 << 20  # bytes of text that are sampled at once
KNOWN = 150_000  # units that a worker keeps filtered
_STEP = U64(0x9FB21C651E98DF25)


class Filtered(NamedTuple):
    """Lattices of units after forward filtering: edges by target node, with running chances."""

    chance: np.ndarray
    piece: np.ndarray
    src: np.ndarray
    lead: np.ndarray  # first edge of each node
    first: np.ndarray  # first node of each unit, and the number of nodes

    def then(self, other: Filtered) -> Filtered:
        if not len(self.chance):
            return other
        nodes, edges = self.first[-1], len(self.chance)
        return Filtered(
            np.concatenate([self.chance, other.chance]), np.concatenate([self.piece, other.piece]),
            np.concatenate([self.src, other.src + np.int32(nodes)]), np.concatenate([self.lead, other.lead + np.int32(edges)]),
            np.concatenate([self.first[:-1], other.first + nodes]),
        )


class Lattice:
    """A model's pieces as tables; made once a worker."""

    _made: dict[tuple[str, float], Lattice] = {}

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, dtype=np.int64)
        normal, score = [], []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and name:
                if SPACE in name.lstrip(SPACE):
                    raise ValueError("a piece spans words")
                normal.append(i)
                score.append(model.get_score(i))
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces, without which decoding would lose characters")
        score = np.array(score)
        if (score == np.round(score)).all():  # merge ranks
            rank = np.empty(len(score))
            rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
            score = -np.log(rank + 3.0)
        score -= np.logaddexp.reduce(score)
        self.log = np.zeros(n)
        self.log[normal] = alpha * score
        self.byte_log = alpha * (float(score.min()) - 1.0)
        self.text = [b""] * n
        for i in normal:
            self.text[i] = self.names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        # prefixes of pieces by hash, with the piece that ends there
        found: dict[int, int] = {}
        mask = 2**64 - 1
        self.longest = 0
        for i in normal:
            h = 0
            for c in self.names[i]:
                h = (h * 0xD1342543DE82EF95 + ord(c) + 1) & mask
                h ^= h >> 29
                found.setdefault(h, -1)
            if found[h] >= 0:
                raise ValueError("two pieces have one hash")
            found[h] = i
            self.longest = max(self.longest, len(self.names[i]))
        keys = np.array(list(found), dtype=U64)
        keys, piece = K.mix(keys), np.array(list(found.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.piece = keys[order], piece[order]
        # a coarse index by the top bits narrows each search
        self.known: dict[str, int] = {}
        self.filtered = Filtered(np.zeros(0), *[np.zeros(0, np.int32)] * 3, np.zeros(1, np.int64))
        self.top = np.searchsorted(self.keys >> U64(48), np.arange(2**16 + 1, dtype=U64))

    @classmethod
    def of(cls, path: str, alpha: float) -> Lattice:
        if (path, alpha) not in cls._made:
            cls._made[path, alpha] = cls(path, alpha)
        return cls._made[path, alpha]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the prefixes, -1 where it is none."""
        head = (h >> U64(48)).astype(np.int64)
        at, stop = self.top[head], self.top[head + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out

    def edges(self, cp: np.ndarray, size: np.ndarray):
        """(source, target, piece or -1 - code point, log weight) over nodes; a unit of n code points
        has n + 1 nodes, units after one another."""
        first = np.concatenate([[0], np.cumsum(size)])
        unit = np.repeat(np.arange(len(size)), size)
        end = first[1:][unit]
        node = (np.arange(len(cp)) + unit).astype(np.int32)
        at = np.arange(len(cp))
        h = np.zeros(len(cp), dtype=U64)
        src, dst, piece = [], [], []
        for n in range(1, self.longest + 1):
            ok = at + n <= end[at]
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * U64(0xD1342543DE82EF95) + cp[at + n - 1].astype(U64) + U64(1)
            h ^= h >> U64(29)
            k = self._find(K.mix(h))
            if n == 1:
                lone = (k < 0) | (self.piece[k] < 0)
                src.append(node[at[lone]])
                dst.append(node[at[lone]] + 1)
                piece.append(-1 - cp[at[lone]].astype(np.int64))
            alive = k >= 0
            at, h, p = at[alive], h[alive], self.piece[k[alive]]
            is_piece = p >= 0
            src.append(node[at[is_piece]])
            dst.append(node[at[is_piece]] + n)
            piece.append(p[is_piece])
        src, dst, piece = np.concatenate(src), np.concatenate(dst), np.concatenate(piece)
        weight = np.where(piece >= 0, self.log[np.maximum(piece, 0)], self.byte_log * _utf8_length(-1 - np.minimum(piece, -1)))
        return src, dst, piece, weight

    def filter(self, cp: np.ndarray, size: np.ndarray) -> Filtered:
        """Forward filtering of units. Nothing in a unit's part depends on the other units."""
        src, dst, piece, weight = self.edges(cp, size)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        nodes = int(first[-1])
        place = np.arange(nodes) - np.repeat(first[:-1], size + 1)
        order = np.argsort(dst, kind="stable")
        src, dst, piece, weight = src[order], dst[order], piece[order], weight[order]
        at = place[dst]
        far = int(size.max(initial=0))
        turn = np.argsort(at.astype(np.uint16) if far < 2**16 else at, kind="stable")  # short keys: a radix sort
        turns = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=far + 1)[1:])])
        alpha = np.zeros(nodes)
        chance = np.empty(len(src))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            here = turn[a:b]
            v = alpha[src[here]] + weight[here]
            d = dst[here]
            heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            top = np.maximum.reduceat(v, heads)
            wide = np.diff(np.append(heads, b - a))
            e = np.exp(v - np.repeat(top, wide))
            total = np.add.reduceat(e, heads)
            alpha[d[heads]] = top + np.log(total)
            chance[here] = e / np.repeat(total, wide)
        many = np.bincount(dst, minlength=nodes)
        lead = np.concatenate([[0], np.cumsum(many)[:-1]])
        rank = np.arange(len(dst)) - lead[dst]
        for r in range(1, int(many.max(initial=0))):  # running sums within a node's edges
            k = np.flatnonzero(rank == r)
            chance[k] += chance[k - 1]
        chance[(lead + many - 1)[many > 0]] = 1.0
        return Filtered(chance, piece.astype(np.int32), src.astype(np.int32), lead.astype(np.int32), first)

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, begin of each text's)."""
        number = self.known.copy()
        units, counts = [], []
        put = number.setdefault
        for t in texts:
            found = _UNIT.findall(" " + t) if t else []
            counts.append(len(found))
            units.append(np.array([put(u, len(number)) for u in found], dtype=np.int64))
        row_begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        if not row_begin[-1]:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        unit = np.concatenate(units)
        new = list(islice(number, len(self.known), None))
        f = self.filtered
        if new:
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            raw = np.frombuffer("".join(new).encode("utf-32-le"), dtype=np.uint32)
            # a "▁" of the text is no space: a code point that no piece has, turned back for its bytes
            cp = np.where(raw == 32, ord(SPACE), np.where(raw == ord(SPACE), 1 << 30, raw)).astype(np.int64)
            f = f.then(self.filter(cp, size))
            if len(number) <= KNOWN:  # units met first are kept filtered; later ones are filtered anew
                self.known, self.filtered = number, f
        row = np.repeat(np.arange(len(texts)), counts)
        base = K.mix(seeds[row] + (np.arange(len(unit)) - row_begin[row]).astype(U64) * _STEP)
        stop = f.first[unit]
        node = f.first[unit + 1] - 1
        live = np.arange(len(unit))
        steps, taken = [], np.zeros(len(unit), dtype=np.int64)
        k = 0
        while len(live):
            u = (K.mix(base[live] + U64(k)) >> U64(11)).astype(np.float64) * 2.0**-53
            e = f.lead[node[live]].astype(np.int64)
            more = np.flatnonzero(u >= f.chance[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= f.chance[e[more]]]
            steps.append((live, f.piece[e]))
            taken[live] += 1
            at = f.src[e]
            node[live] = at
            live = live[at > stop[live]]
            k += 1
        tail = np.cumsum(taken)
        path = np.empty(int(tail[-1]), dtype=np.int64)
        for k, (who, p) in enumerate(steps):
            path[tail[who] - 1 - k] = p
        begin = np.concatenate([[0], tail])[row_begin]
        return self._spell(path, begin)

    def _spell(self, path: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of code points that no piece is."""
        lone = path < 0
        if not lone.any():
            return path, begin
        code = -1 - path[lone]
        code[code == 1 << 30] = ord(SPACE)
        wide = np.ones(len(path), dtype=np.int64)
        wide[lone] = _utf8_length(code)
        start = np.concatenate([[0], np.cumsum(wide)])
        out = np.repeat(path, wide)
        text = np.frombuffer("".join(map(chr, code.tolist())).encode(), dtype=np.uint8)
        out[np.repeat(lone, wide)] = self.bytes[text]
        return out, start[begin]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _utf8_length(code: np.ndarray) -> np.ndarray:
    n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    return np.where(code == 1 << 30, 3, n)


def row_seed(seed: int, key) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'' if key is None else 'k'}{key}".encode(), digest_size=8).digest(), "little")


def _encode_batch(lattice: Lattice, seed: int, keys: list, column) -> list[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(first row, row after the last, texts, ids, begin) of bounded slices."""
    _, offsets = K.buffers(column)
    for a, b in K.slices(offsets, SLICE):
        texts = column.slice(a, b - a).to_pylist()
        seeds = np.array([row_seed(seed, k) for k in keys[a:b]], dtype=U64)
        ids, begin = lattice.sample([t or "" for t in texts], seeds)
        yield a, b, texts, ids, begin


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, alpha: float = 1.0, seed: int = 0, verify: bool = False) -> DataFrame:
    """id_col, n_pieces and ids of each row; with ``verify`` also ids_crc32 and ``lossless``, whether
    decoding gives the text back. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_pieces", "ids"] + ["ids_crc32", "lossless"] * verify

    def run(batches):
        lattice = Lattice.of(model_path, alpha)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts, ids, begin in _encode_batch(lattice, seed, keys, batch.column(1)):
                null = pa.array([t is None for t in texts])
                n = np.diff(begin)
                flat = ids.astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat), mask=null)
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64(), mask=np.array(null)), lists]
                if verify:
                    cuts = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
                    cols.append(pa.array([None if t is None else zlib.crc32(flat[x:y].astype("<u4").tobytes()) for t, (x, y) in zip(texts, cuts, strict=True)], pa.int64()))
                    every = flat.tolist()
                    cols.append(pa.array([None if t is None else lattice.decode(every[x:y]) == t for t, (x, y) in zip(texts, cuts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_pieces long, ids array<int>" + (", ids_crc32 long, lossless boolean" if verify else "")
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(lean(run), schema)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of each row's ids (null ids: null)."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        lattice = Lattice.of(model_path, 1.0)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")
