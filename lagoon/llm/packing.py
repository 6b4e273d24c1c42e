"""Best-fit packing of tokenised documents into sequences, by bin completion.

A document is its token ids and an end id. Longer ones than a sequence are cut into full pieces, the
first piece taking what is over. Packing depends on piece lengths alone, and there are at most
``capacity`` of those, so it is solved on their histogram: a branch-and-bound over bin completions on
the driver, whose input and output have a size that does not depend on the number of documents. Around
the largest remaining piece it enumerates fillings that no other filling dominates (a filling
dominates another whose pieces fit into bins of the first one's piece lengths), best fit first, and
branches on how often each is used. Waste bounds prune: fillings that waste more than the target leaves
over are not enumerated, nor sums that the remaining pieces cannot make. Best-fit decreasing is the
first incumbent; the search stops where it meets the bound.

The search is exact within its budgets: ``EFFORT`` pieces tried in one search, ``FILLINGS`` fillings
kept at a node, ``STEPS`` pieces tried for them; fillings of more than six pieces are not compared for
dominance, which only keeps more. ``plan`` tells whether its result is proven to be the fewest.

The plan is a list of patterns. Pieces are ranked within their length by a salted running count, so a
length that a third of all pieces share is not ranked in one task; (length, rank) gives sequence and
offset by binary search in the plan.

Token ids are those of the tokenizer file. Where its merges make ids in their own order, byte-pair
ranks are read from the same file and plain texts (Latin letters and common punctuation) are encoded
by ranks, which is several times as fast; the first text of every batch is encoded both ways and must
agree. Texts with other characters or a special token's string are encoded by the tokenizer itself.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; a null id
stays null; an empty table gives no rows. Texts above 400,000 characters are tokenised in runs, cut where a
pre-token ends for certain (before white space between other characters, or before punctuation after a
letter); a text without such a place is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import cut, lean, width

CAPACITY = 1024
END_ID = 2
#: budgets of the search: pieces tried in all, fillings kept at a node, pieces tried for them
EFFORT = 300_000
FILLINGS = 24
STEPS = 300

# The pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXOTIC = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞₠-₰]")
_RUN = 100_000
#: places where one pre-token ends and the next begins in any reading of the pattern
_SAFE = regex.compile(r"(?<=[!-~¡-ɏ一-龥ぁ-ゖァ-ヺ가-힣Ѐ-ӿ])(?=[ \n][!-~¡-ɏ一-龥ぁ-ゖァ-ヺ가-힣Ѐ-ӿ])|(?<=[A-Za-z一-龥ぁ-ゖァ-ヺ가-힣])(?=[.,;:!?。，、！？：；])")


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.runs = self._byte_level(spec)
        self.ranks = self._by_ranks(spec) if self.runs else None

    @staticmethod
    def _byte_level(spec: dict) -> bool:
        """Whether texts are split by ``PATTERN`` and nothing else is done to them before."""
        pre = spec["pre_tokenizer"]
        return not spec["normalizer"] and bool(pre) and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]

    def _by_ranks(self, spec: dict):
        """An encoder by ranks with the same ids; None where the file is not plain byte-level BPE whose
        ids rise in the order of its merges."""
        model = spec["model"]
        if model["type"] != "BPE" or any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        symbols, special = _byte_symbols(), set(self.special)
        vocab = {w: i for w, i in model["vocab"].items() if w not in special}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        singles = [vocab.get(c) for c in symbols]
        if None in singles or merged != list(range(256, 256 + len(merged))) or sorted(singles) != list(range(256)):
            return None
        import tiktoken

        ranks = {bytes(symbols[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def check(self, text: str) -> None:
        if self.encode(text) != self.whole(text):
            raise RuntimeError("ids by ranks differ from the tokenizer's")

    def encode(self, text: str) -> bytes:
        if self.runs and len(text) > 4 * _RUN:
            at, out = 0, []
            while place := _SAFE.search(text, at + _RUN):
                out.append(self.encode_run(text[at : place.start()]))
                at = place.start()
            return b"".join([*out, self.encode_run(text[at:])])
        return self.encode_run(text)

    def encode_run(self, text: str) -> bytes:
        if self.ranks is None or _EXOTIC.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            out: list[tuple] = []
            rows: list[int] = []
            size = 0
            if batch.num_rows:
                encoder.check((batch.column(1)[0].as_py() or "")[:20_000])
            for r, text in enumerate(batch.column(1)):
                raw = encoder.encode(text.as_py() or "") + tail
                for k, (s, n) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    out.append((k, s, n, zlib.crc32(part), part))
                    rows.append(r)
                    size += len(part)
                if size > 1 << 24:
                    yield _batch(batch, rows, out, with_ids)
                    out, rows, size = [], [], 0
            if out:
                yield _batch(batch, rows, out, with_ids)

    def _batch(batch, rows, out, with_ids):
        cols = [batch.column(0).take(pa.array(rows)), pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[c] for o in out], pa.int64()) for c in (1, 2, 3)]]
        names = ["id", "piece", "start", "length", "crc"]
        if with_ids:
            cols.append(pa.array([o[4] for o in out], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _fits(small: tuple[int, ...], into: tuple[int, ...]) -> bool:
    """Whether pieces ``small`` fit into bins of sizes ``into`` (tuples of a few pieces, descending)."""
    if not small:
        return True
    tried = set()
    for k, room in enumerate(into):
        if room >= small[0] and room not in tried:
            tried.add(room)
            if _fits(small[1:], tuple(sorted((*into[:k], room - small[0], *into[k + 1 :]), reverse=True))):
                return True
    return False


def _reaches(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place in ``sizes`` the sums up to ``room`` that the pieces from there on make, as bits."""
    full = (1 << (room + 1)) - 1
    out, r = [], 1
    for s in reversed(sizes):
        left, step = min(counts[s], room // s), 1
        while left > 0:
            take = min(step, left)
            r |= (r << (take * s)) & full
            left -= take
            step *= 2
        out.append(r)
    return out[::-1]


def fillings(sizes: list[int], counts: dict[int, int], room: int, waste: int | None = None, most: int = FILLINGS, steps: int = STEPS, few: bool = True) -> tuple[list[tuple[int, ...]], bool, int]:
    """Undominated multisets of the available ``sizes`` (descending) that leave at most ``waste`` of
    ``room``, best fit first; whether those are all of them; and the work done. Of equal fits the fewest
    pieces come first, or else (not ``few``) the largest.

    Only maximal multisets count, an exact single piece dominates all else, and sums that the pieces
    cannot make are never tried. The budgets: ``steps`` pieces tried, ``most`` multisets handed back;
    the second result is False where either cut something off.
    """
    if counts.get(room, 0) > 0:
        return [(room,)], True, 1
    usable = [s for s in sizes if s <= room and counts[s] > 0]
    slack = room if waste is None else min(room, waste)
    if not usable:
        return ([()] if slack >= room else []), True, 1
    reach = _reaches(usable, counts, room)
    found: list[tuple[int, ...]] = []
    left, whole = steps, True

    def grow(at: int, space: int, over: int, taken: list[int]) -> None:
        """Adds what leaves exactly ``over``; ``taken`` is descending."""
        nonlocal left, whole
        if space == over:
            for s in reversed(usable):
                if s > over:
                    break
                if counts[s] > taken.count(s):
                    return  # something still fits
            found.append(tuple(taken))
            return
        for k in range(at, len(usable)):
            s = usable[k]
            if not reach[k] >> (space - over) & 1:
                return  # nor do the pieces after it make this sum
            if s > space - over or counts[s] <= taken.count(s):
                continue
            left -= 1
            if left <= 0:
                whole = False
                return
            taken.append(s)
            grow(k, space - s, over, taken)
            taken.pop()

    for over in range(slack + 1):
        if reach[0] >> (room - over) & 1:
            grow(0, room, over, [])
        if not whole or len(found) > 8 * most:
            whole = whole and over == slack
            break
    if not found:  # the budget ended before a multiset was whole: the best fit piece by piece
        one, space = [], room
        for s in usable:
            n = min(counts[s], space // s)
            one += [s] * n
            space -= n * s
        found = [tuple(one)] if space <= slack else []
    found.sort(key=lambda f: (room - sum(f), len(f) if few else 0, [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if len(kept) >= most:
            whole = False
            break
        if not any(len(f) <= 6 and len(k) <= 6 and _fits(f, k) for k in kept):
            kept.append(f)
    return kept, whole, len(usable) + steps - left


def least(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of sequences: pieces above ``capacity - a`` have one of their own, those above half
    one each, and what these leave must take the pieces from ``a`` on; the best over all ``a``."""
    sizes = sorted(s for s, n in counts.items() if n > 0)
    best = -(-sum(s * counts[s] for s in sizes) // capacity)
    for a in {1} | {s for s in sizes if 2 * s <= capacity}:
        alone = sum(counts[s] for s in sizes if s > capacity - a)
        half = [s for s in sizes if 2 * s > capacity and s <= capacity - a]
        many = sum(counts[s] for s in half)
        over = sum(s * counts[s] for s in sizes if a <= s and 2 * s <= capacity) - (many * capacity - sum(s * counts[s] for s in half))
        best = max(best, alone + many + max(0, -(-over // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: the patterns that placing piece by piece gives.

    A piece goes to the fullest sequence that takes it, which then is the fullest for the next of its
    length: sequences of one room take whole runs, so work does not grow with the counts.
    """
    rooms: dict[int, dict[tuple[int, ...], int]] = {}

    def put(room: int, pattern: tuple[int, ...], m: int) -> None:
        at = rooms.setdefault(room, {})
        at[pattern] = at.get(pattern, 0) + m

    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n = counts[s]
        for room in sorted(r for r in rooms if r >= s):
            per = room // s
            for pattern in list(rooms[room]):
                have = rooms[room].pop(pattern)
                m = min(have, n // per)
                rest = n - m * per if m < have else 0
                if m:
                    put(room - per * s, (*pattern, *[s] * per), m)
                if rest:
                    put(room - rest * s, (*pattern, *[s] * rest), 1)
                if have - m - bool(rest):
                    rooms[room][pattern] = have - m - bool(rest)
                n -= m * per + rest
                if not n:
                    break
            if not rooms[room]:
                del rooms[room]
            if not n:
                break
        per = capacity // s
        if n // per:
            put(capacity - per * s, (s,) * per, n // per)
        if n % per:
            put(capacity - n % per * s, (s,) * (n % per), 1)
    return [(p, m) for at in rooms.values() for p, m in at.items()]


class Search:
    """Branch and bound over bin completions for a histogram of pieces.

    A node completes a bin around the largest piece left. Its branches are the fillings that waste no
    more than the target leaves over, each used as often as the counts allow, half as often and once;
    since a filling used once is always among them, every packing of undominated bins is on some path.
    States that failed are remembered. ``effort`` bounds the work (pieces tried) of one ``reach``.
    """

    def __init__(self, counts: dict[int, int], capacity: int, most: int, steps: int):
        self.counts, self.capacity, self.most, self.steps = dict(counts), capacity, most, steps
        self.sizes = sorted(counts, reverse=True)
        self.few = True

    def _move(self, pattern: tuple[int, ...], m: int) -> None:
        for s in pattern:
            self.counts[s] -= m
        self.spare -= m * (self.capacity - sum(pattern))

    def _branches(self, alive: list[int]) -> list[tuple[tuple[int, ...], int]]:
        counts, top = self.counts, alive[0]
        counts[top] -= 1
        found, whole, work = fillings(alive, counts, self.capacity - top, self.spare, self.most, self.steps, self.few)
        counts[top] += 1
        self.whole &= whole
        self.used += work
        often = []
        for f in found:
            p = (top, *f)
            m = min(counts[s] // p.count(s) for s in set(p))
            waste = self.capacity - sum(p)
            often.append((p, m if not waste else min(m, self.spare // waste)))
        return often + [(p, m // 2) for p, m in often if m > 3] + [(p, 1) for p, m in often if m > 1]

    def reach(self, target: int, effort: int, departures: int | None) -> tuple[list[tuple[tuple[int, ...], int]] | None, bool]:
        """(a packing into ``target`` bins at most or None, whether all of the tree was seen).

        ``departures``: how often a path may leave a node's first branch; None sets no limit.
        """
        counts, path = self.counts, []
        self.spare = target * self.capacity - sum(s * n for s, n in counts.items())  # waste the target allows
        self.whole, self.used = True, 0
        if self.spare < 0:
            return None, True
        left = 1 << 30 if departures is None else departures
        failed: dict[tuple, int] = {}
        frames: list[tuple[list, list]] = []  # a node's branches to come, and the one that is applied
        result = None
        while True:
            alive = [s for s in self.sizes if counts[s] > 0]
            if not alive:
                result = list(path)
                break
            if self.used >= effort and departures != 0:  # one descent is as long as the histogram
                self.whole = False
                break
            key = (self.spare, *[(s, counts[s]) for s in alive]) if len(alive) <= 200 else None
            branches = []
            if key is None or failed.get(key, -1) < left:
                branches = self._branches(alive)
                if not left and len(branches) > 1:
                    self.whole, branches = False, branches[:1]
                if key is not None:
                    failed[key] = left  # so it will have, once its branches are spent
            frames.append(([(*b, left - bool(i)) for i, b in enumerate(branches)], []))
            while frames:
                todo, applied = frames[-1]
                if applied:
                    self._move(*path.pop()[:1], -applied.pop())
                if todo:
                    pattern, m, left = todo.pop(0)
                    self._move(pattern, m)
                    path.append((pattern, m))
                    applied.append(m)
                    break
                frames.pop()
            if not frames:
                break
        for pattern, m in path:
            self._move(pattern, -m)
        return result, result is None and self.whole


def plan(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT, most: int = FILLINGS, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int, bool]:
    """(patterns with how often each is used, proven lower bound of sequences, whether it is proven that
    no packing has fewer).

    Best-fit decreasing is the first incumbent; descents by best-fitting fillings, of few pieces or of the
    largest, better it. Then
    a packing at the lower bound is searched for, by few departures from the best fit and without a
    limit; a search that sees all of its tree in vain raises the bound by one. Where ``effort`` runs out,
    as much again goes into packings of a bin less than the incumbent.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    bins = sum(m for _, m in best)
    bound = least(counts, capacity)
    search = Search(counts, capacity, most, steps)

    def ask(target: int, effort: int):
        for departures, share, few in ((1, 4, True), (1, 4, False), (2, 4, True), (None, 1, False)):
            search.few = few
            got, none = search.reach(target, effort // share, departures)
            if got is not None or none:
                return got, none
        return None, False

    for few in (True, False):
        search.few = few
        while bound < bins:
            got, _ = search.reach(bins - 1, 0, 0)
            if got is None:
                break
            best, bins = got, sum(m for _, m in got)
    while bound < bins:
        got, none = ask(bound, effort)
        if got is not None:
            best, bins = got, bound
        elif none:
            bound += 1
        else:
            break
    while bound < bins - 1:
        got, none = ask(bins - 1, effort // 2)
        if got is None:
            bound = bins if none else bound
            break
        best, bins = got, sum(m for _, m in got)
    return best, bound, bound == bins


class Assigner:
    """(length, rank) -> (sequence, offset), by binary search in the plan's arrays."""

    SHIFT = 44

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        rows, first = [], 0
        for pattern, m in patterns:
            offset = 0
            for s in dict.fromkeys(pattern):
                per = pattern.count(s)
                rank = used.get(s, 0)
                rows.append(((s << self.SHIFT) + rank, rank, first, per, offset))
                used[s] = rank + m * per
                offset += s * per
            first += m
        rows.sort()
        self.key, self.rank, self.first, self.per, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T.copy()

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.SHIFT) + rank, side="right") - 1
        k = rank - self.rank[at]
        return self.first[at] + k // self.per[at], self.offset[at] + (k % self.per[at]) * length


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, piece int, start long, length long, crc long" + (", ids binary" if with_ids else "")
    pieces = cut(base.mapInArrow(lean(_tokenise(tokenizer_path, capacity, end_id, with_ids)), schema))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    # a length is ranked in as many parts as its rows need, a million each at most on average
    salts = max(4 * width(docs.sparkSession), -(-max(counts.values(), default=0) // 1_000_000))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(salts)).cast("int"))
    tally = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    patterns, _, _ = plan(counts, capacity)
    assign = Assigner(patterns)
    before = tally.select(
        F.col("length").alias("_l"), F.col("salt").alias("_s"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")) - 1
    ranked = (
        pieces.withColumn("own", own).join(before, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s")))
        .select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("own")).cast("long").alias("rank"), *(["ids"] if with_ids else []))
    )

    def place(batches):
        for batch in batches:
            seq, off = assign(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            cols = [*batch.columns[:5], pa.array(seq), pa.array(off)]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(6).to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return ranked.mapInArrow(lean(place), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))
