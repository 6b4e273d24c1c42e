"""Near-duplicate documents by tensored MinHash banding, with exact verification.

A document is the set of its distinct word shingles. Two smaller hash collections A and B of
``halves`` half-keys each are computed, each half-key joining ``rows`` MinHash values. Tables are the
pairs (i, j): a document's key there is (A_i, B_j). So ``halves ** 2`` tables of ``2 * rows`` values
cost only ``2 * halves * rows`` MinHash values. A pair of similarity s meets in a table with
probability (1 - (1 - s^rows)^halves)^2. ``halves`` follows the threshold, so that this is at least
``MEETING`` there and ``HALVES`` are not undercut: 12 halves of 3 rows at s = 0.85, 16 at 0.8.

Stages, none of which holds more than a bounded group in one task or emits all pairs of a group:

1. Sketch: set size, a 128-bit hash of the set, half-keys, one byte of each MinHash value.
2. Copies: documents of equal sets become one class (partial aggregation, so hot copies are cheap).
3. Tables: rows are dealt by A_i. Within a group, B_j makes the table keys; members whose bytes agree
   in at least the share that a link would (less five standard deviations) are joined, and a
   spanning forest leaves the task. In groups above ``block`` members each member is first compared with
   the group's smallest, wherever it lies; only members that do not agree with it are then compared with
   all others, dealt into cells of two chunks, so no pair is lost and no task holds more than two chunks.
4. Families: connected components of these. Only their members' full sets are made and shipped: a
   filter of their ids, of bounded size, leaves other texts where they are read.
5. Verify: exact intersections within a family, in large ones again with the smallest member first and
   then what is not linked with it against all; a spanning forest of confirmed links leaves the task.
   Work in a group is thus linear in members that are like its smallest, quadratic only in the others.
6. Components of confirmed links; copies join their class.

Defined cases: null, empty and blank texts have an empty set and link with nothing, not even with
each other; rows that share an id are one node, linked if any of their texts is, with an answer per
row: the same component, each its own number of shingles; a row of null id links with nothing
(component_id null, kept). Ids may be of any type that sorts; ids that are no whole numbers are
numbered in their order first. Extra columns are ignored by ``classes`` and kept by ``dedup``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import bloom, components, cut, fresh, lean, width

U64 = np.uint64
MEETING = 0.99997
HALVES = 12


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    xor = K.mix(np.arange(n, dtype=U64), 101)
    mul = K.mix(np.arange(n, dtype=U64), 202) | U64(1)
    return xor, mul


def distinct_sets(column, size: int):
    """Yields (row, row_end, flat distinct sorted hashes, begin) for bounded slices of a batch."""
    data, offsets = K.buffers(column)
    for a, b in K.slices(offsets):
        part, off = K.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, first = K.spans(part, off, K.SPACED)
        hashes, begin = K.shingles(K.word_hashes(part, starts, ends), first, size)
        sets = [np.unique(hashes[begin[r] : begin[r + 1]]) for r in range(b - a)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        yield a, b, (np.concatenate(sets) if sets else np.zeros(0, U64)), bounds


def half_keys(percent: int, rows: int) -> int:
    """Half-keys, ``HALVES`` at least, with which a link at the threshold meets with probability ``MEETING``."""
    miss = 1 - (percent / 100) ** rows
    return HALVES if miss <= 0 else max(HALVES, math.ceil(math.log(1 - math.sqrt(MEETING)) / math.log(miss)))


def sketches(flat: np.ndarray, bounds: np.ndarray, halves: int, rows: int):
    """Half-keys (rows x 2 * halves) and MinHash bytes (rows x values) of non-empty sets."""
    n, values = len(bounds) - 1, 2 * halves * rows
    xor, mul = _salts(values)
    lows = np.empty((n, values), dtype=U64)
    at = bounds[:-1]
    for t in range(values):
        lows[:, t] = np.minimum.reduceat((flat ^ xor[t]) * mul[t], at)
    keys = np.zeros((n, 2 * halves), dtype=U64)
    for h in range(2 * halves):
        for k in range(rows):
            keys[:, h] = K.mix(keys[:, h] + lows[:, h * rows + k], h + 1)
    return keys, (K.mix(lows, 9) & U64(255)).astype(np.uint8)


def _sketch_batches(size: int, halves: int, rows: int):
    def run(batches):
        for batch in batches:
            for a, b, flat, bounds in distinct_sets(batch.column(1), size):
                counts = np.diff(bounds)
                live = np.flatnonzero(counts > 0)
                n = b - a
                keys = np.zeros((n, 2 * halves), dtype=U64)
                marks = np.zeros((n, 2 * halves * rows), dtype=np.uint8)
                one, two = np.zeros(n, U64), np.zeros(n, U64)
                if len(live):
                    tight = np.concatenate([[0], np.cumsum(counts[live])])
                    keys[live], marks[live] = sketches(flat, tight, halves, rows)
                    one[live] = np.add.reduceat(K.mix(flat, 21), tight[:-1])
                    two[live] = np.add.reduceat(K.mix(flat, 22), tight[:-1])
                pack = lambda m, w: pa.array([m[r].tobytes() if counts[r] else b"" for r in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(counts, pa.int64()),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pack(keys, 8), pack(marks, 1),
                    ],
                    names=["id", "n", "h1", "h2", "keys", "marks"],
                )

    return run


def _explode_halves(halves: int, may=None, wanted: bool = True):
    """A row for each A_i; with ``may``, only those whose group it lets through, or (not ``wanted``) does not."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=U64).reshape(n, 2 * halves)
            low = (K.mix(keys[:, halves:], 31) & U64(2**32 - 1)).astype(np.uint32)
            tails = pa.array([x.tobytes() for x in low], pa.binary())
            for i in range(halves):
                g = K.mix(keys[:, i], 41 + i).view(np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), batch.column(1), tails, batch.column(3)], names=["g", "id", "n", "tails", "marks"])
                if may is not None:
                    out = out.filter(pa.array(may(g) == wanted))
                if out.num_rows:
                    yield out

    return run


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(ids: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links of each member with the smallest id of its tree."""
    roots = np.array([forest.find(x) for x in range(len(ids))])
    order = np.lexsort((ids, roots))
    head = np.ones(len(order), bool)
    head[1:] = roots[order][1:] != roots[order][:-1]
    lead = ids[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    keep = lead != ids[order]
    return list(zip(lead[keep].tolist(), ids[order][keep].tolist(), strict=True))


def groups(batches, key: int):
    """Runs of equal ``key`` column in a sorted stream of batches, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _least(values: int, similarity: float) -> int:
    """MinHash bytes of a link that agree at least, short of five standard deviations."""
    return int(values * similarity - 5 * math.sqrt(values * similarity * (1 - similarity)))


def _agree(marks: np.ndarray, tails: np.ndarray, n: np.ndarray, similarity: float, side: np.ndarray | None) -> Forest:
    """Joins members that share a table key and whose MinHash bytes agree often enough.

    ``side``: only rows of different sides are compared.
    """
    m, values = marks.shape
    least = _least(values, similarity)
    forest = Forest(m)
    for x in range(m - 1):
        rest = np.arange(x + 1, m)
        size = n[x + 1 :]
        ok = (np.minimum(size, n[x]) >= similarity * np.maximum(size, n[x]) - 1e-9) & (tails[x + 1 :] == tails[x]).any(1)
        if side is not None:
            ok &= side[x + 1 :] != side[x]
        rest = rest[ok]
        if len(rest):
            rest = rest[(marks[rest] == marks[x]).sum(1) >= least]
            for y in rest.tolist():
                forest.join(x, y)
    return forest


def _table_batches(similarity: float):
    def run(batches):
        left, right = [], []
        for t in groups(batches, 0):
            m = t.num_rows
            if m < 2:
                continue
            ids = t.column(1).to_numpy()
            n = t.column(2).to_numpy()
            tails = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint32).reshape(m, -1)
            marks = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(m, -1)
            side = t.column(5).to_numpy()
            forest = _agree(marks, tails, n, similarity, side if side.min() != side.max() else None)
            for a, b in _stars(ids, forest):
                left.append(a)
                right.append(b)
            if len(left) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it has few rows (counted)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def starred(hot: DataFrame, key: str, rows: list[str], test, salts: int = 16) -> DataFrame:
    """``hot`` (groups by ``key``, with a number ``id``) with ``lead``, the smallest id of the group, and
    ``agrees``: whether the row passes ``test`` against the smallest.

    ``test``: a ``mapInArrow`` function that gets key, id, ``rows``, lead and ``rows`` of the leader, and
    returns key, id, ``rows``, lead, agrees. A group's leader is one row, found by partial aggregation; it
    is broadcast, or sent to ``salts`` parts of its group where there are very many groups.
    """
    leaders = cut(hot.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(F.col("id").alias("lead"), *[F.col(c).alias(f"_{c}") for c in rows]), "id").alias("_l")).select("_k", "_l.*"))
    if leaders.limit(20_001).count() <= 20_000 and "set" not in rows:
        j = hot.join(F.broadcast(leaders), F.col(key) == F.col("_k"))
    else:
        spread = leaders.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        j = hot.join(spread, (F.col(key) == F.col("_k")) & (F.pmod(F.xxhash64(F.lit(79), "id"), F.lit(salts)) == F.col("_s")))
    kinds = {f.name: f.dataType.simpleString() for f in hot.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, "id", *rows)) + ", lead long, agrees boolean"
    return cut(j.select(key, "id", *rows, "lead", *[f"_{c}" for c in rows]).mapInArrow(lean(test), schema))


def rest_cells(stars: DataFrame, key: str, half: int, weight: str | None = None, half_weight: int = 1) -> DataFrame | None:
    """Cells in which rows that do not agree with their leader (side 1) meet all rows of their group
    (side 0), or None where there are no such rows. A side has about ``half`` rows, and ``half_weight`` of
    the sum of ``weight``."""
    load = lambda c, n: F.ceil(F.greatest(n / half, *([F.sum(F.when(c, F.col(weight)).otherwise(0)) / half_weight] if weight else [F.lit(0)])))
    lone = ~F.col("agrees")
    sizes = cut(
        stars.groupBy(F.col(key).alias("_k")).agg(load(F.lit(True), F.count("*")).cast("long").alias("all"), load(lone, F.count(F.when(lone, 1))).cast("long").alias("own"), F.count(F.when(lone, 1)).alias("n"))
        .where("n > 0").select("_k", "all", F.greatest("own", F.lit(1)).alias("own"))
    )
    if not sizes.limit(1).count():
        return None
    j = stars.join(_small(sizes), F.col(key) == F.col("_k"))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.xxhash64(F.lit(78), key, "_x", "_y").alias("cell")
    cols = [c for c in stars.columns if c not in (key, "lead", "agrees")]
    others = j.withColumn("_x", deal(80, "all")).withColumn("_y", every("own")).withColumn("side", F.lit(0).cast("long"))
    own = j.where(lone).withColumn("_y", deal(81, "own")).withColumn("_x", every("all")).withColumn("side", F.lit(1).cast("long"))
    return others.select(cell, *cols, "side").union(own.select(cell, *cols, "side"))


def _agree_with_leader(similarity: float):
    """Whether rows share a table key with their leader and their MinHash bytes agree often enough."""

    def run(batches):
        for t in batches:
            m = t.num_rows
            if not m:
                continue
            n, top = t.column(2).to_numpy(), t.column(6).to_numpy()
            tails, lead_tails = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint32).reshape(m, -1) for k in (3, 7))
            marks, lead_marks = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(m, -1) for k in (4, 8))
            ok = np.minimum(n, top) >= similarity * np.maximum(n, top) - 1e-9
            ok &= (tails == lead_tails).any(1) & ((marks == lead_marks).sum(1) >= _least(marks.shape[1], similarity))
            yield pa.RecordBatch.from_arrays([*t.columns[:6], pa.array(ok)], names=["g", "id", "n", "tails", "marks", "lead", "agrees"])

    return run


def _linked_with_leader(percent: int):
    """Whether full sets are linked with their leader's."""

    def run(batches):
        for t in batches:
            ok = []
            for own, lead in zip(t.column(2), t.column(5), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), U64) for x in (own, lead))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([*t.columns[:5], pa.array(ok, pa.bool_())], names=["root", "id", "set", "size", "lead", "agrees"])

    return run


def _set_batches(size: int, may):
    """Full sets of rows (id, hash of the id, text) whose hash ``may`` be wanted."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may(batch.column(1).to_numpy())))
            for a, b, flat, bounds in distinct_sets(batch.column(2), size):
                rows = [flat[bounds[r] : bounds[r + 1]].tobytes() for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["id", "set"])

    return run


def shared_counts(sets: list[np.ndarray], budget: int = 4_000_000) -> np.ndarray:
    """Intersection sizes of all pairs of sorted sets, by products of 0/1 matrices over columns."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1  # what one set alone holds is in no intersection
    col, owner = col[often], owner[often]
    out = np.zeros((m, m), dtype=np.float32)
    if not len(col):
        return out
    _, col = np.unique(col, return_inverse=True)
    step = max(256, budget // m)
    top = int(col[-1]) + 1
    for c in range(0, top, step):
        lo, hi = np.searchsorted(col, (c, c + step))
        dense = np.zeros((m, min(step, top - c)), dtype=np.float32)
        dense[owner[lo:hi], col[lo:hi] - c] = 1
        out += dense @ dense.T
    return out


def _once(batches):
    """Rows of a sorted stream without repeats of the row before."""
    last = None
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
        keep = []
        for row in rows:
            keep.append(row != last)
            last = row
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def _verify_batches(percent: int):
    def run(batches):
        for t in groups(_once(batches), 0):
            if t.num_rows < 2:
                continue
            ids = t.column(1).to_numpy()
            sets = [np.frombuffer(x, U64) for x in t.column(2).to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.float64)
            forest = Forest(len(sets))
            both = shared_counts(sets)
            union = n[:, None] + n[None, :] - both
            hit = np.triu(100.0 * both >= percent * union, 1)
            side = t.column(3).to_numpy()
            if side.min() != side.max():
                hit &= side[:, None] != side[None, :]
            for x, y in zip(*np.nonzero(hit), strict=True):
                forest.join(int(x), int(y))
            pairs = _stars(ids, forest)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return run


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80,
    halves: int | None = None, rows: int = 3, block: int = 256, set_block: int = 1_500_000,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (smallest id reachable).

    Links: 100 * |intersection| >= percent * |union| of sets of ``shingle``-word shingles.
    ``block`` (members) and ``set_block`` (shingles) bound what is compared at once; larger groups are
    compared with their smallest member, what does not agree with it with all others, none is skipped.
    """
    similarity = percent / 100
    halves = halves or half_keys(percent, rows)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = width(docs.sparkSession)
    sk = base.mapInArrow(lean(_sketch_batches(shingle, halves, rows)), f"id {kind}, n long, h1 long, h2 long, keys binary, marks binary")
    sk, numbers = _numbered(cut(sk), kind)
    # copies: the class of equal sets is known by its smallest id
    reps = cut(
        sk.where("n > 0 and num is not null").groupBy("h1", "h2", "n")
        .agg(F.min("num").alias("rep"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"))
    )
    halves_of = lambda **which: reps.select("rep", "n", "keys", "marks").mapInArrow(
        lean(_explode_halves(halves, **which)), "g long, id long, n long, tails binary, marks binary"
    )
    cell_of = lambda rows: rows.select(F.col("g").alias("cell"), "id", "n", "tails", "marks", F.lit(0).cast("long").alias("side"))
    counts = reps.select(F.col("rep"), "keys").mapInArrow(_group_keys(halves), "g long").groupBy("g").count()
    hot = cut(counts.where(f"count > {block}").select(F.col("g").alias("_k")))
    n_hot, links = hot.count(), None
    if n_hot:
        # rows of large groups are kept apart as they are made; what the filter lets through besides goes back
        may, hot = bloom(hot, n_hot), _small(hot)
        apart = cut(halves_of(may=may))
        stars = starred(apart.join(hot, F.col("g") == F.col("_k"), "left_semi"), "g", ["n", "tails", "marks"], _agree_with_leader(similarity))
        links = stars.where("agrees and id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
        cells = cell_of(halves_of(may=may, wanted=False)).union(cell_of(apart.join(hot, F.col("g") == F.col("_k"), "left_anti")))
        rest = rest_cells(stars, "g", block // 2)
        cells = cells if rest is None else cells.union(rest)
    else:
        cells = cell_of(halves_of())
    maybe = (
        cells.repartition(parts, "cell").sortWithinPartitions("cell")
        .mapInArrow(lean(_table_batches(similarity)), "a long, b long")
    )
    maybe = maybe if links is None else maybe.union(links)
    families = components(maybe)
    # full sets of family members only: families hold one id for each class of copies
    member = families.select("id", "root")
    if numbers is not None:
        member = member.join(numbers.select(F.col("num").alias("_n"), F.col("key")), F.col("id") == F.col("_n")).select(F.col("id").alias("num"), "root", F.col("key").alias("_m"))
    else:
        member = member.select(F.col("id").alias("num"), "root", F.col("id").alias("_m"))
    member = cut(member)
    may = bloom(member.select(F.xxhash64("_m")), member.count())
    wanted = base.select("id", F.xxhash64("id"), "text").mapInArrow(lean(_set_batches(shingle, may)), f"id {kind}, set binary")
    sets = wanted.join(member, F.col("id") == F.col("_m")).select("root", F.col("num").alias("id"), "set", (F.octet_length("set") / 8).cast("long").alias("size"))
    load = cut(
        families.join(reps.select(F.col("rep").alias("_r"), "n"), F.col("id") == F.col("_r"))
        .groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
        .where(f"m > {block} or total > {set_block}").select(F.col("root").alias("_k"))
    )
    held, sure = sets.select(F.col("root").alias("cell"), "id", "set", F.lit(0).cast("long").alias("side")), None
    if load.limit(1).count():
        load = _small(load)
        sets = cut(sets)
        held = sets.join(load, F.col("root") == F.col("_k"), "left_anti").select(F.col("root").alias("cell"), "id", "set", F.lit(0).cast("long").alias("side"))
        stars = starred(sets.join(load, F.col("root") == F.col("_k"), "left_semi"), "root", ["set", "size"], _linked_with_leader(percent))
        sure = stars.where("agrees and id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
        rest = rest_cells(stars, "root", block // 2, "size", set_block // 2)
        held = held if rest is None else held.union(rest.select("cell", "id", "set", "side"))
    links = (
        held.repartition(parts, "cell").sortWithinPartitions("cell", "side", "id", "set")
        .mapInArrow(lean(_verify_batches(percent)), "a long, b long")
    )
    links = links if sure is None else links.union(sure)
    # an id of several texts is one node: it ties the classes of its texts together
    span = sk.where("num is not null").groupBy("num").agg(F.min(F.struct("h1", "h2", "n")).alias("lo"), F.max(F.struct("h1", "h2", "n")).alias("hi"))
    several = cut(span.where("lo <> hi").select(F.col("num").alias("_k")))
    tied = None
    if several.limit(1).count():
        texts = sk.where("n > 0").join(several, F.col("num") == F.col("_k")).select("num", "h1", "h2", "n").distinct()
        tied = cut(texts.join(reps.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("num", "rep"))
        heads = tied.groupBy("num").agg(F.min("rep").alias("a"))
        links = links.union(tied.join(heads, "num").select("a", F.col("rep").alias("b")))
    linked = components(links)
    final = (
        reps.select("h1", "h2", F.col("n").alias("_n"), "rep")
        .join(linked.select(F.col("id").alias("_i"), "root"), F.col("rep") == F.col("_i"), "left")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_n", "rep", F.coalesce("root", "rep").alias("root"))
    )
    # only classes of more than one row, or linked, differ from their own id
    named = sk.select("id", "num", "n", "h1", "h2").join(
        final.drop("rep"), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n")), "left"
    )
    root = F.col("root")
    if tied is not None:
        own = tied.join(final.select(F.col("rep").alias("_r"), F.col("root").alias("_own")), F.col("rep") == F.col("_r")).groupBy(F.col("num").alias("_k")).agg(F.min("_own").alias("_own"))
        named = named.join(own, F.col("num") == F.col("_k"), "left")
        root = F.coalesce("_own", "root")
    named = named.select("id", "n", F.when(F.col("num").isNull(), F.col("num")).otherwise(F.coalesce(root, "num")).alias("c"))
    if numbers is None:
        return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    back = numbers.select(F.col("num").alias("_n"), F.col("key").alias("component_id"))
    return named.join(back, F.col("c") == F.col("_n"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _numbered(sk: DataFrame, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """``sk`` with a whole number ``num`` for each id, in the order of the ids, and the table (key, num)
    of numbers where ids are not whole numbers themselves."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return sk.withColumn("num", F.col("id").cast("long")), None
    keys = sk.where("id is not null").select(F.col("id").alias("key")).distinct()
    # ranges of ids in order, rows in order within: the numbers rise with the ids
    numbers = cut(keys.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("num")))
    return cut(sk.join(numbers, F.col("id") == F.col("key"), "left").drop("key")), numbers


def _group_keys(halves: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=U64).reshape(n, 2 * halves)
            out = np.concatenate([K.mix(keys[:, i], 41 + i) for i in range(halves)])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["g"])

    return run


def report(docs: DataFrame, **options) -> DataFrame:
    """``classes`` with ``kept``: whether the row's id is its component's (null ids are kept)."""
    return classes(docs, **options).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row kept of each component: that of the smallest id.

    Of rows that share that id the longest text is kept (of equally long ones the last in order), once.
    Rows of null id are all kept.
    """
    found = classes(docs, id_col, text_col, **options)
    gone, again = fresh(docs, "_dropped_id"), fresh(docs, "_again")
    drop = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct())
    left = docs.join(drop, docs[id_col] == drop[gone], "left_anti")
    twice = cut(left.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias(again)))
    if not twice.limit(1).count():
        return left
    # only rows whose id is there twice or more are shuffled; a hot id is reduced before that
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rank = F.struct(F.coalesce(F.length(text_col), F.lit(-1)), F.col(text_col), F.xxhash64(*plain))
    one = left.join(twice, F.col(id_col) == F.col(again), "left_semi").groupBy(F.col(id_col).alias(again)).agg(F.max_by(F.struct(*docs.columns), rank).alias("_row"))
    return left.join(twice, F.col(id_col) == F.col(again), "left_anti").union(one.select("_row.*"))
