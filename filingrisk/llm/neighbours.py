"""Approximate nearest neighbours by cosine: NN-descent graph, greedy graph search."""

from __future__ import annotations

from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.llm.common import BATCH_BYTES, arrow_schema, flat_map, pack, rows_of, ship_package
from filingrisk.session import discard, materialise

#: Neighbours kept per node of the graph.
DEGREE = 24
#: Random hyperplane partitions from which the graph starts, and nodes in a part of theirs, about.
STARTS, START_PART = 8, 4096
#: Nodes that are stored and joined together, about: a part of one more such partition.
PART = 1024
#: Rounds of neighbours of neighbours go on until less than this share of the edges changes.
SETTLED = 0.001
#: Nodes that a search keeps open at first; doubled for each query until its answers stay the same.
BEAM = 96
#: Vectors in one block of the search, about: fewest, and most where there are blocks for all cores.
BLOCK, LARGEST = 4096, 65536
#: Edges that a task holds before it keeps only the best, about.
HELD = 1 << 20

# What parts, groups and queries send each other: packed arrays, by kind.
_MESSAGE = "to bigint, kind int, a binary, b binary, c binary, d binary, e binary"
# A node's number is its part (code and chunk) and its place there.
CHUNK_BITS, RANK_BITS = 20, 22
RANK_MASK = (1 << RANK_BITS) - 1
# Groups over which the edges to one part are spread, at most.
SPREAD = 4096
# Half floats are enough to build the graph, single floats rank what a search meets.
_HALF, _SINGLE = "<f2", "<f4"


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, key, half and unit (half and single floats) and raw (doubles), packed, of each vector that takes part.

    Vectors that are null, zero, or hold a null or a number that is not finite
    take no part, nor do those of another length than the most frequent one
    (of equally frequent ones the longest). Of rows with one vec_id only that
    with the smallest key is taken; rows without vec_id take no part.
    """

    def make():
        def produce(vec_id, values):
            if not values or any(v is None for v in values):
                return
            raw = np.array(values, dtype=np.float64)
            with np.errstate(over="ignore"):
                norm = np.linalg.norm(raw / np.abs(raw).max()) if np.isfinite(raw).all() and raw.any() else 0.0
            if norm:
                unit = raw / np.abs(raw).max() / norm
                packed = (unit.astype(_HALF).tobytes(), unit.astype(_SINGLE).tobytes(), raw.tobytes())
                yield vec_id, xxhash.xxh3_128_hexdigest(raw.tobytes()), len(raw), *packed

        return produce

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null")
    made = materialise(flat_map(rows, make, "vec_id bigint, key string, n bigint, half binary, unit binary, raw binary"))
    common = made.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    same = made.where(F.col("n") == (common["n"] if common else 0))
    single = same.groupBy(F.col("vec_id").alias("id")).agg(F.min("key").alias("k"))
    return materialise(same.join(single, (F.col("vec_id") == F.col("id")) & (F.col("key") == F.col("k"))).select("vec_id", "key", "half", "unit", "raw").dropDuplicates(["vec_id"]))


def _units(column: pa.Array, kind: str = _SINGLE) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float32)


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i8")


def _floats(blob: bytes, kind: str = _SINGLE) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind).astype(np.float32)


def _flags(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=bool)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


def _mix(numbers: np.ndarray) -> np.ndarray:
    """Well-spread 31-bit numbers of whole numbers."""
    with np.errstate(over="ignore"):
        mixed = (np.asarray(numbers).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64)


def _runs(keys: np.ndarray):
    """(key, places) of equal keys."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, cuts) if len(keys) else ():
        yield int(keys[places[0]]), places


def _message(to: int, kind: int, *blobs) -> tuple:
    """A row of _MESSAGE; arrays become bytes."""
    packed = [b.tobytes() if isinstance(b, np.ndarray) else b for b in blobs]
    return (int(to), kind, *packed, *[None] * (5 - len(packed)))


def _map(df: DataFrame, handle, ddl: str = _MESSAGE, pick=None) -> DataFrame:
    """Rows that handle yields for each row, or for each run of rows that `pick` takes from an iterator of rows."""
    ship_package(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        rows = (row for batch in batches if batch.num_rows for row in rows_of(batch))
        out, held = [], 0
        for made in chain.from_iterable(handle(*each) for each in (pick(rows) if pick else rows)):
            out.append(made)
            held += 64 + sum(len(v) for v in made if isinstance(v, bytes))
            if held >= BATCH_BYTES:
                yield pack(out, schema)
                out, held = [], 0
        if out:
            yield pack(out, schema)

    return df.mapInArrow(run, ddl)


def _at(df: DataFrame, tasks: int, handle, ddl: str = _MESSAGE) -> DataFrame:
    """handle(key, rows by kind) -> rows, once for each value of the first column."""
    met = df.repartition(tasks, df.columns[0]).sortWithinPartitions(*df.columns[:2])
    return _map(met, handle, ddl, lambda rows: groupby(rows, key=itemgetter(0)))


def _only(table: DataFrame, kind: int, *columns: str) -> DataFrame:
    """Rows of a kind with some of their contents, so that a scan reads no others."""
    return table.select("to", F.lit(kind).alias("kind"), *(F.col(c) if c in columns else F.lit(None).cast("binary").alias(c) for c in "abcde"))


def _planes(size: int, dimension: int, degree: int, seed: int = 11) -> list[np.ndarray]:
    """Hyperplanes of the parts (first) and of the starts."""
    # Up to eight parts also where all nodes would fit one, so that the descent has work at any size.
    few = min(3, int(np.log2(max(1, size / (2 * degree)))))
    bits = [max(few, int(np.ceil(np.log2(max(1, size) / part)))) for part in (PART, *[START_PART] * STARTS)]
    draws = np.random.default_rng(seed)
    return [draws.standard_normal((n, dimension)).astype(np.float32) for n in bits]


def _codes(units: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """The part of each vector in each partition."""
    return np.stack([((units @ p.T > 0) << np.arange(len(p))).sum(axis=1, dtype=np.int64) for p in planes], axis=1)


class _Layout:
    """Parts of the nodes, and where the work on each is done."""

    def __init__(self, nodes: DataFrame, degree: int):
        self.size = nodes.count()
        first = nodes.select("half").first()
        self.dimension = len(first["half"]) // 2 if first else 1
        self.planes = _planes(self.size, self.dimension, degree)
        cores = nodes.sparkSession.sparkContext.defaultParallelism
        parts = 1 << len(self.planes[0])
        # A Python task costs some tenth of a second, so there are few; more where each would have many parts.
        self.tasks = min(parts, max(3 * cores, parts // 8))
        self.blocks = max(-(-self.size // LARGEST), min(-(-self.size // BLOCK), 2 * cores), 1)
        planes = self.planes

        def sizes(batches):
            for batch in batches:
                if batch.num_rows:
                    codes = _codes(_units(batch.column(0), _HALF), planes)
                    for start in range(len(planes)):
                        code, n = np.unique(codes[:, start], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), start)), pa.array(code), pa.array(n)], names=["start", "code", "n"])

        ship_package(nodes.sparkSession)
        counted = nodes.select("half").mapInArrow(sizes, "start bigint, code bigint, n bigint").groupBy("start", "code").agg(F.sum("n").alias("n"))
        #: Parts that hold far more than their share, such as copies, and into how many chunks they are dealt by hash.
        most = F.when(F.col("start") == 0, 2 * PART).otherwise(2 * START_PART)
        self.chunks = {(r["start"], r["code"]): r["chunks"] for r in counted.where(F.col("n") > most).withColumn("chunks", F.ceil(F.col("n") / most)).collect()}


def _dealt(codes: np.ndarray, ids: np.ndarray, start: int, chunks: dict) -> np.ndarray:
    """Part numbers: the code and the chunk, if its part is dealt into several."""
    parts = codes << CHUNK_BITS
    for (s, code), n in chunks.items() if chunks else ():
        if s == start and (own := codes == code).any():
            parts[own] += _mix(ids[own] * (STARTS + 1) + start) % n
    return parts


def _homes(nodes: DataFrame, layout: _Layout) -> DataFrame:
    """A row for each part: a the nodes, b their half floats, c their single floats.

    From here on a node goes by its part and its place there (see RANK_BITS).
    """
    planes, chunks = layout.planes[:1], layout.chunks

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                parts = _dealt(_codes(_units(batch.column(1), _HALF), planes)[:, 0], node, 0, chunks)
                yield pa.RecordBatch.from_arrays([pa.array(parts), *batch.columns], names=["part", "node", "half", "unit"])

    ship_package(nodes.sparkSession)
    placed = nodes.select("node", "half", "unit").mapInArrow(place, "part bigint, node bigint, half binary, unit binary")

    def gather(part, rows):
        _, node, half, unit = zip(*rows, strict=True)
        yield _message(part, 0, np.array(node, dtype="<i8"), b"".join(half), b"".join(unit))

    return materialise(_at(placed, layout.tasks, gather))


def _top(src: np.ndarray, dst: np.ndarray, score: np.ndarray, fresh: np.ndarray, degree: int) -> tuple:
    """The `degree` best edges of each node and their rank; of equal edges one that is not fresh."""
    order = np.lexsort((fresh, dst, src))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(src[order]) != 0) | (np.diff(dst[order]) != 0)
    order = order[first]
    order = order[np.lexsort((dst[order], -score[order], src[order]))]
    starts = np.flatnonzero(np.diff(src[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    order, rank = order[rank < degree], rank[rank < degree]
    return src[order], dst[order], score[order], fresh[order], rank


def _merge(degree: int):
    """A part's lists: a the ends, b the scores, c what is fresh, `degree` places a node; e how many are fresh and how many there are."""

    def merge(part, rows):
        size, held = 0, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool))]
        count = 0
        for _, kind, a, b, c, *_ in rows:
            if kind == 0:
                size = len(a) // 8
                continue
            if kind == 1:
                ends = _ints(a).reshape(-1, degree)
                size = len(ends)
                i, j = np.nonzero(ends >= 0)
                held.append(((part << RANK_BITS) + i, ends[i, j], _floats(b).reshape(-1, degree)[i, j], np.zeros(len(i), bool)))
            else:
                held.append((_ints(a), _ints(b), _floats(c), np.ones(len(a) // 8, bool)))
            count += len(held[-1][0])
            if count > 2 * HELD:
                held = [_top(*(np.concatenate(x) for x in zip(*held, strict=True)), degree)[:4]]
                count = min(len(held[0][0]), HELD)
        src, dst, score, fresh, rank = _top(*(np.concatenate(x) for x in zip(*held, strict=True)), degree)
        at = (src & RANK_MASK, rank)
        ends, scores, new = np.full((size, degree), -1, dtype="<i8"), np.full((size, degree), -2, dtype=_SINGLE), np.zeros((size, degree), dtype=bool)
        ends[at], scores[at], new[at] = dst, score, fresh
        yield _message(part, 1, ends, scores, new, None, np.array([fresh.sum(), len(src)], dtype="<i8"))

    return merge


def _to_homes(src: np.ndarray, dst: np.ndarray, score: np.ndarray):
    for part, at in _runs(src >> RANK_BITS):
        yield _message(part, 2, src[at], dst[at], score[at].astype(_SINGLE))


def _first_edges(homes: DataFrame, layout: _Layout, degree: int) -> DataFrame:
    """Exact neighbours within parts of several random hyperplane partitions."""
    planes, chunks, tasks = layout.planes, layout.chunks, layout.tasks

    def deal(part, kind, a, b, *_):
        units = _floats(b, _HALF).reshape(len(a) // 8, -1)
        ids, codes = (part << RANK_BITS) + np.arange(len(units)), _codes(units, planes)
        halves = np.frombuffer(b, dtype=_HALF).reshape(len(units), -1)
        for start in range(1, STARTS + 1):
            for other, at in _runs(_dealt(codes[:, start], ids, start, chunks)):
                yield _message(other * (STARTS + 1) + start, 2, ids[at], halves[at])

    def nearest(key, rows):
        _, _, ids, units, *_ = zip(*rows, strict=True)
        ids, units = np.concatenate([_ints(x) for x in ids]), _floats(b"".join(units), _HALF).reshape(sum(len(x) for x in ids) // 8, -1)
        if len(ids) < 2:
            return
        k, near, best = min(degree, len(ids) - 1), [], []
        for start in range(0, len(ids), 256):
            scores = units[start : start + 256] @ units.T
            scores[np.arange(len(scores)), start + np.arange(len(scores))] = -2
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            near.append(ids[top].ravel())
            best.append(np.take_along_axis(scores, top, axis=1).ravel())
        yield from _to_homes(np.repeat(ids, k), np.concatenate(near), np.concatenate(best))

    found = _at(_map(_only(homes, 0, "a", "b"), deal), tasks, nearest)
    return materialise(_at(found.unionByName(_only(homes, 0, "a")), tasks, _merge(degree)))


def _hot(graph: DataFrame, degree: int) -> dict[int, int]:
    """Parts to which far more edges lead than to others, and over how many groups those are spread."""

    def count(part, kind, a, *_):
        to, n = np.unique(_ints(a)[_ints(a) >= 0] >> RANK_BITS, return_counts=True)
        yield from zip(to.tolist(), n.tolist(), strict=True)

    many = 8 * PART * degree
    led = _map(_only(graph, 1, "a"), count, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > many)
    return {r["part"]: min(SPREAD, -(-r["n"] // (many // 2))) for r in led.collect()}


def _both_ways(graph: DataFrame, hot: dict[int, int], degree: int) -> DataFrame:
    """For each part and share of it: its lists (kind 1), and the edges that lead to its nodes (kind 2: their end, their start, fresh)."""

    def send(part, kind, a, b, c, *_):
        for share in range(hot.get(part, 1)):
            yield _message(part * SPREAD + share, 1, a, None, c)
        ends, fresh = _ints(a).reshape(-1, degree), _flags(c).reshape(-1, degree)
        i, j = np.nonzero(ends >= 0)
        src, dst, fresh = (part << RANK_BITS) + i, ends[i, j], fresh[i, j]
        to = (dst >> RANK_BITS) * SPREAD
        for p, n in hot.items():
            if (own := to == p * SPREAD).any():
                to[own] += _mix(src[own]) % n
        for key, at in _runs(to):
            yield _message(key, 2, dst[at], src[at], fresh[at])

    return _map(_only(graph, 1, "a", "c"), send)


def _received(rows, degree: int) -> tuple:
    """Lists and their fresh flags; centres (places), starts and flags of the edges that lead there."""
    ends, new, centre, member, fresh = None, None, [], [], []
    for _, kind, a, b, c, *_ in rows:
        if kind == 1:
            ends, new = _ints(a).reshape(-1, degree), _flags(c).reshape(-1, degree)
        else:
            centre.append(_ints(a) & RANK_MASK)
            member.append(_ints(b))
            fresh.append(_flags(c))
    return ends, new, _joined(centre, np.int64), _joined(member, np.int64), _joined(fresh, bool)


def _descend(graph: DataFrame, homes: DataFrame, layout: _Layout, degree: int) -> DataFrame:
    """The lists after one round: neighbours of one node that improve either side's list.

    Each node's neighbours, in both directions, meet in one group; a node with
    very many is split into several groups, each with its own neighbours again.
    Two that have met there before, by edges that are not fresh, need not again,
    and a group without fresh edges is left out. All groups of a part are worked
    on together: each vector they need comes to the part once.
    """
    tasks, dimension, wide = layout.tasks, layout.dimension, 2 * degree
    hot = _hot(graph, degree)

    def ask(key, rows):
        ends, new, centre, member, fresh = _received(rows, degree)
        order = np.lexsort((_mix(member), centre))
        centre, member, fresh = centre[order], member[order], fresh[order]
        n = np.bincount(centre, minlength=len(ends))
        groups = np.maximum(-(-n // wide), key % SPREAD == 0)
        first = np.cumsum(groups) - groups
        places = np.arange(len(centre)) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(ends)), groups)
        i, j = np.nonzero(ends[owner] >= 0)
        group = np.concatenate([first[centre] + places // wide, i])
        member, fresh = np.concatenate([member, ends[owner[i], j]]), np.concatenate([fresh, new[owner[i], j]])
        order = np.lexsort((~fresh, member, group))
        single = np.ones(len(order), dtype=bool)
        single[1:] = (np.diff(group[order]) != 0) | (np.diff(member[order]) != 0)
        order = order[single]
        moved = np.bincount(group[order], weights=fresh[order], minlength=len(owner)) > 0
        order = order[moved[group[order]]]
        if not len(order):
            return
        ids, at = np.unique(member[order], return_inverse=True)
        lengths = np.bincount(group[order])
        yield _message(key // SPREAD, 3, np.array([key], dtype="<i8"), ids, at.astype("<i4"), fresh[order], lengths[lengths > 0].astype("<i4"))
        for part, own in _runs(ids >> RANK_BITS):
            yield _message(part, 2, np.array([key], dtype="<i8"), ids[own])

    def answer(part, rows):
        halves = low = None
        for _, kind, a, b, c, d, e in rows:
            if kind == 0:
                halves = np.frombuffer(b, dtype=_HALF).reshape(-1, dimension)
            elif kind == 1:
                low = _floats(b).reshape(-1, degree)[:, -1]
            elif kind == 2:
                at = _ints(b) & RANK_MASK
                yield _message(int(_ints(a)[0]), 2, b, halves[at], low[at])
            else:
                yield _message(int(_ints(a)[0]), 1, b, c, d, e)

    def improve(key, rows):
        for _, kind, a, b, c, d, _ in rows:
            if kind == 1:
                ids, at, fresh, lengths = _ints(a), np.frombuffer(b, "<i4"), _flags(c), np.frombuffer(d, "<i4")
                # The last row stands for empty places: it compares with nothing.
                units = np.full((len(ids) + 1, dimension), np.nan, dtype=np.float32)
                low = np.full(len(ids) + 1, np.inf, dtype=np.float32)
            else:
                own = np.searchsorted(ids, _ints(a))
                units[own], low[own] = _floats(b, _HALF).reshape(len(own), -1), _floats(c)
        starts, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
        step = max(1, (1 << 20) // int(lengths.max()) ** 2)
        held, count = [], 0
        for chosen in (order[i : i + step] for i in range(0, len(order), step)):
            places = np.arange(lengths[chosen].max())
            there = places < lengths[chosen][:, None]
            flat = np.where(there, starts[chosen][:, None] + places, 0)
            index, new = np.where(there, at[flat], len(ids)), there & fresh[flat]
            vectors = units[index]
            scores = vectors @ vectors.transpose(0, 2, 1)
            scores[:, places, places] = -3
            better = np.flatnonzero((scores > low[index][:, :, None]) & (new[:, :, None] | new[:, None, :]))
            g, i, j = np.unravel_index(better, scores.shape)
            held.append((index[g, i], index[g, j], scores.ravel()[better], np.ones(len(better), bool)))
            count += len(better)
            if count > 2 * HELD:
                held = [_top(*(np.concatenate(x) for x in zip(*held, strict=True)), degree)[:4]]
                count = min(len(held[0][0]), HELD)
        src, dst, score, *_ = _top(*(np.concatenate(x) for x in zip(*held, strict=True)), degree)
        yield from _to_homes(ids[src], ids[dst], score)

    asked = _at(_both_ways(graph, hot, degree), tasks, ask)
    known = _only(homes, 0, "b").unionByName(_only(graph, 1, "b"))
    found = _at(_at(asked.unionByName(known), tasks, answer), tasks, improve)
    return materialise(_at(found.unionByName(_only(graph, 1, "a", "b")), tasks, _merge(degree)))


def _changes(graph: DataFrame) -> tuple[int, int]:
    """How many edges of a graph are fresh, and how many there are."""
    made = _map(_only(graph, 1, "e"), lambda part, kind, a, b, c, d, e: [tuple(_ints(e).tolist())], "fresh bigint, held bigint")
    total = made.agg(F.sum("fresh").alias("fresh"), F.sum("held").alias("held")).first()
    return total["fresh"] or 0, total["held"] or 0


def build_graph(homes: DataFrame, layout: _Layout, degree: int = DEGREE) -> DataFrame:
    """For each part (see _homes) a row with the about `degree` nearest others of each of its nodes."""
    graph = _first_edges(homes, layout, degree)
    # Lists only get better, so this ends.
    while layout.size > 1:
        better = _descend(graph, homes, layout, degree)
        discard(graph)
        graph = better
        fresh, held = _changes(graph)
        if fresh <= SETTLED * held:
            break
    return graph


def slack(dimension: int) -> float:
    """How far two cosines of single floats may be out of order, at most."""
    one = 2.0**-23 + 2.0**-24 * (dimension + np.sqrt(dimension))
    return float(2 * one)


def _ways(graph: DataFrame, hot: dict[int, int], layout: _Layout, degree: int) -> DataFrame:
    """Neighbours in both directions, in blocks: a the nodes, b how many each has, c those."""
    blocks = layout.blocks

    def lists(key, rows):
        ends, _, centre, member, _ = _received(rows, degree)
        if key % SPREAD == 0:
            i, j = np.nonzero(ends >= 0)
            centre, member = np.concatenate([centre, i]), np.concatenate([member, ends[i, j]])
        if len(centre):
            order = np.lexsort((member, centre))
            single = np.ones(len(order), dtype=bool)
            single[1:] = (np.diff(centre[order]) != 0) | (np.diff(member[order]) != 0)
            order = order[single]
            own, n = np.unique(centre[order], return_counts=True)
            yield _message(_mix(key) % blocks, 1, (key // SPREAD << RANK_BITS) + own, n.astype("<i8"), member[order])

    return materialise(_at(_both_ways(graph, hot, degree), layout.tasks, lists))


def _places(part, kind, a, b, c, *_):
    nodes = _ints(a)
    width = len(c) // len(nodes)
    for at, node in enumerate(nodes.tolist()):
        yield (part << RANK_BITS) + at, node, c[at * width : (at + 1) * width]


def search_graph(queries: DataFrame, homes: DataFrame, graph: DataFrame, layout: _Layout, k: int, degree: int, beam: int = BEAM) -> DataFrame:
    """(q, node): the k best nodes found for each query node q, itself apart, and what single floats cannot tell from the last.

    Greedy search from the query's own place in the graph: each round opens the
    neighbours, in both directions, of those nodes not yet opened that are among
    the best `beam`. When none is left, the beam is doubled; a query whose k best
    do not change by that is done, the others go on. A query is one row with all
    nodes it has met, best first, itself before them; it asks each block once a round.
    """
    hot, blocks, near = _hot(graph, degree), layout.blocks, slack(layout.dimension)
    ways = _ways(graph, hot, layout, degree)
    tasks = blocks
    units = materialise(_map(_only(homes, 0, "a", "c"), lambda part, kind, a, b, c, *_: [_message(_mix(part) % blocks, 0, (part << RANK_BITS) + np.arange(len(a) // 8), c)]))
    placed = materialise(_map(_only(homes, 0, "a", "c"), _places, "id bigint, node bigint, unit binary"))
    begun = queries.join(placed, F.col("q") == F.col("node")).select(F.col("id").alias("to"), "unit")
    # a: the query's vector, b: nodes met, c: their scores, d: opened or not, e: the beam (0: done) and the answers of the beam before.
    start = lambda to, unit: [_message(to, 0, unit, np.array([to], "<i8"), np.array([2], _SINGLE), np.zeros(1, bool), np.array([beam], "<i8"))]
    state = materialise(_map(begun, start))

    def front(ids, opened, control):
        return np.flatnonzero(~opened[: control[0] + 1])

    def open_nodes(to, kind, a, b, c, d, e):
        ids = _ints(b)
        ids = ids[front(ids, _flags(d), _ints(e))]
        keys = (ids >> RANK_BITS) * SPREAD
        for key in sorted(hot.keys() & set((ids >> RANK_BITS).tolist())):
            own = ids[keys == key * SPREAD]
            ids, keys = np.concatenate([ids, *[own] * (hot[key] - 1)]), np.concatenate([keys, *(np.full(len(own), key * SPREAD + s) for s in range(1, hot[key]))])
        for block, at in _runs(_mix(keys) % blocks):
            yield _message(block, 2, np.array([to], "<i8"), np.unique(ids[at]))

    def neighbours_of(block, rows):
        ids, n, members, ends = [], [], [], None
        for _, kind, a, b, c, *_ in rows:
            if kind == 1:
                ids.append(_ints(a))
                n.append(_ints(b))
                members.append(_ints(c))
                continue
            if ends is None:
                own, n, members = _joined(ids, np.int64), _joined(n, np.int64), _joined(members, np.int64)
                order, begins = np.argsort(own, kind="stable"), np.cumsum(n) - n
                own, begins, n, ends = own[order], begins[order], n[order], True
            asked = _ints(b)
            left, right = np.searchsorted(own, asked), np.searchsorted(own, asked, side="right")
            met = [members[begins[x] : begins[x] + n[x]] for i, j in zip(left.tolist(), right.tolist(), strict=True) for x in range(i, j)]
            if met:
                yield _message(int(_ints(a)[0]), 1, np.unique(np.concatenate(met)))

    def unseen(to, rows):
        unit, seen, met = None, None, []
        for _, kind, a, b, *_ in rows:
            if kind == 0:
                unit, seen = a, _ints(b)
            else:
                met.append(_ints(a))
        if met:
            new = np.setdiff1d(np.concatenate(met), seen)
            for block, at in _runs(_mix(new >> RANK_BITS) % blocks):
                yield _message(block, 2, np.array([to], "<i8"), new[at], unit)

    def score(block, rows):
        ids, held, vectors = [], [], None
        for _, kind, a, b, c, *_ in rows:
            if kind == 0:
                ids.append(_ints(a))
                held.append(np.frombuffer(b, dtype=_SINGLE))
                continue
            if vectors is None:
                own = np.concatenate(ids)
                order = np.argsort(own)
                own, vectors, held = own[order], np.concatenate(held).reshape(len(own), -1)[order], []
            yield _message(int(_ints(a)[0]), 1, b, vectors[np.searchsorted(own, _ints(b))] @ np.frombuffer(c, dtype=_SINGLE))

    def advance(to, rows):
        ids, scores, opened, control, unit = [], [], [], None, None
        for _, kind, a, b, c, d, e in rows:
            if kind == 0:
                unit, control, now = a, _ints(e), _flags(d).copy()
                if not control[0]:
                    yield _message(to, 0, a, b, c, d, e)
                    return
                now[front(_ints(b), now, control)] = True
                ids.append(_ints(b))
                scores.append(np.frombuffer(c, _SINGLE))
                opened.append(now)
            else:
                ids.append(_ints(a))
                scores.append(np.frombuffer(b, _SINGLE))
                opened.append(np.zeros(len(ids[-1]), bool))
        ids, scores, opened = np.concatenate(ids), np.concatenate(scores), np.concatenate(opened)
        order = np.lexsort((ids, -scores))
        # The query's own node stays before all others.
        order = np.concatenate([order[ids[order] == to], order[ids[order] != to]])
        ids, scores, opened = ids[order], scores[order], opened[order]
        while control[0] and not len(front(ids, opened, control)):
            best = np.sort(ids[1 : k + 1])
            if opened.all() or len(control) > 1 and np.array_equal(control[1:], best):
                control = np.zeros(1, dtype="<i8")
                close = np.arange(len(ids)) <= k
                if len(ids) > k:
                    close |= scores >= scores[k] - np.float32(near)
                ids, scores, opened = ids[close], scores[close], opened[close]
            else:
                control = np.concatenate([[2 * control[0]], best]).astype("<i8")
        yield _message(to, 0, unit, ids, scores, opened, control)

    going = F.col("e") != F.lit(np.zeros(1, dtype="<i8").tobytes())
    while not state.where(going).isEmpty():
        opened = _at(_map(_only(state.where(going), 0, "b", "d", "e"), open_nodes).unionByName(ways), tasks, neighbours_of)
        asked = _at(opened.unionByName(_only(state.where(going), 0, "a", "b")), tasks, unseen)
        scored = _at(asked.unionByName(units), tasks, score)
        grown = materialise(_at(scored.unionByName(state), tasks, advance))
        discard(state)
        state = grown
    pairs = _map(_only(state, 0, "b"), lambda to, kind, a, b, *_: ((to, i) for i in _ints(b)[1:].tolist()), "q_id bigint, n_id bigint")
    names = placed.select(F.col("id"), F.col("node"))
    found = pairs.join(names.select(F.col("id").alias("q_id"), F.col("node").alias("q")), "q_id").join(names.withColumnRenamed("id", "n_id"), "n_id")
    found = materialise(found.select("q", "node"))
    for table in (state, ways, units, placed):
        discard(table)
    return found


def nearest(vectors: DataFrame, asks, k: int = 5, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    vectors has vec_id and embedding; `asks` is a condition on vec_id that names
    the queries. Every other row is a candidate. The score is the cosine of the
    original vectors in double precision; ties go to the smaller vec_id. Rows
    that take no part (see prepare) neither ask nor answer; a query with fewer
    candidates gets them all; an empty table gives no rows. Equal vectors are
    one node of the graph, so copies, however many, do not crowd it.
    """
    rows = prepare(vectors)
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.select("key", "vec_id").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = materialise(few.groupBy("key").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members")))
    by_node = members.select(F.col("node").alias("m_node"), "members")
    nodes = materialise(rows.join(by_node, F.col("vec_id") == F.col("m_node")).select(F.col("vec_id").alias("node"), "half", "unit", "raw"))
    layout = _Layout(nodes, degree)
    homes = _homes(nodes, layout)
    graph = build_graph(homes, layout, degree)

    keys = members.select(F.col("key").alias("m_key"), "node")
    asking = materialise(rows.where(asks).select("vec_id", "key").join(keys, F.col("key") == F.col("m_key")).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")))
    found = search_graph(asking.select("q").distinct(), homes, graph, layout, k, degree, beam)

    # Doubles decide among all that single floats cannot tell from the k-th.
    close = found.select("q", "node")
    close = close.unionByName(asking.select("q", F.col("q").alias("node")).distinct())
    raw = nodes.select(F.col("node").alias("n"), "raw")
    close = close.join(raw, F.col("node") == F.col("n")).drop("n").join(raw.select(F.col("n").alias("qn"), F.col("raw").alias("q_raw")), F.col("q") == F.col("qn"))

    def make():
        def produce(q, node, x, y):
            # Scaled by their largest entries, so that no product or norm leaves the doubles.
            a, b = (v / np.abs(v).max() for v in (np.frombuffer(x, dtype=np.float64), np.frombuffer(y, dtype=np.float64)))
            yield q, node, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

        return produce

    exact = flat_map(close.select("q", "node", "raw", "q_raw"), make, "q bigint, node bigint, score double")
    spread = exact.join(by_node, F.col("node") == F.col("m_node")).select("q", "score", F.explode("members").alias("vec_id"))
    answers = asking.join(spread.withColumnRenamed("q", "aq"), F.col("q") == F.col("aq")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
