"""Exact top-k inner products: cover trees of queries and of data, searched in pairs of nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingrisk.llm.common import arrow_schema, flat_map, grouped, prepare_session, ship_package
from filingrisk.session import materialise

#: Entries become floor(SCALE * x).
SCALE = 256
#: Distinct vectors in one data tree and in one query tree, at most about.
BLOCK, QUERY_BLOCK = 4096, 512
#: Points below a leaf, on average.
LEAF = 16
#: Rows from which the pivots of the cells are taken, and most pivots. The index holds all rows whatever these are.
PIVOT_SAMPLE, PIVOTS = 8192, 1024
#: Data trees that a query tree searches first, for its first thresholds.
SEEDS = 2
#: Tree roots in one page when roots are compared.
PAGE = 1024
#: Share by which a bound is widened against rounding.
WIDER = 1e-9


@dataclass
class CoverTree:
    """A cover tree over `points`, which stand in depth-first order of the tree.

    `order` says which of the points given each was. A row of `table` is a node:
    place of its centre, begin and end of the points below it, begin and end of
    its child nodes (equal for a leaf). Row 0 is the root. `radius` has the
    greatest distance of a point below a node from its centre.
    """

    points: np.ndarray
    order: np.ndarray
    table: np.ndarray
    radius: np.ndarray


def _from(points: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """Squared distances from one point."""
    return np.maximum(lengths + lengths[at] - 2 * (points @ points[at]), 0.0)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """Cover tree with scales of powers of two, from a farthest-first order of the points.

    Each next centre is the point farthest from all before, so the centres with
    an insertion distance of at least 2^l are that far apart (separation), leave
    no point farther from them (covering), and are centres at all lower scales
    too (nesting). A centre hangs below the nearest one of the next scale. It
    ends at one centre for `leaf` points; each point goes to its nearest centre.
    Radii are the real distances to the points below, not the scales.
    """
    n = len(points)
    lengths = (points * points).sum(axis=1)
    centres, inserted = [0], [np.inf]
    near, nearest = _from(points, lengths, 0), np.zeros(n, dtype=np.int64)
    near[0] = 0.0
    while len(centres) < n // leaf:
        at = int(near.argmax())
        if near[at] <= 0:
            break
        inserted.append(float(np.sqrt(near[at])))
        away = _from(points, lengths, at)
        away[at] = 0.0
        closer = away < near
        nearest[closer], near[closer] = len(centres), away[closer]
        centres.append(at)
    scale = np.array([np.inf, *np.floor(np.log2(inserted[1:]))])
    own = points[centres]
    # children[c]: (scale, centre) of what hangs below centre c.
    hanging: list[list[tuple[float, int]]] = [[] for _ in centres]
    for level in sorted(set(scale[1:].tolist()), reverse=True):
        new = np.flatnonzero(scale == level)
        old = int(new[0])  # centres of greater scale stand before
        gaps = (own[new] ** 2).sum(axis=1)[:, None] + (own[:old] ** 2).sum(axis=1) - 2 * own[new] @ own[:old].T
        for c, parent in zip(new.tolist(), gaps.argmin(axis=1).tolist(), strict=True):
            hanging[parent].append((level, c))
    buckets = np.argsort(nearest, kind="stable")
    cuts = np.searchsorted(nearest[buckets], np.arange(len(centres) + 1))

    # A node is a centre at one of its scales, (centre, how many scales above have passed); a leaf has its bucket.
    levels_of = [sorted({s for s, _ in h}, reverse=True) for h in hanging]
    nodes, children, queue = [], [], [(0, 0)]
    while queue:
        nodes += queue
        below = []
        for c, depth in queue:
            first = len(nodes) + len(below)
            if depth < len(levels_of[c]):
                level = levels_of[c][depth]
                below.append((c, depth + 1))
                below += [(k, 0) for s, k in hanging[c] if s == level]
            children.append((first, len(nodes) + len(below)))
        queue = below
    begin, end, order = [0] * len(nodes), [0] * len(nodes), []
    at, stack = 0, [(0, False)]
    while stack:
        i, closed = stack.pop()
        if closed:
            end[i] = at
            continue
        begin[i] = at
        first, last = children[i]
        stack.append((i, True))
        stack += [(k, False) for k in range(last - 1, first - 1, -1)]
        if first == last:
            c = nodes[i][0]
            order.append(buckets[cuts[c] : cuts[c + 1]])
            at += len(order[-1])
    placed_at = np.concatenate(order)
    placed, place = points[placed_at], np.argsort(placed_at)
    centre = place[[centres[c] for c, _ in nodes]]
    table = np.stack([centre, begin, end, [c[0] for c in children], [c[1] for c in children]], axis=1).astype(np.int64)
    radius = np.array([np.sqrt(((placed[a:b] - placed[c]) ** 2).sum(axis=1).max()) for c, a, b, _, _ in table.tolist()])
    return CoverTree(placed, placed_at, table, radius)


def _worst(kth: np.ndarray, table: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The worst k-th score of the queries below each of some nodes."""
    known, at = np.unique(nodes, return_inverse=True)
    return np.array([kth[b:e].min() for b, e in table[known, 1:3].tolist()])[at]


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of all that may be among the k best of a query, given scores to reach.

    Dual-tree search: no product of a point below query node Q and one below data
    node R is above <q, r> + rad(Q) |r| + rad(R) |q| + rad(Q) rad(R), so a pair
    of nodes goes if that is below the worst k-th score of Q's queries. The
    wider node of a pair is opened. Pairs of leaves are taken by falling bound,
    scores of the k best raise the bar for the rest; equal scores go to the
    smaller id and so are never cut. Scores are exact whole numbers.
    """
    q_norm, r_norm = (np.sqrt((t.points[t.table[:, 0]] ** 2).sum(axis=1)) for t in (queries, data))
    q_centre, r_centre = queries.points[queries.table[:, 0]], data.points[data.table[:, 0]]
    q_leaf, r_leaf = queries.table[:, 3] == queries.table[:, 4], data.table[:, 3] == data.table[:, 4]
    kth = kth.astype(np.float64)
    q, r = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    base = []
    while len(q):
        reach = (q_norm[q] + queries.radius[q]) * (r_norm[r] + data.radius[r])
        bound = np.einsum("ij,ij->i", q_centre[q], r_centre[r]) + queries.radius[q] * r_norm[r] + data.radius[r] * (q_norm[q] + queries.radius[q])
        bound += WIDER * reach
        stay = bound >= _worst(kth, queries.table, q)
        q, r, bound = q[stay], r[stay], bound[stay]
        ends = q_leaf[q] & r_leaf[r]
        base.append((q[ends], r[ends], bound[ends]))
        q, r = q[~ends], r[~ends]
        left = r_leaf[r] | (~q_leaf[q] & (queries.radius[q] > data.radius[r]))
        made = []
        for side, nodes, opened, other in ((0, queries, q[left], r[left]), (1, data, r[~left], q[~left])):
            counts = nodes.table[opened, 4] - nodes.table[opened, 3]
            below = np.repeat(nodes.table[opened, 4] - np.cumsum(counts), counts) + np.arange(counts.sum())
            pair = below, np.repeat(other, counts)
            made.append(pair if side == 0 else pair[::-1])
        q, r = (np.concatenate([m[i] for m in made]) for i in (0, 1))
    q, r, bound = (np.concatenate([b[i] for b in base]) for i in range(3))
    order = np.lexsort((-bound, q))
    q, r, bound = q[order], r[order], bound[order]
    cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)] if len(q) else [0]
    found = []
    for start, stop in zip(cuts, cuts[1:], strict=False):
        _, first, last, _, _ = queries.table[q[start]].tolist()
        held = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * (last - first)
        bar, at, step = kth[first:last].copy(), start, 8
        while at < stop:
            part = slice(at, min(stop, at + step))
            at, step = part.stop, 2 * step
            leaves = r[part][bound[part] >= bar.min()]
            if not len(leaves):
                break
            rows = np.concatenate([np.arange(b, e) for b, e in data.table[leaves, 1:3].tolist()])
            scores = queries.points[first:last] @ data.points[rows].T
            for i in np.flatnonzero((scores >= bar[:, None]).any(axis=1)).tolist():
                met = np.flatnonzero(scores[i] >= bar[i])
                own, named = np.concatenate([held[i][0], scores[i, met]]), np.concatenate([held[i][1], ids[rows[met]]])
                best = np.lexsort((named, -own))[:k]
                held[i] = own[best], named[best]
                if len(best) == k:
                    bar[i] = max(bar[i], held[i][0][-1])
        found += [(first + i, named, own) for i, (own, named) in enumerate(held) if len(named)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    places = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    return places, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]).astype(np.int64)


def prepare(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, x (whole numbers of one length) of each vector that takes part, stored.

    Null vectors, those with a null or not finite entry, and rows without
    vec_id take no part; of rows with one vec_id only that with the smallest
    vector is taken. Shorter vectors are filled up with zeros, which changes no
    product.
    """
    prepare_session(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c")).where("vec_id is not null and c is not null")
    rows = rows.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = materialise(rows.select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(SCALE)))).alias("x")))
    width = whole.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    single = whole.select("vec_id", filled.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    return materialise(single)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """node (smallest vec_id), x, members: the k smallest vec_ids of each vector.

    More of one vector are in no answer of k: equal products go to the smaller
    id. The limit acts before the shuffle, so a vector with very many copies
    sends k rows of each task.
    """
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("r") <= k)
    made = few.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return materialise(made.select(F.element_at("members", 1).alias("node"), "x", "members"))


def choose_pivots(points: DataFrame) -> np.ndarray:
    """Centres of the cells into which the data is dealt: the top of the cover tree.

    A farthest-first choice among the PIVOT_SAMPLE points of the smallest hash.
    """
    size = points.count()
    sample = points.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(PIVOT_SAMPLE).toArrow()
    if not size:
        return np.zeros((0, 0))
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1).astype(np.float64)
    lengths, chosen = (x * x).sum(axis=1), [0]
    near = _from(x, lengths, 0)
    while len(chosen) < min(PIVOTS, 2 * -(-size // BLOCK)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _from(x, lengths, chosen[-1]))
    return x[chosen]


_TREE = "block bigint, root array<double>, radius double, ids binary, points binary, kind string, nodes binary, radii binary"
_NODE_COLUMNS = 5


def build_trees(points: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """One cover tree for each block of the points (node, x), stored.

    A block is a cell, the points nearest to one pivot, or where that has more
    than `block` points, one of its parts by hash.
    """
    spark = points.sparkSession
    ship_package(spark)
    lengths = (pivots * pivots).sum(axis=1)
    placed = arrow_schema("node bigint, x array<bigint>, cell bigint")

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                cell = (lengths - 2 * (x @ pivots.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(placed.types[1]), pa.array(cell)], schema=placed)

    in_cells = materialise(points.select("node", "x").mapInArrow(place, "node bigint, x array<bigint>, cell bigint"))
    parts = in_cells.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = in_cells.join(parts, F.col("cell") == F.col("c"))
    # Cells are at most PIVOTS, so a block's number is its cell's and its part's.
    dealt = dealt.select((F.col("cell") + PIVOTS * F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"), "node", "x")
    schema = arrow_schema(_TREE)

    def build(batches):
        for (number,), table in grouped(batches, 1):
            table = table.sort_by("node")
            ids = table["node"].to_numpy()
            x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            tree = build_tree(x.astype(np.float64))
            kind = np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1).str
            columns = (
                [int(number)], [tree.points[tree.table[0, 0]].tolist()], [float(tree.radius[0])], [ids[tree.order].astype("<i8").tobytes()],
                [x[tree.order].astype(kind).tobytes()], [kind], [tree.table.astype("<i8").tobytes()], [tree.radius.astype("<f8").tobytes()],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return materialise(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(build, _TREE))


def _unpack(ids: bytes, points: bytes, kind: str, nodes: bytes, radii: bytes) -> tuple[np.ndarray, CoverTree]:
    own = np.frombuffer(ids, dtype="<i8")
    x = np.frombuffer(points, dtype=kind).reshape(len(own), -1).astype(np.float64)
    return own, CoverTree(x, np.arange(len(own)), np.frombuffer(nodes, dtype="<i8").reshape(-1, _NODE_COLUMNS), np.frombuffer(radii, dtype="<f8"))


def root_pairs(query_trees: DataFrame, trees: DataFrame) -> DataFrame:
    """(q_block, block, near, bound) of every query tree with every data tree, stored.

    near is the product of the roots, bound that which no product of points
    below them exceeds. Roots are compared in pages of about PAGE: each page of
    query roots is sent to each page of data roots.
    """

    def paged(df, page):
        n = max(1, -(-df.count() // PAGE))
        root = F.struct("block", "root", "radius")
        return df.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).alias(page)).agg(F.collect_list(root).alias(f"{page}_roots")), n

    (asks, _), (data, shelves) = paged(query_trees, "page"), paged(trees, "shelf")
    asks = asks.select("page_roots", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))).alias("to"))
    met = asks.join(data, F.col("to") == F.col("shelf")).select("page_roots", "shelf_roots")

    def make():
        def arrays(roots):
            return (np.array([r[c] for r in roots], dtype=np.float64).reshape(len(roots), -1) for c in ("root", "radius"))

        def produce(queries, data):
            (q, q_radius), (r, r_radius) = arrays(queries), arrays(data)
            q_norm, r_norm = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(r, axis=1)
            near = q @ r.T
            bound = near + q_radius * r_norm + r_radius[:, 0] * (q_norm + q_radius)
            bound += WIDER * (q_norm + q_radius) * (r_norm + r_radius[:, 0])
            for i, asked in enumerate(queries):
                for j, held in enumerate(data):
                    yield asked["block"], held["block"], float(near[i, j]), float(bound[i, j])

        return produce

    return materialise(flat_map(met, make, "q_block bigint, block bigint, near double, bound double"))


def search_pairs(pairs: DataFrame, query_trees: DataFrame, trees: DataFrame, bars: DataFrame, k: int) -> DataFrame:
    """(q, node, score): what pairs (q_block, block) of trees hold for the k best of each query, stored.

    bars has q_block and `bars`, the known k-th score by query where there is
    one. A data tree is sent once for some query trees that ask it, and so to
    several tasks if many do.
    """
    spark = trees.sparkSession
    ship_package(spark)
    payload = ["ids", "points", "kind", "nodes", "radii"]
    asked = pairs.groupBy(F.col("block").alias("b")).agg(F.ceil(F.count("*") / 64).alias("slices"))
    own_bars = F.coalesce("bars", F.expr("cast(map() as map<bigint, bigint>)")).alias("bars")
    asks = pairs.select("block", "q_block").join(asked, F.col("block") == F.col("b"))
    asks = asks.select("block", F.pmod(F.xxhash64("q_block"), F.col("slices")).alias("slice"), F.col("q_block").alias("qb"))
    asks = asks.join(query_trees.withColumnRenamed("block", "q_block"), F.col("qb") == F.col("q_block")).drop("q_block")
    asks = asks.join(bars, F.col("qb") == F.col("q_block"), "left").select("block", "slice", F.lit(1).alias("side"), *payload, own_bars)
    held = trees.join(asked, F.col("block") == F.col("b")).select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"), *payload,
        F.expr("cast(map() as map<bigint, bigint>)").alias("bars"),
    )
    schema = arrow_schema("q bigint, node bigint, score bigint")

    def run(batches):
        current = data = None
        for batch in batches:
            for row in range(batch.num_rows):
                block, part, side, *packed, known = (c[0] for c in (column.slice(row, 1).to_pylist() for column in batch.columns))
                ids, tree = _unpack(*packed)
                if side == 0:
                    current, data = (block, part), (ids, tree)
                    continue
                assert current == (block, part)
                _check_range(tree, data[1])
                known = dict(known)
                kth = np.array([known.get(q, -np.inf) for q in ids.tolist()], dtype=np.float64)
                at, nodes, scores = search(tree, data[1], data[0], k, kth)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(nodes), pa.array(scores)], schema=schema)

    both = held.unionByName(asks).repartition("block", "slice").sortWithinPartitions("block", "slice", "side")
    return materialise(both.mapInArrow(run, "q bigint, node bigint, score bigint"))


def _check_range(queries: CoverTree, data: CoverTree) -> None:
    """Doubles hold every product and partial sum exactly below 2^53."""
    longest = [float(np.sqrt((t.points**2).sum(axis=1).max(initial=0.0))) for t in (queries, data)]
    if longest[0] * longest[1] >= 2.0**53:
        raise OverflowError("inner products beyond 2^53")


def top_products(vectors: DataFrame, asks, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query, exactly.

    vectors has vec_id and embedding, whose entries become floor(SCALE * x);
    `asks` is a condition on vec_id that names the queries. Every other row is a
    candidate; equal scores go to the smaller vec_id. Rows that take no part
    (see prepare) neither ask nor answer; a query with fewer candidates gets
    them all; an empty table gives no rows. Products from 2^53 on raise an
    OverflowError.

    Equal vectors are one point. Each query tree first searches the SEEDS data
    trees whose roots lie best, which gives its queries a k-th score; then all
    other data trees whose bound reaches the worst of these. Both times node
    pairs below are pruned alike.
    """
    spark = vectors.sparkSession
    rows = prepare(vectors)
    # One more than asked for, since a query may be among its own answers.
    want = k + 1
    points = distinct_vectors(rows, want)
    pivots = choose_pivots(points)
    asking = materialise(rows.where(asks).select(F.col("vec_id").alias("query_id"), "x"))
    asked = materialise(asking.groupBy("x").agg(F.min("query_id").alias("node")))
    if not len(pivots) or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    trees = build_trees(points, pivots, BLOCK)
    query_trees = build_trees(asked, pivots, QUERY_BLOCK)
    pairs = root_pairs(query_trees, trees)

    by_nearness = Window.partitionBy("q_block").orderBy(F.desc("near"), "block")
    ranked = materialise(pairs.withColumn("r", F.row_number().over(by_nearness)))
    none = spark.createDataFrame([], "q_block long, bars map<bigint, bigint>")
    first = search_pairs(ranked.where(F.col("r") <= SEEDS), query_trees, trees, none, want)

    reached = first.groupBy("q").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    reached = reached.select("q", F.when(F.col("n") >= want, F.element_at("scores", F.least("n", F.lit(want)).cast("int"))).alias("kth"))
    places = flat_map(query_trees.select("block", "ids"), _each_id, "q_block bigint, node bigint")
    worst = places.join(reached, F.col("node") == F.col("q"), "left").groupBy("q_block").agg(
        F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("worst"),
        F.map_from_entries(F.collect_list(F.when(F.col("kth").isNotNull(), F.struct("node", "kth")))).alias("bars"),
    )
    worst = materialise(worst)
    open_ = ranked.where(F.col("r") > SEEDS).join(worst.select(F.col("q_block").alias("wb"), "worst"), F.col("q_block") == F.col("wb"))
    open_ = open_.where(F.col("bound") >= F.col("worst")).select("q_block", "block")
    rest = search_pairs(open_, query_trees, trees, worst.select("q_block", "bars"), want)

    met = first.unionByName(rest)
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("r") <= want)
    by_node = points.select(F.col("node").alias("n"), "members")
    listed = best.join(by_node, F.col("node") == F.col("n")).select("q", "score", F.explode("members").alias("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= want)
    # Per query vector k + 1 answers; every query with it drops itself.
    answer = F.struct(F.col("r").alias("r"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    answers = listed.groupBy("q").agg(F.array_sort(F.collect_list(answer)).alias("answers"))
    named = asked.select(F.col("node").alias("a_node"), F.col("x").alias("ax"))
    asking = asking.join(named, F.col("x") == F.col("ax")).select("query_id", "a_node")
    own = asking.join(answers, F.col("a_node") == F.col("q"))
    others = F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k)
    spread = own.select("query_id", F.posexplode(others).alias("at", "a"))
    return spread.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "a.vec_id", "a.score")


def _each_id():
    def produce(block, ids):
        for q in np.frombuffer(ids, dtype="<i8").tolist():
            yield block, q

    return produce
