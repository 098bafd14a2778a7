"""MinHash near-duplicates with sequential Bayesian verification of banded candidates.

Equal sets are one node. Nodes that share a band are compared along stars, with
the smallest and the largest node of the bucket; verified links make components.
What stars cannot settle, members of a bucket that are still in different
components, is compared in blocks inside tasks, which send on links only. Every pair that the posterior does not rule out and that could
join two components is verified on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingrisk.llm.common import arrow_schema, flat_map, ship_package, text_or_empty
from filingrisk.session import materialise

BANDS, ROWS = 64, 8
#: Signature bytes for verification, compared in batches of BATCH.
CHECKED, BATCH = 512, 64
#: Chance at most that a linked pair is ruled out at one batch.
MISS = 1e-6
#: Members of a group in one block; more are dealt to several.
BLOCK = 1024

_SEEDS = np.random.default_rng(20240229)
_FACTORS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND_MIX = _SEEDS.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> its 64-bit hash, packed."""

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        if len(self) >= 300_000:
            self.clear()
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none give none.

    Only A-Z is lower-cased; ASCII white space divides words.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.frombuffer(b"".join([known[w] for w in words]), dtype="<u8")
    size = min(k, len(hashes))
    value = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        value = _mixed(value * _STEP + hashes[j : j + len(value)])
    return np.unique(value)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum per hash function, over all shingles."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(low, (x[at : at + 256, None] * _FACTORS + _SHIFTS).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    mixed = (low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MIX).sum(axis=1, dtype=np.uint64)
    return _mixed(mixed + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def checked_bytes(low: np.ndarray) -> bytes:
    return ((low[:CHECKED] * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches: the fewest matching bytes at which a pair stays.

    With a uniform prior the posterior of the match rate after m of n is a beta
    distribution, and its mass above the rate q of a pair at the threshold is
    the chance of at most m successes in n + 1 draws at q.
    """
    t = percent / 100
    q = t + (1 - t) / 256
    out = []
    for n in range(BATCH, CHECKED + 1, BATCH):
        mass = 0.0
        for m in range(n + 1):
            mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(q) + (n + 1 - m) * math.log1p(-q))
            if mass >= miss:
                break
        out.append(m)
    return out


def sift(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which row pairs of two byte matrices stay through all batches, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, need in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, cols] == b[alive, cols]).sum(axis=1)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    return alive, matches[alive]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), CHECKED)


def _sift_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b, matches) of the pairs that their signatures do not rule out."""
    ship_package(pairs.sparkSession)
    least, schema = least_matches(percent), arrow_schema("a bigint, b bigint, matches bigint")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stay, matches = sift(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                rows = batch.take(pa.array(stay))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(matches)], schema=schema)

    for side in ("a", "b"):
        sig = signatures.select(F.col("node").alias(f"node_{side}"), F.col("sig").alias(f"sig_{side}"))
        pairs = pairs.join(sig, F.col(side) == F.col(f"node_{side}")).drop(f"node_{side}")
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, matches bigint")


def _link_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between different components of a group, enough to join what is linked.

    members has grp, chunk, asks, node, comp, sig, shingles: rows that ask (asks
    true) are compared with the rows of their chunk that do not, first by
    signature, then on the full sets. Pairs whose components this chunk has
    joined already are passed over. A task holds the rows of one chunk, at most
    about BLOCK, and one batch of rows that ask.
    """
    ship_package(members.sparkSession)
    least, schema = least_matches(percent), arrow_schema("a bigint, b bigint")

    def run(batches):
        key, held, table, joined = None, [], None, {}

        def root(comp):
            while joined.get(comp, comp) != comp:
                comp = joined[comp]
            return comp

        def unpack(rows):
            sets = [np.frombuffer(x, dtype="<u8") for x in rows.column(6).to_pylist()]
            sizes = np.array([len(x) for x in sets])
            return rows.column(3).to_numpy(), rows.column(4).to_numpy(), _matrix(rows.column(5)), sets, sizes

        def compare(rows: pa.RecordBatch):
            nonlocal table
            if not held:
                return
            if table is None:
                table = unpack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            nodes, comps, sigs, sets, sizes = table
            node, comp, sig, own, lengths = unpack(rows)
            step = max(1, (1 << 16) // len(nodes))
            links = []
            for at in range(0, len(node), step):
                cut = slice(at, at + step)
                small, large = np.minimum(lengths[cut, None], sizes), np.maximum(lengths[cut, None], sizes)
                i, j = np.nonzero((comp[cut, None] != comps) & (100 * small >= percent * large))
                if not len(i):
                    continue
                stay, matches = sift(sig[at + i], sigs[j], least)
                for p in stay[np.argsort(-matches, kind="stable")].tolist():
                    x, y = at + int(i[p]), int(j[p])
                    ra, rb = root(int(comp[x])), root(int(comps[y]))
                    if ra != rb and similar(own[x], sets[y], percent):
                        joined[max(ra, rb)] = min(ra, rb)
                        links.append((int(node[x]), int(nodes[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, chunks, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (chunks[1:] != chunks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (groups[start], chunks[start]) != key:
                    key, held, table, joined = (groups[start], chunks[start]), [], None, {}
                part = batch.slice(start, end - start)
                if asks[start]:
                    yield from compare(part)
                else:
                    held.append(part)

    ordered = members.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "asks")
    return ordered.select("grp", "chunk", "asks", "node", "comp", "sig", "shingles").mapInArrow(run, "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), for every node that has one.

    Alternates the two star steps until nothing moves; each step is two
    aggregations and joins, so a node of any degree is spread over tasks.
    """
    tree = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w"))
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = materialise(hung.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        new = tree.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


class Linker:
    """Grows verified links between nodes, round by round."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.docs, self.k, self.percent = docs, k, percent
        self.links = self.comps = None

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """node and its packed shingle hashes, from the texts of the needed nodes only.

        A bitmap of fixed size, set by the nodes' ids, keeps most other texts
        from being cut into shingles; the join drops the rest.
        """
        bits = 1 << 24
        hashed = nodes.select(F.pmod(F.xxhash64("node"), F.lit(bits)).alias("bit"))
        words = hashed.groupBy((F.col("bit") / 8).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits"))
        found = words.toArrow()
        table = np.zeros(bits >> 3, dtype=np.uint8)
        table[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
        shared, k = self.docs.sparkSession.sparkContext.broadcast(table), self.k

        def make():
            known, wanted = WordHashes(), shared.value

            def produce(node, bit, text):
                if wanted[bit >> 3] >> (bit & 7) & 1:
                    yield node, shingle_set(text, k, known).tobytes()

            return produce

        rows = self.docs.where(F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)), text_or_empty().alias("text")
        )
        made = flat_map(rows, make, "node bigint, shingles binary")
        return made.join(nodes.select(F.col("node").alias("n")).distinct(), F.col("node") == F.col("n"), "left_semi").dropDuplicates(["node"])

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs whose full sets are similar enough to the links."""
        percent, schema = self.percent, arrow_schema("a bigint, b bigint")
        pairs = materialise(pairs.select("a", "b").distinct())
        if self.links is not None and pairs.isEmpty():
            return
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = materialise(self.sets_of(nodes))

        def run(batches):
            for batch in batches:
                keep = []
                for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    if similar(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent):
                        keep.append(i)
                rows = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], schema=schema)

        rows = pairs
        for side in ("a", "b"):
            own = sets.select(F.col("node").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}"))
            rows = rows.join(own, F.col(side) == F.col(f"n_{side}"))
        self.add(rows.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint"))

    def add(self, made: DataFrame) -> None:
        """Adds verified links and labels the components anew."""
        links = made if self.links is None else made.unionByName(self.links)
        self.links = materialise(links)
        self.comps = materialise(connected(self.links))

    def verify_likeliest(self, pairs: DataFrame) -> None:
        """Verifies the likeliest pair of each node, then the pairs that still lie between components."""
        ends = pairs.select(F.col("a").alias("node"), "matches", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "matches", "a", "b"))
        best = ends.groupBy("node").agg(F.max(F.struct("matches", "a", "b")).alias("best")).select("best.a", "best.b")
        self.verify(best)
        self.verify(self.between(pairs))

    def labelled(self, df: DataFrame, column: str, label: str) -> DataFrame:
        """df with the component of a node column; a node without links is its own."""
        comps = self.comps.select(F.col("node").alias("c_node"), F.col("comp").alias(label))
        joined = df.join(comps, F.col(column) == F.col("c_node"), "left").drop("c_node")
        return joined.withColumn(label, F.coalesce(label, column))

    def between(self, pairs: DataFrame) -> DataFrame:
        """The pairs that join different components."""
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")


def mixed_buckets(linker: Linker, members: DataFrame) -> DataFrame:
    """bucket, node, n, comp, main of the buckets in which several components meet; main is the largest."""
    placed = linker.labelled(members.select("bucket", "node", "n"), "node", "comp")
    per_comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    mixed = per_comp.groupBy(F.col("bucket").alias("b")).agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    # Two members have been compared with each other already.
    return materialise(placed.join(mixed.where("comps > 1"), F.col("bucket") == F.col("b")).where("n > 2").drop("b"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and for sets that are not empty a 128-bit key, signature and band keys."""

    def make():
        known = WordHashes()

        def produce(doc_id, text):
            shingles = shingle_set(text, k, known)
            if not len(shingles):
                yield doc_id, 0, None, None, None
                return
            low = signature(shingles)
            yield doc_id, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), checked_bytes(low), band_keys(low).tolist()

        return produce

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return flat_map(rows, make, "doc_id bigint, n_shingles bigint, set_key binary, sig binary, bands array<bigint>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs.

    Two documents are linked if 100 * shared shingles >= percent * all shingles
    of both; component_id is the smallest doc_id that links lead to, and kept
    marks the document that carries it. Texts without words, and null texts,
    have no shingles and are linked with nothing. Rows that share a doc_id count
    as linked. A row without doc_id is labelled like its equals; where those
    have no doc_id either it has no component and is kept. Repeated rows give
    repeated rows; columns other than doc_id and text are not read.

    Links are found with the chance that banding leaves: a pair at 80 percent
    shares none of the 64 bands of 8 rows with probability 8e-6, less above.
    """
    sets = materialise(_sets(docs, k))
    some = sets.where(F.col("n_shingles") > 0)
    nodes = some.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.where(F.col("node").isNotNull()))
    sigs = nodes.select("node", "sig")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    members = materialise(banded.join(buckets, F.col("bucket") == F.col("b")).select("bucket", "node", "low", "high", "n"))

    linker = Linker(docs, k, percent)
    star = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    star = star.unionByName(members.where("node <> high").select(F.col("node").alias("a"), F.col("high").alias("b"))).distinct()
    stay = materialise(_sift_pairs(star, sigs, percent))
    linker.verify_likeliest(stay)

    # What is outside the largest component of its bucket then asks all that meet
    # that component anywhere, each node once.
    placed = mixed_buckets(linker, members)
    met = materialise(placed.select(F.col("main").alias("grp"), "node", "comp").distinct())
    chunks = met.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    met = met.join(chunks, F.col("grp") == F.col("g")).drop("g")
    answers = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("asks", F.lit(False))
    asking = met.where("comp <> grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(True))
    needed = met.select("node").distinct()
    keyed = linker.sets_of(needed).join(sigs.select(F.col("node").alias("s_node"), "sig"), F.col("node") == F.col("s_node"))
    keyed = materialise(keyed.select("s_node", "sig", "shingles"))
    both = answers.unionByName(asking).join(keyed, F.col("node") == F.col("s_node"))
    linker.add(_link_blocks(both, percent))

    labels = linker.labelled(nodes.select("set_key", "node"), "node", "component_id").select(F.col("set_key").alias("key"), "component_id")
    found = some.select("doc_id", "n_shingles", "set_key").join(labels, F.col("set_key") == F.col("key"), "left").drop("set_key", "key")
    rest = sets.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.unionByName(rest).withColumn("kept", kept)
