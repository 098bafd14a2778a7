"""Token-id files: canonical length-limited Huffman codes from global counts.

A file set is a folder with three tables. `codebook` has the code length of
each id that occurs. `blocks` has independent blocks: payload bits, in which each
document starts at a whole byte, the bit offset of every STRIDE-th token of a
document, and the number of tokens of each.
`parts` has the number of tokens of each range of documents, from which the
position of a block in the whole sequence follows.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.llm.common import arrow_schema, flat_map, rows_of, ship_package, text_or_empty
from filingrisk.llm.vocabulary import encoded_pieces, tokenizer
from filingrisk.session import materialise

#: Longest code, in bits; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Tokens between two bit-offset checkpoints of a block.
STRIDE = 256
#: A block is closed at the first document end after so many tokens.
BLOCK_TOKENS = 1 << 18


def tokenize(docs: DataFrame, path: str, end_id: int | None, width: int = 4) -> DataFrame:
    """doc_id, ids (packed little-endian, `width` bytes each) of each whole text, end_id appended.

    For vocabularies whose splitting never joins characters across white space
    (`path` names one): what stands between white space is encoded by the
    tokenizers library on its own, which gives the same ids as the whole text. A null text is empty and has only the end id.
    """
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def make():
        known = encoded_pieces(path)

        def produce(doc_id, text):
            packed = known.of_text(text) + end
            yield doc_id, packed if width == 4 else np.frombuffer(packed, dtype="<u4").astype(f"<u{width}").tobytes()

        return produce

    kind = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {kind}, ids binary")


def count_ids(tokens: DataFrame, width: int = 4) -> dict[int, int]:
    """Global counts; each task sends one row per id it has met. Bounded by the vocabulary."""
    ship_package(tokens.sparkSession)

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            packed = b"".join(x for x in batch.column(0).to_pylist() if x)
            counted = np.bincount(np.frombuffer(packed, dtype=f"<u{width}").astype(np.int64), minlength=len(total))
            counted[: len(total)] += total
            total = counted
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most max_bits, by package-merge.

    Ties go to the smaller id. One id alone gets one bit, none gives no code.
    """
    symbols = sorted(counts, key=lambda i: (counts[i], i))
    if len(symbols) <= 1:
        return dict.fromkeys(symbols, 1)
    if len(symbols) > 1 << max_bits:
        raise ValueError(f"{len(symbols)} ids do not fit codes of {max_bits} bits")
    lengths = _plain_lengths([counts[s] for s in symbols])
    if max(lengths) > max_bits:
        lengths = _package_merge(np.array([counts[s] for s in symbols], dtype=np.float64), max_bits)
    return {s: int(n) for s, n in zip(symbols, lengths, strict=True)}


def _plain_lengths(weights: list[int]) -> list[int]:
    """Unlimited Huffman lengths; already optimal if none is too long."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        heapq.heappush(heap, (wa + wb, node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:n]


def _package_merge(weights: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths from the number of lists, out of max_bits, in which a symbol is taken."""
    n = len(weights)
    layers, merged = [], weights
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        values = np.concatenate([weights, pairs])
        order = np.argsort(values, kind="stable")
        layers.append(order < n)  # a symbol of its own, or a package
        merged = values[order]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for own in reversed(layers):
        singles = int(own[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    return lengths


class Codebook:
    """Canonical codes: by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(order) else 1
        # Left-justified, each code starts where the one before ends.
        spans = np.left_shift(1, self.bits - self.lengths)
        self.starts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        size = int(self.ids.max()) + 1 if len(order) else 0
        self.code_of = np.zeros(size, dtype=np.uint64)
        self.length_of = np.zeros(size, dtype=np.int64)
        self.code_of[self.ids] = (self.starts >> (self.bits - self.lengths)).astype(np.uint64)
        self.length_of[self.ids] = self.lengths

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every value of the next `bits` bits."""
        spans = np.left_shift(1, self.bits - self.lengths)
        table_ids, table_lengths = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        table_ids[: spans.sum()] = np.repeat(self.ids, spans)
        table_lengths[: spans.sum()] = np.repeat(self.lengths, spans)
        return table_ids, table_lengths

    def encode(self, ids: np.ndarray, sizes: np.ndarray, stride: int) -> tuple[list[bytes], list[np.ndarray]]:
        """Payload of each document, and in it the bit offset of every stride-th token.

        `ids` has the documents one after the other, `sizes` their lengths. A
        code has at most 32 bits, so it touches two 32-bit words; the parts of
        all codes that start in a word are disjoint and add up.
        """
        lengths = self.length_of[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(sizes)
        first = last - sizes
        n_bytes = (ends[last] - ends[first] + 7) // 8
        base = np.concatenate([[0], np.cumsum(n_bytes)])
        begins = ends[:-1] + np.repeat(8 * base[:-1] - ends[first], sizes)
        word = begins >> 5
        shifted = self.code_of[ids] << (64 - (begins & 31) - lengths).astype(np.uint64)
        out = np.zeros(int(base[-1] >> 2) + 3, dtype=np.uint64)
        if len(ids):
            firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            total = np.add.reduceat(shifted, firsts)  # no two share a bit
            out[word[firsts]] += total >> np.uint64(32)
            out[word[firsts] + 1] += total & np.uint64(0xFFFFFFFF)
        raw = out.astype(">u4").tobytes()
        payloads = [raw[x:y] for x, y in zip(base.tolist(), base[1:].tolist(), strict=False)]
        marks = [begins[f:e:stride] - 8 * b for f, e, b in zip(first.tolist(), last.tolist(), base.tolist(), strict=False)]
        return payloads, marks

    def decode(self, payload: bytes, checkpoints: np.ndarray, stride: int, tables) -> np.ndarray:
        """`stride` tokens behind each checkpoint, one row for each; one step decodes one token of all.

        What a row has beyond its document's last token means nothing.
        """
        table_ids, table_lengths = tables
        raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
        position = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(position), stride), dtype=np.uint32)
        down = np.uint32(32 - self.bits)
        last = len(window) - 1
        for step in range(stride):
            at = np.minimum(position >> 3, last)
            peek = (window[at] << (position & 7).astype(np.uint32)) >> down
            out[:, step] = table_ids[peek]
            position += table_lengths[peek]
        return out


_CODED = "doc_id bigint, n_tokens bigint, marks array<bigint>, payload binary"
_BLOCK = "part bigint, first bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, checkpoints array<bigint>, payload binary"


def write_ids(
    tokens: DataFrame, folder: str, parts: int, width: int = 4, max_bits: int = MAX_BITS, stride: int = STRIDE, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Write doc_id (a whole number), ids (packed, `width` bytes each) to `folder` in ascending doc_id order.

    The input is read more than once, so give it stored. Documents are coded
    where they are and only then ordered. Rows of one doc_id stand next to each
    other, ordered by their bits; null doc_ids come first. A block holds whole
    documents, more than block_tokens only for one that has more. An empty
    table gives empty files.
    """
    if max_bits > 24:
        raise ValueError("the decoder looks at 32 bits from a byte on, so codes have 24 bits at most")
    lengths = code_lengths(count_ids(tokens, width), max_bits)
    spark = tokens.sparkSession
    book = spark.createDataFrame(sorted(lengths.items()), "id bigint, length bigint")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    ids, bits = np.array(sorted(lengths)), np.array([lengths[i] for i in sorted(lengths)])
    shared = spark.sparkContext.broadcast((ids, bits))  # bounded by the vocabulary
    coded_schema, schema = arrow_schema(_CODED), arrow_schema(_BLOCK)

    def code(batches):
        book = Codebook(*shared.value)
        for batch in batches:
            packed = [x or b"" for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // width for x in packed], dtype=np.int64)
            stream = np.frombuffer(b"".join(packed), dtype=f"<u{width}").astype(np.int64)
            payloads, marks = book.encode(stream, sizes, stride)
            columns = (batch.column(0), sizes, [m.tolist() for m in marks], payloads)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, coded_schema.types, strict=True)], schema=coded_schema)

    def gather(batches):
        first, n, held, part = 0, 0, [], None

        def block():
            at, marks = 0, []
            for _, _, own, payload in held:
                marks += [at + m for m in own]
                at += 8 * len(payload)
            columns = ([part], [first], [n], [[h[0] for h in held]], [[h[1] for h in held]], [marks], [b"".join(h[3] for h in held)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for key, *row in rows_of(batch):
                if key != part:
                    if held:
                        yield block()
                    part, first, n, held = key, 0, 0, []
                held.append(row)
                n += row[1]
                if n >= block_tokens:
                    yield block()
                    first, n, held = first + n, 0, []
        if held:
            yield block()

    order = F.col("doc_id").asc_nulls_first()
    coded = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(code, _CODED)
    # Ranges of about equally many documents, from the ids alone: coding runs once, in the job that writes.
    stops = tokens.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    stops = F.array(*(F.lit(x) for x in sorted(set(stops)))) if parts > 1 else F.array()
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(stops.cast("array<bigint>"), lambda stop: stop < F.col("doc_id"))))
    ranged = coded.withColumn("part", part.cast("long")).repartitionById(parts, F.col("part").cast("int"))
    numbered = ranged.sortWithinPartitions("part", order, "payload").select("part", "doc_id", "n_tokens", "marks", "payload")
    numbered.mapInArrow(gather, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{folder}/parts")


@cache
def _reader(ids: bytes, lengths: bytes) -> tuple[Codebook, tuple]:
    book = Codebook(np.frombuffer(ids, dtype=np.int64), np.frombuffer(lengths, dtype=np.int64))
    return book, book.tables()


def read_ids(spark: SparkSession, folder: str, stride: int = STRIDE) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids; every block on its own."""
    book = sorted((r["id"], r["length"]) for r in spark.read.parquet(f"{folder}/codebook").collect())
    packed = tuple(np.array([r[k] for r in book], dtype=np.int64).tobytes() for k in (0, 1))
    shared = spark.sparkContext.broadcast(packed)
    # One row per range of documents: few, whatever the number of rows.
    sizes = sorted((r["part"], r["n_tokens"]) for r in spark.read.parquet(f"{folder}/parts").collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part] = at
        at += n

    def make():
        codes, tables = _reader(*shared.value)

        def produce(part, first, n_tokens, doc_ids, doc_tokens, checkpoints, payload):
            lanes = codes.decode(payload, np.array(checkpoints, dtype=np.int64), stride, tables)
            position = lane = 0
            for doc_id, n in zip(doc_ids, doc_tokens, strict=True):
                own = -(-n // stride)
                yield doc_id, before[part] + first + position, n, lanes[lane : lane + own].ravel()[:n].astype("<u4").tobytes()
                position, lane = position + n, lane + own

        return produce

    columns = [f.split(" ")[0] for f in _BLOCK.split(", ")]
    return flat_map(spark.read.parquet(f"{folder}/blocks").select(*columns), make, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def store_documents(docs: DataFrame, path: str, folder: str, parts: int, end_id: int | None = 1) -> None:
    """Tokenize whole texts and write their ids to `folder`."""
    width = 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    write_ids(materialise(tokenize(docs, path, end_id, width)), folder, parts, width)
