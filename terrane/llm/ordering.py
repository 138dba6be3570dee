"""Token sequences written in training order: a keyed Feistel permutation gives every sequence its global slot.

Documents are tokenized once, with an end id after each; what a task has written knows its place in the task, and
the places of the tasks come from their totals. That makes one stream of tokens, cut into sequences of equal length.
A Feistel network over the smallest even number of bits that holds the sequence count is a permutation of more
numbers than there are sequences; walking its cycle until a number is in range makes it one of exactly the sequences.
Slots are cut into ranges; each range is one task's shard file of fixed stride, so the bytes of slot s are known
by arithmetic, and reading can go on at any slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrane.llm.common import runs, table
from terrane.llm.tokens import rank_encoder
from terrane.session import Stored, checkpoint_folder

LENGTH = 1024
PER_SHARD = 8192      # sequences in a shard file: 16 MB
CHUNK = 1 << 19       # tokens that are packed together between the two passes
LEVEL = 6             # of their compression
ROUNDS = 6
END_ID = 50256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each of ``numbers`` in [0, n) under the permutation of ``key``."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = _mixed(np.uint64(key % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.asarray(numbers).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys:
                left, right = right, left ^ (_mixed(right + k) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _tokens(vocabulary: str, pattern: str, end_id: int, kind: pa.DataType):
    """Chunks of whole documents: how many tokens of the task come before, ids and counts per document, all ids packed."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(vocabulary, pattern).encode_ordinary
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        part, before, size = TaskContext.get().partitionId(), 0, 0
        docs, held = [], []

        def chunk():
            counts = [len(t) for t in held]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([before], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([docs], pa.list_(kind)),
                pa.array([counts], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held).tobytes())], pa.binary())],
                names=["part", "before", "n", "doc_ids", "counts", "ids"])

        for b in rows:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                docs.append(doc)
                held.append(np.array([*encode(text or ""), end_id], "<u2"))
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    before, size = before + size, 0
                    docs, held = [], []
        if held:
            yield chunk()
    return batches


def _pieces(length: int, n: int, key: int, per_shard: int, kind: pa.DataType):
    """Cuts documents at the ends of sequences. One row for each chunk and shard: slots of its pieces, their places there and lengths, all ids packed."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        kinds = {"shard": pa.int64(), "slots": pa.list_(pa.int64()), "sequence_ids": pa.list_(pa.int64()), "at": pa.list_(pa.int32()),
                 "lengths": pa.list_(pa.int32()), "doc_ids": pa.list_(kind), "ids": pa.binary()}
        for b in rows:
            for start, docs, counts, packed in zip(*(b.column(c).to_pylist() for c in ("start", "doc_ids", "counts", "ids"))):
                t, zero = unpack(packed), start
                doc, first, size = [], [], []
                for d, count in zip(docs, counts):
                    s, end = start, start + count
                    while s < end:
                        e = min(end, (s // length + 1) * length)
                        doc.append(d)
                        first.append(s)
                        size.append(e - s)
                        s = e
                    start = end
                first, size = np.array(first, np.int64), np.array(size, np.int32)
                slot = slots(first // length, n, key)
                shard = slot // per_shard
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
                for s, e in zip(cuts, [*cuts[1:], len(order)]):
                    own = order[s:e]
                    ids = b"".join([t[2 * (f - zero):2 * (f - zero + k)] for f, k in zip(first[own].tolist(), size[own].tolist())])
                    row = [int(shard[own[0]]), slot[own], first[own] // length, (first[own] % length).astype(np.int32), size[own], [doc[k] for k in own], pack(ids)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values())], names=list(kinds))
    return batches


def _filesystem(uri: str):
    """A pyarrow file system and the path in it, for a local folder or a store that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _written(folder: str, length: int, per_shard: int, end_id: int, kind: pa.DataType):
    """Sorts the pieces of each shard, writes them under a name of their own and then moves the file, so a repeated task leaves one whole file."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["slot", "sequence_id", "shard", "place", "n_tokens", "ids_crc32", "doc_ids"]
        kinds = [*[pa.int64()] * 6, pa.list_(kind)]
        for shard, t in runs(rows, "shard"):
            whole = lambda c: t.column(c).combine_chunks().flatten()
            slot, at, size = (whole(c).to_numpy() for c in ("slots", "at", "lengths"))
            sequence, docs = whole("sequence_ids").to_numpy(), whole("doc_ids").to_pylist()
            ids = np.frombuffer(b"".join(map(unpack, t.column("ids").to_pylist())), "<u2")
            begin = np.cumsum(size, dtype=np.int64) - size
            order = np.lexsort((at, slot))
            cuts = np.flatnonzero(np.diff(slot[order], prepend=-1)).tolist()
            own = f"{path}/.{shard_name(shard)}.{uuid.uuid4().hex}"
            made: list[tuple] = []
            with store.open_output_stream(own) as out:
                for s, e in zip(cuts, [*cuts[1:], len(order)]):
                    pieces = order[s:e]
                    held = np.concatenate([ids[begin[k]:begin[k] + size[k]] for k in pieces])
                    out.write(held.tobytes() + np.full(length - len(held), end_id, "<u2").tobytes())
                    place = int(slot[pieces[0]])
                    made.append((place, int(sequence[pieces[0]]), shard, place % per_shard, len(held), zlib.crc32(held.tobytes()), [docs[k] for k in pieces]))
            store.move(own, f"{path}/{shard_name(shard)}")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
    return batches


def materialise(docs: DataFrame, folder: str, vocabulary: str, pattern: str = public_tokenizers.PATTERN, key: int = 1,
                length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID) -> DataFrame:
    """Write the shards into ``folder`` and return one row per sequence.

    Columns: slot, sequence_id, shard, place in the shard, n_tokens (only the last sequence of the stream has
    fewer than ``length``; its rest is the end id), crc32 of the ids, doc_ids of its pieces. Null and empty texts
    give their end id; repeated rows are documents of their own; an empty table writes nothing. The stream follows the
    files and their splits. Only doc_id and text are read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = docs.select("doc_id", "text").mapInArrow(
        _tokens(vocabulary, pattern, end_id, arrow), f"part long, before long, n long, doc_ids array<{kind}>, counts array<long>, ids binary")
    stored = Stored(rows, {"tokens": F.sum("n")})
    total = stored.measures["tokens"] or 0
    n = -(-total // length)
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    parts = stored.table.groupBy("part").agg(F.sum("n").alias("held"))  # a row for each task
    parts = parts.select("part", F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    # one row of two numbers for each task of the first stage
    placed = stored.table.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "counts", "ids")
    pieces = placed.mapInArrow(
        _pieces(length, n, key, per_shard, arrow),
        f"shard long, slots array<long>, sequence_ids array<long>, at array<int>, lengths array<int>, doc_ids array<{kind}>, ids binary")
    # a task for each shard
    pieces = pieces.repartitionById(max(1, -(-n // per_shard)), F.col("shard").cast("int"))
    done = pieces.mapInArrow(
        _written(folder, length, per_shard, end_id, arrow),
        f"slot long, sequence_id long, shard long, place long, n_tokens long, ids_crc32 long, doc_ids array<{kind}>")
    manifest = Stored(done).table
    stored.drop()
    return manifest


def read_sequences(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences of slots first, first + 1, ..., read front to back; a reader that stopped goes on at its next slot."""
    store, path = _filesystem(folder)
    last = first + count
    while first < last:
        end = min(last, (first // per_shard + 1) * per_shard)
        name = f"{path}/{shard_name(first // per_shard)}"
        if not store.get_file_info(name).is_file:  # the shards are read
            return
        with store.open_input_file(name) as f:
            f.seek(first % per_shard * length * 2)
            for _ in range(first, end):
                got = f.read(length * 2)
                if len(got) < length * 2:
                    return
                yield np.frombuffer(got, "<u2")
        first = end


def op5_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/terrane-order-{uuid.uuid4().hex}"
    return materialise(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"))
