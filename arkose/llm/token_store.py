"""Token ids in shards of compressed planes, with a chunk index.

A shard holds whole documents in order. Its ids are cut into chunks of a fixed number
of ids; a chunk is transposed into planes (its 4 byte planes, or its 32 bit planes),
each compressed alone with zstandard. The header has the documents' ids and lengths
and, for each chunk and plane, where it lies, so a document can be read without
decompressing the other chunks.

Layout (little-endian): magic, 5 unsigned 64-bit numbers (documents, ids, ids a chunk,
planes a chunk, bytes of the compressed header), the header (document ids, null flags,
lengths, then start and size of each plane), and the planes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import ByteLevel, packed
from arkose.operators.ordered import before
from arkose.shipping import shipped

MAGIC = b"ARKBPLN1"
_HEAD = struct.Struct("<5Q")


def _planes(ids: np.ndarray, planes: int) -> np.ndarray:
    if planes == 4:
        return ids.view(np.uint8).reshape(-1, 4).T
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def _ids(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").ravel()
    bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def write_shard(doc_ids: list, docs: list[bytes], chunk_ids: int = 65536, planes: int = 4, level: int = 3) -> bytes:
    """The file of these documents (their ids as little-endian 32-bit numbers)."""
    if planes not in (4, 32):
        raise ValueError("planes is 4 (bytes) or 32 (bits)")
    all_ids = np.frombuffer(b"".join(docs), "<u4")
    zip_, starts, body, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for i in range(0, len(all_ids), chunk_ids):
        for plane in _planes(all_ids[i : i + chunk_ids], planes):
            packed = zip_.compress(np.ascontiguousarray(plane).tobytes())
            starts += [at, len(packed)]
            body.append(packed)
            at += len(packed)
    header = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([len(d) // 4 for d in docs], "<u8").tobytes(), np.array(starts, "<u8").tobytes()])
    header = zip_.compress(header)
    return b"".join([MAGIC, _HEAD.pack(len(docs), len(all_ids), chunk_ids, planes, len(header)), header, *body])


class Shard:
    """Reads a shard's bytes; `ids(a, b)` decompresses only the chunks it needs."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, self.n_ids, self.chunk_ids, self.planes, size = _HEAD.unpack_from(data, 8)
        at = 8 + _HEAD.size
        head = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        numbers, nulls = np.frombuffer(head, "<i8", n), np.frombuffer(head, np.uint8, n, 8 * n)
        self.doc_ids = [None if null else int(d) for d, null in zip(numbers, nulls)]
        self.lengths = np.frombuffer(head, "<u8", n, 9 * n).astype(np.int64)
        self._index = np.frombuffer(head, "<u8", -1, 17 * n).reshape(-1, self.planes, 2).astype(np.int64)
        self._body, self._data, self._kept = at + size, data, (-1, None)

    def _chunk(self, c: int) -> np.ndarray:
        if self._kept[0] != c:
            n = min(self.chunk_ids, self.n_ids - c * self.chunk_ids)
            unzip = zstandard.ZstdDecompressor()
            raw = [unzip.decompress(self._data[self._body + s : self._body + s + z]) for s, z in self._index[c].tolist()]
            self._kept = (c, _ids(raw, n))
        return self._kept[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, "<u4")
        k = self.chunk_ids
        return np.concatenate([self._chunk(c)[max(0, start - c * k) : stop - c * k] for c in range(start // k, -(-stop // k))])

    def documents(self):
        """(document id, start in the shard, ids) of each document in order."""
        at = 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            yield doc_id, at, self.ids(at, at + n)
            at += n


@shipped
def write_tokens(df: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1_000_000, chunk_ids: int = 65536, planes: int = 4) -> None:
    """Encodes every text, appends `end_id`, and writes shards in ascending id order
    to `out`: rows (part, seq, n_ids, payload), whose order is the ids' order.

    Null ids come first; equal ids are ordered by their text and each written. A null
    text counts as empty (its end id only); texts are encoded whole; an empty table gives
    files without rows; other columns are ignored. Spark's committer makes the write safe
    against lost executors; a shard is at most `shard_ids` ids and one document more.
    """

    def run(batches):
        from pyspark import TaskContext

        values, end, part = ByteLevel(path, packed).values, packed([end_id]), TaskContext.get().partitionId()
        keys, docs, pending, seq = [], [], 0, 0

        def flush():
            nonlocal keys, docs, pending, seq
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([pending], pa.int64()), pa.array([write_shard(keys, docs, chunk_ids, planes)], pa.binary())]
            keys, docs, pending, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "n_ids", "payload"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                docs.append(b"".join(values(text or "")) + end)
                pending += len(docs[-1]) // 4
                if pending >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text")
    rows.mapInArrow(run, "part int, seq int, n_ids long, payload binary").write.option("compression", "none").parquet(out)  # planes are compressed


@shipped
def read_tokens(spark, out: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and with `with_ids` its ids.

    Files of an empty table give no row; repeated documents, null ids and documents of
    any length come back as they were written. Starts are summed up over ranges of
    shards, so no task has all of them.
    """

    def decode(batches):
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, starts, lengths, sums, raw = [], [], [], [], []
                for doc_id, at, ids in Shard(payload).documents():
                    data = ids.tobytes()
                    keys.append(doc_id), starts.append(at), lengths.append(len(ids)), sums.append(zlib.crc32(data))
                    if with_ids:
                        raw.append(data)
                cols = [pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=names)

    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    shards = spark.read.schema("part int, seq int, n_ids long, payload binary").parquet(out)
    starts = before(shards.select("part", "seq", "n_ids"), [F.col("part"), F.col("seq")], {"base": F.col("n_ids")}).drop("n_ids")
    docs = shards.select("part", "seq", "payload").mapInArrow(decode, schema).join(starts, ["part", "seq"])
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
