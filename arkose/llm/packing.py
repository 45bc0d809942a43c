"""Packing token sequences, balanced by attention cost, without a shuffle.

Each task packs its own documents in blocks of about `block_tokens` tokens or of
`block_docs` documents, whichever is full first: whole sequences are cut off long
documents, then the rest, longest first, go each to the sequence of the lowest cost
(linear plus quadratic in the piece) that has room. A document that fits nowhere is cut.
The capacities of a block sum to its tokens: full sequences, then the remainder as powers
of two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import WordLevel, give_back, packed, slices, typed
from arkose.shipping import shipped

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Bytes of texts that a task turns into ids at once.
IN_BYTES = 1 << 20
#: Tokens, and pieces, that a task hands on at once.
OUT_TOKENS, OUT_PIECES = 1 << 18, 1 << 13


def cost(n):
    """Of a piece of n tokens: projections grow with n, attention with its square."""
    return LINEAR * n + QUADRATIC * n * n


def plan_block(lengths, seq_len: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these
    lengths, and the number of sequences. Ties keep the documents' order.

    Open sequences wait in a heap by cost, those without room for the present length in
    one by their room; lengths fall, so a sequence seldom changes over, and a block takes
    time by the logarithm of its sequences for each piece.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    n_seq, pool = 0, []
    for doc, n in enumerate(lengths):
        whole = n // seq_len
        for i in range(whole):
            pieces.append((doc, i * seq_len, seq_len, n_seq, 0))
            n_seq += 1
        if n % seq_len:
            pool.append((n % seq_len, doc, whole * seq_len))
    pool.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in pool)
    left = [seq_len] * (total // seq_len) + [1 << b for b in range(seq_len.bit_length(), -1, -1) if (total % seq_len) >> b & 1]
    caps, costs = list(left), [0.0] * len(left)
    waiting = [(-room, s) for s, room in enumerate(left)]  # the roomiest first
    heapq.heapify(waiting)
    open_: list[tuple[float, int]] = []

    def place(s: int, doc: int, start: int, n: int) -> None:
        pieces.append((doc, start, n, n_seq + s, caps[s] - left[s]))
        left[s] -= n
        costs[s] += cost(n)
        if left[s]:
            heapq.heappush(waiting, (-left[s], s))

    for n, doc, start in pool:
        while n:
            while waiting and -waiting[0][0] >= n:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(open_, (costs[s], s))
            while open_ and left[open_[0][1]] < n:
                s = heapq.heappop(open_)[1]
                heapq.heappush(waiting, (-left[s], s))
            if open_:
                place(heapq.heappop(open_)[1], doc, start, n)
                break
            s = heapq.heappop(waiting)[1]  # fits nowhere whole: fill the roomiest
            part = left[s]
            place(s, doc, start, part)
            start, n = start + part, n - part
    return pieces, n_seq + len(caps)


def parts(pieces: list) -> Iterator[list]:
    """The pieces, in order, in lists of about OUT_TOKENS tokens or of OUT_PIECES."""
    a = held = 0
    for b, piece in enumerate(pieces, 1):
        held += piece[2]
        if held >= OUT_TOKENS or b - a >= OUT_PIECES or b == len(pieces):
            yield pieces[a:b]
            a, held = b, 0


@shipped
def pack(df: DataFrame, path: str, end_id: int = 2, seq_len: int = 4096, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4_000_000, block_docs: int = 262_144, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with `with_ids` the piece's ids (little-endian unsigned 32-bit).

    Each document is its ids and then `end_id`; a null text counts as empty (one id).
    `seq_len` is a power of two. Texts are packed whole, however long. A null id is kept;
    repeated rows are packed each. An empty table gives no piece. Other columns are
    ignored. A sequence is known by its
    task and number, so a task that runs again gives the same result.
    """

    def run(batches):
        from pyspark import TaskContext

        words, base = WordLevel(path, packed), TaskContext.get().partitionId() << 33
        end, keys, docs, pending, done = packed([end_id]), [], [], 0, 0

        def flush():
            nonlocal keys, docs, pending, done
            pieces, n_seq = plan_block([len(d) // 4 for d in docs], seq_len)
            for some in parts(pieces):  # the block's ids are not held a second time
                cut = [docs[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in some]
                cols = [
                    pa.array([keys[p[0]] for p in some], key_type),
                    pa.array([p[1] for p in some], pa.int64()),
                    pa.array([p[2] for p in some], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array([len(docs[p[0]]) // 4 for p in some], pa.int64()),
                    pa.array([base + done + p[3] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()),
                ] + ([pa.array(cut, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(cols, names=names)
            keys, docs, pending, done = [], [], 0, done + n_seq

        key_type = None
        for batch in slices(batches, rows=block_docs, most=IN_BYTES):
            key_type = batch.schema.field(0).type
            flat, at = words.columns(batch.column(1))
            for key, a, b in zip(batch.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                keys.append(key)
                docs.append(flat[a:b].tobytes() + end)
                pending += len(docs[-1]) // 4
                if pending >= block_tokens or len(docs) >= block_docs:
                    yield from flush()
        if docs:
            yield from flush()
        del words
        give_back()

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = typed(source, "id", "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    names = schema.names
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
