"""Token counts by a two-tier look-up on the map side.

Tier one is a compact table of the token counts of frequent units, found over the
whole corpus by mergeable heavy-hitter summaries and broadcast. Tier two is each
worker's own bounded cache, which encodes what tier one misses. No unit is ever
shuffled: a task sends one summary of at most `frequent` entries, and summaries
merge in a tree of bounded fan-in.
"""

from __future__ import annotations

from array import array
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import LONGEST_CACHED, ByteLevel, slices, spaced_units, tokenizer
from arkose.shipping import shipped

FAN_IN = 64
_SUMMARY = "grp long, units array<string>, counts array<long>"


def _pruned(counts: Counter, k: int) -> Counter:
    """The Misra-Gries reduction: a unit in over 1/(k+1) of all places stays."""
    if len(counts) <= k:
        return counts
    cut = counts.most_common(k + 1)[-1][1]
    return Counter({u: n - cut for u, n in counts.items() if n > cut})


@shipped
def frequent_units(df: DataFrame, text_col: str = "text", k: int = 8192) -> list[str]:
    """At most k units of at most 64 characters, among them each that makes up over
    1/(k+1) of all units of the corpus. Null texts count as empty."""

    def summaries(batches):
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                counts.update(spaced_units(text or ""))
                if len(counts) > 32 * k:
                    counts = _pruned(counts, k)
        top = [(u, n) for u, n in _pruned(counts, k).items() if len(u) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([[u for u, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["grp", "units", "counts"])

    def merged(frames):
        counts: Counter = Counter()
        for frame in frames:
            for units, numbers in zip(frame["units"], frame["counts"]):
                counts.update(dict(zip(units, map(int, numbers))))
                counts = _pruned(counts, 4 * k)
        counts = _pruned(counts, k)
        return pd.DataFrame({"units": [list(counts)], "counts": [list(counts.values())]})

    texts = df.select(text_col)
    n = max(1, texts.rdd.getNumPartitions())
    rows = texts.mapInArrow(summaries, _SUMMARY)
    while True:
        rows = rows.withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        rows = rows.groupBy("grp").applyInPandas(lambda key, pdf: merged([pdf]).assign(grp=key[0])[["grp", "units", "counts"]], _SUMMARY)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    found = rows.collect()
    return sorted({u for r in found for u in r["units"]})


@shipped
def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 8192) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, as the library at `path` gives them
    without added special tokens.

    A null text counts as empty: 0 bytes, 0 tokens. A null id is kept. Repeated rows
    each give a row. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    tok = tokenizer(path)
    units = frequent_units(df, text_col, frequent)
    lengths = array("H", [len(e.ids) for e in tok.encode_batch([" " + u for u in units], add_special_tokens=False)])
    tier_one = df.sparkSession.sparkContext.broadcast((units, lengths.tobytes()))

    def count(batches):
        keys, raw = tier_one.value
        values = ByteLevel(path, len, dict(zip(keys, array("H", raw)))).values
        for batch in slices(batches):
            n_bytes, n_tokens = array("q"), array("q")
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(sum(values(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
