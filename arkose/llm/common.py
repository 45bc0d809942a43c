"""Helpers shared by the training-data operators: tables, shared storage, tokenizers."""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from arkose.operators.filters import parted  # noqa: F401  (for the operators)
from arkose.storage import forget, fresh, settled, shared_dir  # noqa: F401

#: White space as the tokenizers' regex engine sees it (fixed values).
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # as in a character class
_GLUED = re.compile(f"[{WS}] (?:[{WS}]|\\Z)")
_UNIT = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Units longer than this are encoded each time rather than cached.
LONGEST_CACHED = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, column: str, rest: str) -> T.StructType:
    """A schema of a column of `df`, whatever its type, and the columns of a DDL string."""
    return T.StructType([T.StructField(column, df.schema[column].dataType), *T.StructType.fromDDL(rest)])


def mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow on columns of any name: `run` gets and gives them as c0, c1, ..., and
    `schema` has the names of the result."""
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, inner).toDF(*schema.names)


#: Rows, and bytes of their texts, that a worker turns into Python objects at once.
ROWS, BYTES = 512, 4 << 20


def give_back() -> None:
    """Gives memory that the worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Spark hands workers at most about BYTES bytes of columns at once, from now on in this
    session. Else it is 10,000 rows (64 MB at most): whole files, of which the executor holds
    two copies while a batch grows, and the worker the batch before and the present one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BYTES}b")


def slices(batches, column: int = 1, rows: int = ROWS, most: int = BYTES):
    """The batches cut to at most `rows` rows and about `most` bytes of a string or binary
    column (one row at least), which bounds what a worker holds. At the end the worker
    gives back memory that it no longer uses, for the tasks that run in it later."""
    try:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))
                b = min(max(b, a + 1), a + rows)
                yield batch.slice(a, b - a)
                a = b
    finally:
        give_back()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


class UnitCache(dict):
    """Values by key, computed at the first look-up, in bounded memory.

    `pinned` entries stay. Of the others, the ones used since the last turn-over
    survive one: a full generation becomes the old one, from which hits move back.
    """

    def __init__(self, compute, pinned=None, limit=100_000):
        super().__init__(pinned or {})
        self._compute, self._pinned, self._limit, self._old = compute, pinned or {}, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
            if len(key) > LONGEST_CACHED:
                return value
        if len(self) >= self._limit + len(self._pinned):
            self._old = dict(self)
            self.clear()
            self.update(self._pinned)
        self[key] = value
        return value


def spaced_units(text: str) -> list[str]:
    """The units of a text that follow a space, without it: a byte-level pre-tokenizer
    always splits before such a space."""
    if _GLUED.search(text) is None:
        return text.split(" ")[1:]
    return [u[1:] for u in _UNIT.findall(text) if u[0] == " "]


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
_SPACE_CHAR = _BYTE_CHARS[32]
#: The alphabet as UTF-16 by byte; a line end, between names, stays.
_BYTE_LEVEL = np.array([ord(_BYTE_CHARS.get(b, chr(b))) if b != 10 else b for b in range(256)], "<u2")
#: Letters for which all versions of Unicode agree, and ASCII marks (fixed values).
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "!-/:-@\\[-`{-~"
_PLAIN = re.compile(f"([{_LETTERS}]*)([{_MARKS}]*)(?:\n([{_LETTERS}]*)([{_MARKS}]*))?")
_ALL_LETTERS, _ALL_MARKS = ("".join(re.findall(f"[{c}]", "".join(map(chr, range(0x250))))) for c in (_LETTERS, _MARKS))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes()


class _Values:
    """value(ids) by text, for values that add up as their texts do (len, packed).

    Units of letters, then marks, are put together from their pre-tokens, each of which
    the tokenizer's model encodes once; other units go through the whole tokenizer.
    """

    def __init__(self, path: str, value):
        self._tok, self._value = tokenizer(path), value
        self._pre = UnitCache(self._model)
        self._zero = value([])

    def _model(self, pre: str):
        text = pre.encode().decode("latin-1").translate(_BYTE_CHARS)
        return self._value([t.id for t in self._tok.model.tokenize(text)])

    def whole(self, text: str):
        """Of any text, by the tokenizer itself."""
        return self._value(self._tok.encode(text, add_special_tokens=False).ids)


class ByteLevel(_Values):
    """Of whole texts, for byte-level BPE with the usual pre-tokenizer; special strings
    inside texts are read as the library reads them. `pinned` holds known values of
    units with a space before them."""

    def __init__(self, path: str, value, pinned=None):
        super().__init__(path, value)
        self._special = special_strings(path)
        self._spaced = UnitCache(self._unit, pinned, limit=400_000)
        self._bare = UnitCache(self.whole, limit=50_000)

    def _unit(self, unit: str):
        if unit.isalpha() and unit.isascii():
            return self._value([t.id for t in self._tok.model.tokenize(_SPACE_CHAR + unit)])
        m = _PLAIN.fullmatch(unit)
        if m is None:
            return self.whole(" " + unit)
        word, marks, word2, marks2 = m.groups()
        pre = self._pre
        if word:
            if word == unit:
                return self._model(" " + word)
            value = self._spaced[word]
            if marks:
                value = value + pre[marks]
        elif marks:
            value = pre[" " + marks]
        else:
            return self.whole(" " + unit)
        if word2 is not None:
            value = value + pre["\n"]
            if word2:
                value = value + pre[word2]
            if marks2:
                value = value + pre[marks2]
        return value

    def values(self, text: str) -> list:
        """Values that add up to the text's, in its order."""
        if any(s in text for s in self._special):
            return [self.whole(text)]
        if _GLUED.search(text) is None:
            parts = text.split(" ")
            return [self._bare[parts[0]], *map(self._spaced.__getitem__, parts[1:])]
        return [self._spaced[u[1:]] if u[0] == " " else self._bare[u] for u in _UNIT.findall(text)]


def strung(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches at[i]:at[i + 1] of `flat`, i as in `which`, end to end, and where each
    begins (at last, where all end)."""
    n = (at[1:] - at[:-1])[which]
    begin = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(at[which] - begin[:-1], n) + np.arange(begin[-1])], begin


class WordLevel(_Values):
    """The same for the word-end BPE, which lower-cases and drops white space: no
    token spans a space or line end, so the texts between them are independent. `value`
    is `packed`. Each distinct unit of a column of texts is looked at once. Ids of pieces
    are kept for the columns after it: `limit` of them, or the present column's if more."""

    def __init__(self, path: str, value, limit: int = 120_000):
        super().__init__(path, value)
        self._known, self._limit = {"": self._zero}, limit

    def _pieces(self, pieces: pa.Array) -> list:
        """Of distinct runs of letters or of marks, each a pre-token."""
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "\n")[0].as_buffer()
        names = _BYTE_LEVEL[np.frombuffer(line, np.uint8)].tobytes().decode("utf-16-le").split("\n")
        known, tokenize, value = self._known, self._tok.model.tokenize, self._value
        new = [p for p in names if p not in known]
        known.update((p, value([t.id for t in tokenize(p)])) for p in new)
        values = [known[p] for p in names]
        for p in new:
            if len(p) > LONGEST_CACHED:
                del known[p]
        if len(known) > self._limit:
            self._known = {p: v for p, v in zip(names, values) if len(p) <= LONGEST_CACHED}
        return values

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), end to end, and where each text's begin (at
        last, where all end)."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary
        words, marks = pc.utf8_rtrim(units, characters=_ALL_MARKS), pc.utf8_ltrim(units, characters=_ALL_LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(words), pc.binary_length(marks)), pc.binary_length(units))
        pieces = pa.concat_arrays([pc.utf8_lower(pc.if_else(plain, words, "")), pc.if_else(plain, marks, "")]).dictionary_encode()
        two = pieces.indices.to_numpy().reshape(2, -1).T.astype(np.int64)  # the pieces of each unit
        values = self._pieces(pieces.dictionary)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))  # one piece, of the whole unit
        two[odd, 0] = len(values) + np.arange(len(odd))
        values += map(self.whole, units.take(pa.array(odd)).to_pylist())
        flat, at = strung(np.frombuffer(b"".join(values), "<u4"), np.cumsum([0, *map(len, values)]) // 4, two.ravel())
        flat, at = strung(flat, at[::2], coded.indices.to_numpy())
        return flat, at[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]

    def values(self, text: str) -> list:
        return [self.columns(pa.array([text]))[0].tobytes()]


assert array("I").itemsize == 4
