"""Telephony audio columns: G.711 and ADPCM in WAVE files, decoded to resampled PCM.

mu-law and A-law samples expand by 256-entry tables built from the coding rule. ADPCM
(4 bits a sample, IMA tables) is decoded step by step, each step for all blocks of all
files of a batch at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.llm.common import slices, typed
from arkose.shipping import shipped

# WAVE format tags; the IMA ADPCM step sizes follow from the rule below.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17, "pcm": 1}
CODECS = ("mulaw", "alaw", "adpcm")
RATE, OUT_RATE = 8000, 16000
#: Bytes of an ADPCM block: a 4-byte head with the first sample, then 2 samples a byte.
BLOCK = 192
# The change of the step index for each 3-bit magnitude, the 89 steps.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    value = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    value = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """ADPCM blocks (n x bytes) to samples (n x samples), all blocks at each step.

    The head: first sample (signed, little-endian), step index (over 88 reads as 88),
    one unused byte. Then low half bytes first.
    """
    n, size = blocks.shape
    codes = np.empty((2 * (size - 4), n), np.uint8)  # step-major: each step reads one row
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    magnitude = np.arange(89 * 16)
    step, code = STEPS[magnitude >> 4], magnitude & 15
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change).astype(np.int32)  # by (index, code)
    following = np.clip((magnitude >> 4) + INDEX_MOVE[code], 0, 88).astype(np.int32)
    for t in range(len(codes)):
        at = (index << 4) | codes[t]
        value = np.clip(value + change[at], -32768, 32767)
        index = following[at]
        out[t + 1] = value
    return out.T


def encode_blocks(samples: np.ndarray, size: int = BLOCK) -> bytes:
    """PCM to ADPCM blocks; the last block is filled with its last sample."""
    per = 2 * (size - 4) + 1
    samples = np.asarray(samples, np.int32)
    n = max(1, -(-len(samples) // per))
    x = np.pad(samples, (0, n * per - len(samples)), mode="edge" if len(samples) else "constant").reshape(n, per)
    blocks = np.zeros((n, size), np.uint8)
    blocks[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    index, value = np.zeros(n, np.int32), x[:, 0].copy()
    for t in range(per - 1):
        step, gap = STEPS[index], x[:, t + 1] - value
        rest, code, change = np.abs(gap), np.where(gap < 0, 8, 0), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            code, rest, change = code | np.where(take, bit, 0), rest - np.where(take, part, 0), change + np.where(take, part, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[code], 0, 88)
        blocks[:, 4 + t // 2] |= (code << 4 * (t % 2)).astype(np.uint8)
    return blocks.tobytes()


def wave(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file around coded samples."""
    tag, bits, align, extra = TAGS[codec], 8, 1, b""
    if codec == "adpcm":
        bits, align = 4, BLOCK
        extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1)
    elif codec == "pcm":
        bits, align = 16, 2
    byte_rate = rate * align // (2 * (BLOCK - 4) + 1) if codec == "adpcm" else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, byte_rate, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, bytes of a block, coded samples) of a mono WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if form is None or form[1] != 1 or form[0] not in TAGS.values():
                raise ValueError("not a mono file of a known coding")
            return next(c for c, t in TAGS.items() if t == form[0]), form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def decode(media: list[bytes]) -> list[np.ndarray]:
    """16-bit samples of each file; the ADPCM blocks of all files are decoded together."""
    out: list = [None] * len(media)
    waiting: dict[int, list] = {}
    for i, m in enumerate(media):
        codec, _, align, data = read_wave(m)
        raw = np.frombuffer(data, np.uint8)
        if codec == "adpcm":
            waiting.setdefault(align, []).append((i, raw.reshape(-1, align)))
        else:
            out[i] = MULAW[raw] if codec == "mulaw" else ALAW[raw] if codec == "alaw" else raw.view("<i2")
    for parts in waiting.values():
        pcm, at = decode_blocks(np.concatenate([p for _, p in parts])), 0
        for i, p in parts:
            out[i] = pcm[at : at + len(p)].ravel()
            at += len(p)
    return out


def resampled(pcm: np.ndarray, rate: int = RATE, out_rate: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation on the exact ratio of the rates, rounded half up; the number
    of samples is floor(n * out_rate / rate), the last sample holds on."""
    n = len(pcm) * out_rate // rate
    if not n:
        return np.empty(0, np.int16)
    x = pcm.astype(np.int32)
    if out_rate == 2 * rate:
        out = np.empty(n, np.int16)
        out[0::2], out[1:-1:2], out[-1] = x, (x[:-1] + x[1:] + 1) >> 1, x[-1]
        return out
    at = np.arange(n, dtype=np.int64) * rate
    low, part = at // out_rate, at % out_rate
    high = np.minimum(low + 1, len(x) - 1)
    return ((x[low] * (out_rate - part) + x[high] * part + out_rate // 2) // out_rate).astype(np.int16)


def payload_of(text: str | None) -> bytes:
    """A text as UTF-8, filled with spaces to a positive multiple of the block."""
    data = (text or "").encode()
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


@shipped
def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """Per row: id, n_bytes, media: the payload, unchanged, as the coded samples of a
    WAVE file. Without a given `codec` the payload's CRC-32 chooses among the three.

    A null text counts as empty (one block of spaces); a null id is kept; equal texts
    give equal files; an empty table gives no row; other columns are ignored.
    """
    if codec is not None and codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")

    def run(batches):
        for batch in slices(batches):
            n, media = [], []
            for text in batch.column(1).to_pylist():
                data = payload_of(text)
                n.append(len((text or "").encode()))
                media.append(wave(codec or CODECS[zlib.crc32(data) % 3], data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, typed(source, "id", "n_bytes long, media binary")).withColumnRenamed("id", id_col)


def features(codec: str, pcm: np.ndarray, out: np.ndarray) -> str:
    """Of the decoded sound: coding, samples, peak, rounded mean square, sign changes,
    and the CRC-32 of the resampled PCM."""
    x = pcm.astype(np.int64)
    power = int((x * x).sum()) // max(1, len(x))
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec} n={len(x)} peak={int(np.abs(x).max(initial=0))} power={power} changes={changes} pcm16k={zlib.crc32(out.astype('<i2').tobytes()):08x}"


@shipped
def analysed(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple = ("n_bytes",), with_pcm: bool = False, out_rate: int = OUT_RATE) -> DataFrame:
    """Per row, from the stored bytes: id, the columns of `keep`, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with `with_pcm`
    the column pcm: the decoded sound, resampled, as a WAVE file of 16-bit PCM at
    `out_rate`. Writing the result stores it.

    A null medium gives null in every column made from it; a null id is kept; repeated
    rows each give a row; an empty table gives no row; a medium of any length is decoded
    whole. Columns that are not named in `keep` are left out, whatever their names.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), *keep)

    def run(batches):
        for batch in slices(batches):
            media = batch.column(1).to_pylist()
            there = [i for i, m in enumerate(media) if m is not None]
            found: list = [(None,) * (len(names) - 1 - len(keep))] * len(media)
            parsed = [read_wave(media[i]) for i in there]
            for i, (codec, rate, _, data), pcm in zip(there, parsed, decode([media[i] for i in there])):
                out = resampled(pcm, rate, out_rate)
                row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), features(codec, pcm, out))
                found[i] = row + ((wave("pcm", out.astype("<i2").tobytes(), out_rate),) if with_pcm else ())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds[: len(names) - 1 - len(keep)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], *made], names=names)

    kept = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"id {source.schema['id'].dataType.simpleString()}{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * with_pcm
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
