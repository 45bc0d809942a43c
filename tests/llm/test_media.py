import hashlib
import zlib

import numpy as np
import pytest

from arkose.llm import common, media


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_tables_have_the_known_corners():
    assert media.MULAW[[0x00, 0x80, 0xFF, 0x7F, 0xF0]].tolist() == [-32124, 32124, 0, 0, 120]
    assert media.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(media.ALAW.tolist())) == 256 and len(set(media.MULAW.tolist())) == 255
    assert len(media.STEPS) == 89


def test_adpcm_blocks_equal_one_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (7, media.BLOCK)).astype(np.uint8)
    assert media.decode_blocks(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]


def test_adpcm_round_trip_is_close():
    t = np.arange(3000)
    pcm = (8000 * np.sin(t / 20)).astype(np.int16)
    back = media.decode([media.wave("adpcm", media.encode_blocks(pcm))])[0][: len(pcm)]
    assert np.abs(back.astype(int) - pcm)[50:].mean() < 200


def test_resampling():
    assert media.resampled(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    x = np.arange(-50, 50, dtype=np.int16)
    assert media.resampled(x, 8000, 8000).tolist() == x.tolist()
    assert len(media.resampled(x, 8000, 11025)) == 100 * 11025 // 8000
    assert media.resampled(x[:0]).tolist() == []


@pytest.mark.parametrize("codec", [None, *media.CODECS])
def test_payloads_come_back(spark, codec):
    texts = [None, "", "é" * 100, "x" * 192, "x" * 193, "long text " * 5000, "same", "same"]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1, b"") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media binary")
    stored = media.store(df, codec=codec)
    rows = media.analysed(stored, with_pcm=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[2 if r.doc_id is None else r.doc_id] or ""
        raw = text.encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data)) and len(data) % 192 == 0 < len(data)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        used, _, _, pcm = media.read_wave(bytes(r.pcm))
        assert used == "pcm" and r.feature.endswith(f"{zlib.crc32(pcm):08x}")
    same = [r for r in rows if r.doc_id in (6, 7)]
    assert same[0][1:] == same[1][1:]
    assert media.analysed(media.store(df.limit(0))).collect() == []


def test_foreign_bytes_are_refused(spark):
    with pytest.raises(ValueError):
        media.read_wave(b"RIFFxxxxAVI ")
    with pytest.raises(ValueError):
        media.store(spark.range(1), codec="mp3")


def plain_samples(codec, data):
    """Of coded samples, one at a time, by the rules of the codings."""
    if codec == "adpcm":
        return [x for at in range(0, len(data), media.BLOCK) for x in plain_adpcm(data[at : at + media.BLOCK])]
    out = []
    for b in data:
        if codec == "mulaw":
            b ^= 255
            x = (((b & 15) * 8 + 132) << (b >> 4 & 7)) - 132
            out.append(-x if b & 128 else x)
        else:
            b ^= 0x55
            e, m = b >> 4 & 7, b & 15
            x = 16 * m + 8 if e == 0 else (16 * m + 264) << (e - 1)
            out.append(x if b & 128 else -x)
    return out


def test_query_stores_the_media_and_the_resampled_pcm(spark, monkeypatch):
    from arkose.llm import queries

    sf, written, settled = "/root/testdata/sf0.001", [], common.settled
    monkeypatch.setattr(common, "settled", lambda df, *a: written.append(settled(df, *a)) or written[-1])
    got = {r.doc_id: r for r in queries.op3_telephony(spark, sf).collect()}
    files = {r.doc_id: bytes(r.media) for r in written[0].collect()}
    docs = common.table(spark, sf, "documents").collect()
    assert len(got) == len(docs) == len(files)
    for d in docs:
        raw = (d.text or "").encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        codec = media.CODECS[zlib.crc32(data) % 3]
        r, file = got[d.doc_id], files[d.doc_id]
        assert file == media.wave(codec, data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        x = plain_samples(codec, data)
        between = [(a + b + 1) >> 1 for a, b in zip(x, x[1:] + x[-1:])]
        pcm = np.array([v for pair in zip(x, between) for v in pair], "<i2").tobytes()
        assert media.read_wave(bytes(r.pcm)) == ("pcm", 16000, 2, pcm)
        power, changes = sum(v * v for v in x) // len(x), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"{codec} n={len(x)} peak={max(map(abs, x))} power={power} changes={changes} pcm16k={zlib.crc32(pcm):08x}"


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * common.BYTES, None, "a", "y" * common.BYTES, "b"])], names=["id", "text"])
    parts = [b.column(0).to_pylist() for b in common.slices([batch])]
    assert parts == [[0, 1], [2], [3], [4]]
    many = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(["t"] * 1300)], names=["id", "text"])
    assert [b.num_rows for b in common.slices([many])] == [512, 512, 276]
