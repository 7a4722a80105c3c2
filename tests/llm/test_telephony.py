import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.llm import telephony as t
from tests.llm.conftest import ODD


def test_expansion_tables():
    mu, a = t.mu_law_table(), t.a_law_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0xAA], a[0x2A]) == (-8, 8, 32256, -32256)
    for table in (mu, a):
        assert sorted(-table[:128].astype(int)) == sorted(table[128:].astype(int))


def _one_block(block: bytes) -> list[int]:
    """ADPCM by the book, a sample at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = t.STEPS[index]
            change = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + t.INDEX_STEPS[code & 7]))
            out.append(value)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=12), min_size=1, max_size=5))
def test_adpcm_against_one_sample_at_a_time(blocks):
    got = t.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 12))
    assert got.tolist() == [_one_block(b) for b in blocks]


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=400), st.sampled_from(sorted(t.FORMAT_CODES)))
def test_round_trip(text, codec):
    payload = t.pad_payload(text)
    n = len(text.encode("utf-8", "surrogatepass"))
    assert t.read_media(t.write_media(payload, codec, n)) == (codec, n, payload)
    assert len(payload) % 192 == 0 and payload[:n] == text.encode("utf-8", "surrogatepass") and set(payload[n:]) <= {32}


def test_resample_keeps_samples_and_silence():
    x = (np.sin(np.arange(400) / 9) * 9000).astype(np.int16)
    y = t.resample(x, 2)
    assert len(y) == 800 and np.abs(y[::2].astype(int) - x).max() <= 1
    assert not t.resample(np.zeros(10, np.int16)).any() and len(t.resample(np.zeros(0))) == 0


def test_documents(make):
    df = make(ODD)
    got = {r["doc_id"]: r for r in t.telephony_documents(df).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        payload = t.pad_payload(text)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[6]["feature"] == got[7]["feature"]
    assert t.telephony_documents(df.limit(0)).count() == 0
    pcm = df.where("doc_id = 3").select(t.resampled_pcm(t.store_telephony(F.col("text"), "mulaw")).alias("p")).first()["p"]
    assert len(pcm) == 192 * 2 * 2


def test_long_files_in_pieces(monkeypatch):
    r = np.random.default_rng(3)
    x = r.integers(-32768, 32767, 5000).astype(np.int16)
    whole = t.resample(x, 2)
    coded = [(c, r.integers(0, 256, 192 * 50, dtype=np.uint8).tobytes()) for c in ("adpcm", "mulaw", "adpcm")]
    decoded = t._decode_all(coded)
    monkeypatch.setattr(t, "SAMPLES", 700)
    monkeypatch.setattr(t, "LANES", 7)
    assert np.array_equal(t.resample(x, 2), whole)
    assert all(np.array_equal(a, b) for a, b in zip(t._decode_all(coded), decoded, strict=True))


def test_wave_chunks():
    payload = t.pad_payload("abc" * 300)
    for codec, samples in (("mulaw", len(payload)), ("adpcm", len(payload) // 192 * 377)):
        media = t.write_media(payload, codec, 900)
        assert int.from_bytes(media[4:8], "little") == len(media) - 8
        at = media.index(b"fact")
        assert media[at + 4 : at + 8] == b"\4\0\0\0" and int.from_bytes(media[at + 8 : at + 12], "little") == samples


def test_stored_pcm_is_the_resampled_signal(make):
    row = t.telephony_documents(make(["some words to store"])).first()
    want = t.resample(t.decode(row["codec"], t.pad_payload("some words to store"))).astype("<i2").tobytes()
    assert row["pcm"] == want and row["pcm_bytes"] == len(want) and row["pcm_crc32"] == zlib.crc32(want)
