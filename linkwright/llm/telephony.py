"""Telephony audio columns: G.711 and block ADPCM samples, kept losslessly and resampled to PCM."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["mu_law_table", "a_law_table", "decode_adpcm", "resample", "write_media", "read_media", "store_telephony", "telephony_digest"]

#: Bytes of an ADPCM block; payloads are padded to a multiple of it.
BLOCK = 192
RATE = 8000

# Fixed values of the WAVE container.
FORMAT_CODES = {"alaw": 6, "mulaw": 7, "adpcm": 17}

# Fixed values of IMA ADPCM.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
LAST_INDEX = len(STEPS) - 1


@functools.cache
def mu_law_table() -> np.ndarray:
    """PCM16 of each mu-law code: complemented sign, 3-bit segment, 4-bit step; bias 132."""
    code = ~np.arange(256) & 0xFF
    segment, step = code >> 4 & 7, code & 15
    magnitude = ((step << 3) + 132 << segment) - 132
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


@functools.cache
def a_law_table() -> np.ndarray:
    """PCM16 of each A-law code: even bits inverted, sign 1 is positive, segment 0 is linear."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, code & 15
    magnitude = np.where(segment == 0, (step << 4) + 8, (step << 4) + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM16 ``(blocks, 2 * (bytes - 4) + 1)`` of mono ADPCM ``blocks`` (uint8, one block a row).

    A block is its first sample (int16), step index, a reserved byte, then two nibbles a
    byte, low first. All blocks advance together, one nibble at a time; an index beyond the
    table counts as the last one, so that any bytes decode.
    """
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n = len(blocks)
    body = blocks[:, 4:]
    nibbles = np.empty((body.shape[1] * 2, n), np.int64)
    nibbles[0::2] = (body & 15).T
    nibbles[1::2] = (body >> 4).T
    steps, moves = np.array(STEPS, np.int64), np.array(INDEX_STEPS * 2)
    out = np.empty((len(nibbles) + 1, n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), LAST_INDEX)
    out[0] = value
    for i, code in enumerate(nibbles):
        step = steps[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + moves[code], 0, LAST_INDEX)
        out[i + 1] = value
    return out.T


#: Blocks advanced together, and samples resampled at once, whatever the length of a file.
LANES, SAMPLES = 1 << 13, 1 << 20


@functools.cache
def _taps(factor: int, half: int = 8) -> np.ndarray:
    t = np.arange(-half * factor, half * factor + 1) / factor
    return np.sinc(t) * np.hanning(len(t) + 2)[1:-1]


def resample(pcm: np.ndarray, factor: int = 2) -> np.ndarray:
    """PCM16 at ``factor`` times the rate: windowed-sinc interpolation, silence beyond both ends."""
    out = np.empty(len(pcm) * factor, np.int16)
    taps = _taps(factor)
    half = len(taps) // 2
    reach = half // factor
    for a in range(0, len(pcm), SAMPLES):
        first, b = max(0, a - reach), min(len(pcm), a + SAMPLES)
        part = pcm[first : b + reach]
        up = np.zeros(len(part) * factor)
        up[::factor] = part
        start = half + (a - first) * factor
        out[a * factor : b * factor] = np.clip(np.rint(np.convolve(up, taps)[start : start + (b - a) * factor]), -32768, 32767)
    return out


def pad_payload(text: str | None) -> bytes:
    """UTF-8 bytes of the text (null: empty), blanks appended up to a positive multiple of the block."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def write_media(payload: bytes, codec: str, n_bytes: int) -> bytes:
    """A WAVE file with ``payload`` as its coded samples; ``fact`` holds their number, a chunk ``nbyt`` the unpadded length.

    What does not fit the 32 bits of a size is written modulo 2^32: such a file is for ``read_media`` alone.
    """
    align = BLOCK if codec == "adpcm" else 1
    per_block = (BLOCK - 4) * 2 + 1
    bits, extra = (4, struct.pack("<HH", 2, per_block)) if codec == "adpcm" else (8, struct.pack("<H", 0))
    rate = RATE * BLOCK // per_block if codec == "adpcm" else RATE
    fmt = struct.pack("<HHIIHH", FORMAT_CODES[codec], 1, RATE, rate, align, bits) + extra
    samples = len(payload) // BLOCK * per_block if codec == "adpcm" else len(payload)
    parts = ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples & 0xFFFFFFFF)), (b"nbyt", struct.pack("<Q", n_bytes)), (b"data", payload))
    pad = lambda body: b"\0" * (len(body) % 2)  # noqa: E731  (chunks start at even places)
    chunks = b"".join(tag + struct.pack("<I", len(body) & 0xFFFFFFFF) + body + pad(body) for tag, body in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) & 0xFFFFFFFF) + b"WAVE" + chunks


def read_media(media: bytes) -> tuple[str, int, bytes]:
    """``(codec, unpadded length, payload)`` of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size] if media[at : at + 4] != b"data" else media[at + 8 :]
        at += 8 + size + size % 2
    (code,) = struct.unpack_from("<H", found[b"fmt "])
    codec = next(name for name, c in FORMAT_CODES.items() if c == code)
    n_bytes = struct.unpack("<Q", found[b"nbyt"])[0]
    return codec, n_bytes, found[b"data"]


def decode(codec: str, payload: bytes) -> np.ndarray:
    """PCM16 at the stored rate."""
    codes = np.frombuffer(payload, np.uint8)
    if codec == "adpcm":
        return decode_adpcm(codes.reshape(-1, BLOCK)).reshape(-1)
    return (mu_law_table() if codec == "mulaw" else a_law_table())[codes]


def _decode_all(coded: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """As ``decode``, with the ADPCM blocks of all files advanced together."""
    out: list = [None if c == "adpcm" else decode(c, p) for c, p in coded]
    mine = [i for i, (c, _) in enumerate(coded) if c == "adpcm"]
    if mine:
        blocks = np.frombuffer(b"".join(coded[i][1] for i in mine), np.uint8).reshape(-1, BLOCK)
        pcm = np.concatenate([decode_adpcm(blocks[a : a + LANES]) for a in range(0, len(blocks), LANES)])
        at = 0
        for i in mine:
            n = len(coded[i][1]) // BLOCK
            out[i] = pcm[at : at + n].reshape(-1)
            at += n
    return out


def _slices(items: list, most: int = 1 << 22):
    """Runs of files of a few MB, so that a batch of long ones is not decoded at once."""
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def store_media(text: str | None, codec: str | None = None) -> bytes:
    names = sorted(FORMAT_CODES)
    payload = pad_payload(text)
    kind = codec or names[zlib.crc32(payload) % len(names)]
    return write_media(payload, kind, len(text.encode("utf-8", "surrogatepass")) if text else 0)


def store_telephony(text: Column, codec: str | None = None) -> Column:
    """The stored file (binary). ``codec`` mulaw, alaw or adpcm; by default the payload's crc32 picks one."""

    @F.pandas_udf("binary")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([store_media(t, codec) for t in texts], dtype=object)

    return udf(text)


def resampled_pcm(media: Column, factor: int = 2) -> Column:
    """Little-endian PCM16 at ``factor`` times 8 kHz (binary) of stored files; null stays null."""

    @F.pandas_udf("binary")
    def udf(files: pd.Series) -> pd.Series:
        out = []
        items = [f if f is not None else b"" for f in files]
        for a, b in _slices(items):
            some = [i for i in range(a, b) if items[i]]
            decoded = dict(zip(some, _decode_all([read_media(items[i])[::2] for i in some]), strict=True))
            out += [resample(decoded[i], factor).astype("<i2").tobytes() if i in decoded else None for i in range(a, b)]
        return pd.Series(out, dtype=object)

    return udf(media)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm_bytes long, pcm_crc32 long, feature string, pcm binary"


def _square_sum(pcm: np.ndarray) -> float:
    return sum(float(np.square(pcm[a : a + SAMPLES].astype(np.float64)).sum()) for a in range(0, len(pcm), SAMPLES))


def telephony_digest(media: Column, factor: int = 2) -> Column:
    """A struct of what reading the stored file back gives: lengths, digests, features of the PCM, and the resampled PCM.

    ``feature``: codec, seconds, root mean square, peak, zero crossings of the 8 kHz signal.
    """

    @F.pandas_udf(DIGEST)
    def udf(files: pd.Series) -> pd.DataFrame:
        rows = [r for a, b in _slices(list(files)) for r in digest_rows(list(files.iloc[a:b]), factor)]
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in DIGEST.split(", ")])

    return udf(media)


def digest_rows(files: list[bytes], factor: int = 2) -> list[tuple]:
    """The values of ``DIGEST`` of each stored file."""
    rows = []
    read = [read_media(x) for x in files]
    for x, (codec, n_bytes, payload), pcm in zip(files, read, _decode_all([r[::2] for r in read]), strict=True):
        stored = resample(pcm, factor).astype("<i2").tobytes()
        crossings = int(np.count_nonzero(np.diff(np.signbit(pcm))))
        feature = f"{codec};s={len(pcm) / RATE:.4f};rms={np.sqrt(_square_sum(pcm) / len(pcm)):.3f};peak={max(-int(pcm.min()), int(pcm.max()))};zc={crossings}"
        rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), codec, len(stored), zlib.crc32(stored), feature, stored))
    return rows


def telephony_documents(docs: DataFrame) -> DataFrame:
    """Each text stored as a telephony file and read back: ``doc_id`` and the digest's columns, one row a row.

    ``pcm`` is the resampled signal, stored. A null text is stored like the empty one: one block
    of blanks. Equal texts give equal values. Rows are handed on a few MB of text at a time.
    """
    names = ["doc_id", *[f.split(" ")[0] for f in DIGEST.split(", ")]]

    def run(batches):
        for pdf in batches:
            for a, b in _slices([t or "" for t in pdf["text"]], 1 << 20):
                digests = digest_rows([store_media(t) for t in pdf["text"].iloc[a:b]])
                yield pd.DataFrame([(i, *row) for i, row in zip(pdf["doc_id"].iloc[a:b], digests, strict=True)], columns=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {DIGEST}")
