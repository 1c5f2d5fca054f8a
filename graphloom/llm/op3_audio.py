"""Telephony audio columns: companded and ADPCM recordings, decoded and resampled in numpy.

mu-law and A-law samples expand through tables of 256 entries, built from their rules. IMA ADPCM is decoded
for all blocks of a batch at once, one nibble of every block per step. Decoded 8 kHz sound is resampled to
16 kHz by a fixed half-band filter and can be stored as PCM. A recording is a RIFF/WAVE file whose data
chunk holds the code bytes as they came, so that storing is lossless.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table, text_or_empty

#: Fixed values of the container: format tags.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
RATE, TARGET_RATE = 8000, 16000
#: Bytes of payload in an ADPCM block, behind its header of four bytes; a block's first sample is in the header.
BLOCK_DATA, BLOCK_HEAD = 288, 4
UNIT = 576
#: Index adjustments of IMA ADPCM.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Step sizes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
#: Half of the symmetric filter that puts a sample between two others, over 32768.
HALF_BAND = np.array([20276, -5216, 1721, -397], np.float32) / 32768


def mulaw_table() -> np.ndarray:
    """Linear value of every mu-law code."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of every A-law code."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * BLOCK_DATA) of ADPCM blocks (blocks, BLOCK_HEAD + BLOCK_DATA), low nibble first."""
    by_step = np.ascontiguousarray(blocks.T)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(by_step[2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * BLOCK_DATA, len(blocks)), np.int16)
    out[0] = value
    for t in range(2 * BLOCK_DATA):
        nibble = by_step[BLOCK_HEAD + t // 2] >> (4 * (t % 2)) & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[nibble], 0, len(STEPS) - 1)
        out[t + 1] = value
    return out.T


def wave(tag: int, data: bytes, rate: int = RATE, samples: int | None = None) -> bytes:
    """A mono RIFF/WAVE file with the code bytes `data`."""
    if tag == PCM:
        align, bits, extra = 2, 16, b""
    elif tag == ADPCM:
        align, bits, extra = BLOCK_HEAD + BLOCK_DATA, 4, struct.pack("<HH", 2, 1 + 2 * BLOCK_DATA)
    else:
        align, bits, extra = 1, 8, b"\0\0"
    speed = rate * align // (1 + 2 * BLOCK_DATA) if tag == ADPCM else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    padded = data + b"\0" * (len(data) % 2)
    chunks += b"data" + struct.pack("<I", len(data)) + padded
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def chunks_of(media: bytes) -> tuple[int, int, memoryview]:
    """Format tag, sampling rate and data of a RIFF/WAVE file; ValueError if it isn't one."""
    view = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    tag = rate = data = None
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("a format chunk is cut off")
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif media[at : at + 4] == b"data":
            data = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if tag is None or data is None or len(data) == 0:
        raise ValueError("a chunk is missing")
    return tag, rate, data


def store(payload: bytes, tag: int) -> bytes:
    """The recording that holds `payload` (a multiple of BLOCK_DATA bytes) as its code bytes."""
    if tag != ADPCM:
        return wave(tag, payload)
    body = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
    blocks = np.zeros((len(body), BLOCK_HEAD + BLOCK_DATA), np.uint8)
    blocks[:, BLOCK_HEAD:] = body
    return wave(tag, blocks.tobytes(), samples=len(body) * (1 + 2 * BLOCK_DATA))


def payload_of(media: bytes) -> bytes:
    """The code bytes of a recording, without ADPCM headers."""
    tag, _, data = chunks_of(media)
    if tag != ADPCM:
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK_HEAD + BLOCK_DATA)[:, BLOCK_HEAD:].tobytes()


def decode(media: bytes) -> np.ndarray:
    """Linear 16-bit samples of a recording."""
    tag, _, data = chunks_of(media)
    codes = np.frombuffer(data, np.uint8)
    if tag == ADPCM:
        return decode_adpcm(codes[: len(codes) // (BLOCK_HEAD + BLOCK_DATA) * (BLOCK_HEAD + BLOCK_DATA)].reshape(-1, BLOCK_HEAD + BLOCK_DATA)).ravel()
    if tag in TABLES:
        return TABLES[tag][codes]
    if tag == PCM:
        return codes.view("<i2").astype(np.int16)
    raise ValueError(f"unknown format {tag}")


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the sampling rate: every sample, and between two of them the half-band interpolation; the ends
    are held."""
    n, reach = len(samples), len(HALF_BAND)
    x = np.pad(samples.astype(np.float32), (reach - 1, reach), mode="edge")
    between = np.zeros(n, np.float32)
    for k, weight in enumerate(HALF_BAND):
        between += weight * (x[reach - 1 - k : reach - 1 - k + n] + x[reach + k : reach + k + n])
    out = np.empty(2 * n, np.int16)
    out[0::2] = samples
    out[1::2] = np.clip(np.rint(between), -32768, 32767)
    return out


def channels_of(media: bytes) -> int:
    """Channels that the format chunk of a RIFF/WAVE file tells; 1 if it tells none."""
    at = 12
    while at + 12 <= len(media):
        if media[at : at + 4] == b"fmt ":
            return struct.unpack_from("<H", media, at + 10)[0] or 1
        size = struct.unpack_from("<I", media, at + 4)[0]
        at += 8 + size + size % 2
    return 1


def at_target_rate(media: bytes) -> np.ndarray:
    """Mono 16-bit samples of a recording at TARGET_RATE: channels are mixed to their mean, RATE is doubled and
    TARGET_RATE stays; ValueError for other rates, for ADPCM of several channels and for samples that are no whole frame."""
    tag, rate, _ = chunks_of(media)
    channels, samples = channels_of(media), decode(media)
    if rate not in (RATE, TARGET_RATE):
        raise ValueError(f"unknown sampling rate {rate}")
    if channels > 1:
        if tag == ADPCM:
            raise ValueError(f"ADPCM of {channels} channels")
        if len(samples) % channels:
            raise ValueError("a frame is cut off")
        samples = np.rint(samples.reshape(-1, channels).mean(axis=1)).astype(np.int16)
    return resample(samples) if rate == RATE else samples


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square and zero crossings of PCM."""
    energy = float(np.dot(pcm.astype(np.float64), pcm.astype(np.float64)))
    crossings = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    return f"n={len(pcm)};peak={int(np.abs(pcm.astype(np.int32)).max())};rms={(energy / len(pcm)) ** 0.5:.3f};zc={crossings}"


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """`df` with pcm (the column of 16 kHz PCM recordings, null where `media` is null or can't be read) and error (why
    it can't be). Columns of `df` with these names are replaced.

    An empty recording, one that is cut off, in another format, at another rate than 8 or 16 kHz or without a whole block
    can't be read, nor can ADPCM of several channels; other channels are mixed. Repeated
    rows get equal results; an empty table gives an empty result. A recording is decoded whole, one at a time."""
    kept = [f for f in df.schema if f.name not in ("pcm", "error")]
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{media}`").cast("binary").alias("media__"))
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "pcm binary, error string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pcm, error = [], []
            for m in b.column("media__"):
                try:
                    pcm.append(wave(PCM, at_target_rate(m.as_py()).astype("<i2").tobytes(), TARGET_RATE) if m.is_valid else None)
                    error.append(None)
                except (ValueError, struct.error) as e:
                    pcm.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pcm, pa.binary()), pa.array(error, pa.string())], [*(f.name for f in kept), "pcm", "error"])

    return rows.mapInArrow(work, kind)


def tag_of(payload: bytes) -> int:
    """The format a payload is stored in: its checksum picks one of the three, so equal texts share it."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def record_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec,
    pcm_sha256 for every row: a text becomes a recording, which is read back, decoded and resampled.

    A null or empty text is one unit of padding. Repeated rows and equal texts get equal values; texts of
    any length are one recording. An empty table gives an empty result; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "codec": pa.string(), "pcm_sha256": pa.string()}
    sql = {pa.int64(): "long", pa.string(): "string"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            media: list[bytes] = []
            for t in b.column("text"):
                raw = t.as_py().encode()
                payload = raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
                media.append(store(payload, tag_of(payload)))
                rows.append([len(raw)])
            sounds: list[np.ndarray | None] = [None] * len(media)
            blocks = [np.frombuffer(chunks_of(m)[2], np.uint8).reshape(-1, BLOCK_HEAD + BLOCK_DATA) if chunks_of(m)[0] == ADPCM else None for m in media]
            for some in grouped([i for i, x in enumerate(blocks) if x is not None], [0 if x is None else len(x) for x in blocks]):
                heard = decode_adpcm(np.concatenate([blocks[i] for i in some]))
                at = 0
                for i in some:
                    sounds[i] = np.ascontiguousarray(heard[at : at + len(blocks[i])]).ravel()
                    at += len(blocks[i])
                finish(media, rows, sounds, some)
            finish(media, rows, sounds, [i for i, x in enumerate(blocks) if x is None])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values()))], ["doc_id", *names])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{n} {sql[k]}" for n, k in names.items()))


def grouped(indices: list[int], sizes: list[int], most: int = 8192) -> Iterator[list[int]]:
    """Runs of indices whose sizes sum up to about `most` blocks, to decode together."""
    some, total = [], 0
    for i in indices:
        some.append(i)
        total += sizes[i]
        if total >= most:
            yield some
            some, total = [], 0
    if some:
        yield some


def finish(media: list[bytes], rows: list[list], sounds: list, some: list[int]) -> None:
    """Complete the rows of `some` recordings from what is read back of them; their sound is let go."""
    for i in some:
        m = media[i]
        payload = payload_of(m)
        pcm = resample(decode(m) if sounds[i] is None else sounds[i])
        sounds[i] = None
        codec = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}[chunks_of(m)[0]]
        rows[i] += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm), codec, hashlib.sha256(pcm.astype("<i2").tobytes()).hexdigest()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_documents(table(spark, sf_dir, "documents"))
