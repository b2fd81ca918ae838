"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, expanded and resampled.

Companded bytes expand by lookup tables; ADPCM blocks, of the size and the channels that
the header names, are decoded with numpy, step by step in time but across all blocks of
a batch at once; resampled PCM is stored as WAV in a Parquet table (`store_pcm`). The
query stores each text's bytes as a mu-law WAV in a Parquet table of the shared folder
and computes its digests and features from the bytes read back; that table stays there.

Defined cases: a null or empty text is one padding unit of 64 zero bytes; equal texts
give equal rows; media that isn't a whole WAV of a known codec decodes to null; a last
ADPCM block may be shorter; rows without doc_id are left out, repeated rows each give a
row; texts of any length are stored whole; an empty table gives no rows; other columns
are not read.
"""

import hashlib
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import common

UNIT = 64
RATE = 8000
MULAW, ALAW, PCM, ADPCM, EXTENSIBLE = 7, 6, 1, 17, 0xFFFE
# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    s = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -s, s).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 85
    e, m = a >> 4 & 7, (a & 15) << 4
    s = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(a & 128, s, -s).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


class NotWav(ValueError):
    """The bytes are not a whole WAV of a known codec."""


@dataclass(frozen=True)
class Wav:
    codec: int
    channels: int
    rate: int
    #: Bytes of an ADPCM block, or of one sample of all channels.
    block: int
    bits: int
    #: Samples a channel, where the file says so.
    samples: int | None
    data: bytes


def samples_of_block(block: int, channels: int = 1) -> int:
    """Samples a channel in an ADPCM block: one in the header, two a byte after it."""
    return 2 * (block - 4 * channels) // channels + 1


def write_wav(data: bytes, codec: int, rate: int = RATE, channels: int = 1, block: int = UNIT, samples: int | None = None) -> bytes:
    """A WAV around the bytes as they are; PCM has 16 bits, companded codes 8; block is for ADPCM alone."""
    bits, align = {PCM: (16, 2 * channels), ADPCM: (4, block)}.get(codec, (8, channels))
    per_block = samples_of_block(block, channels) if codec == ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", codec, channels, rate, rate * align // per_block, align, bits) + extra
    samples = len(data) // align * per_block if samples is None else samples
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> Wav:
    """The header's fields and the data bytes; NotWav if it isn't a whole WAV of a known codec."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise NotWav("no RIFF header")
    at, fmt, samples = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        chunk = media[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise NotWav("a chunk is cut off")
        if name == b"fmt ":
            if size < 16:
                raise NotWav("a short format chunk")
            fmt = list(struct.unpack_from("<HHIIHH", chunk))
            if fmt[0] == EXTENSIBLE and size >= 26:
                fmt[0] = int.from_bytes(chunk[24:26], "little")
        elif name == b"fact" and size >= 4:
            samples = int.from_bytes(chunk[:4], "little")
        elif name == b"data":
            if fmt is None:
                break
            codec, channels, rate, _, block, bits = fmt
            least = {PCM: channels * bits // 8, ADPCM: 4 * channels}.get(codec, channels)
            if codec not in (PCM, MULAW, ALAW, ADPCM) or not channels or not rate or block < max(1, least) or bits not in {PCM: (8, 16, 24, 32), ADPCM: (4,)}.get(codec, (8,)):
                raise NotWav("a format that isn't known")
            if codec == ADPCM and (block - 4 * channels) % (4 * channels if channels > 1 else 1):
                raise NotWav("a block that doesn't hold whole groups")
            return Wav(codec, channels, rate, block, bits, samples, chunk)
        at += 8 + size + size % 2
    raise NotWav("no data")


def _decode_mono(blocks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """PCM (n, samples) of headers (n, 4): predictor and index, and code bytes (n, bytes), low nibble first."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for t in range(2 * len(codes)):
        code = codes[t >> 1] >> 4 if t & 1 else codes[t >> 1] & 15
        value, index = _step(value, index, code)
        out[t + 1] = value
    return out.T


def _step(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next predictor and index after one code of each block."""
    step, small = STEPS[index], (code & 7).astype(np.int32)
    delta = (step >> 3) + (step >> 2) * (small & 1) + (step >> 1) * (small >> 1 & 1) + step * (small >> 2)
    value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
    return value, np.clip(index + INDEX_STEPS[small], 0, 88)


def decode_adpcm(blocks: np.ndarray, channels: int = 1) -> np.ndarray:
    """PCM (n, samples, channels) of blocks (n, size): a header a channel, then four bytes of each channel in turn."""
    n, size = blocks.shape
    if channels == 1:
        return _decode_mono(blocks, blocks[:, 4:])[:, :, None]
    codes = blocks[:, 4 * channels :].reshape(n, -1, channels, 4)
    return np.stack([_decode_mono(blocks[:, 4 * c : 4 * c + 4], codes[:, :, c].reshape(n, -1)) for c in range(channels)], axis=2)


def encode_adpcm(pcm: np.ndarray, block: int = UNIT) -> bytes:
    """Mono IMA ADPCM: blocks side by side, each code the nearest to its sample; the last block is filled up with its last sample."""
    per = samples_of_block(block)
    n = max(1, -(-len(pcm) // per))
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1] if len(pcm) else 0)]).astype(np.int32).reshape(n, per)
    # each block begins at the step nearest to its first difference
    index = np.minimum(np.searchsorted(STEPS, np.abs(x[:, 1] - x[:, 0])), 88).astype(np.int32)
    out = np.zeros((n, block), dtype=np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 2] = index
    value = x[:, 0].copy()
    for t in range(1, per):
        step, gap = STEPS[index], x[:, t] - value
        small = np.minimum((np.abs(gap) << 2) // step, 7)
        code = (small | np.where(gap < 0, 8, 0)).astype(np.uint8)
        value, index = _step(value, index, code)
        out[:, 4 + (t - 1) // 2] |= code << (4 * ((t - 1) % 2))
    return out.tobytes()


def compand(pcm: np.ndarray, table: np.ndarray) -> bytes:
    """The code of a lookup table whose sample is nearest, for each sample; of two codes of one sample the smaller."""
    samples, codes = np.unique(table.astype(np.int32), return_index=True)
    middle = (samples[1:] + samples[:-1]) / 2
    return codes[np.searchsorted(middle, pcm)].astype(np.uint8).tobytes()


def expand(wav: Wav) -> np.ndarray:
    """16-bit samples (samples, channels)."""
    raw, c = np.frombuffer(wav.data, dtype=np.uint8), wav.channels
    if wav.codec == ADPCM:
        whole = len(raw) // wav.block * wav.block
        parts = [decode_adpcm(raw[:whole].reshape(-1, wav.block), c).reshape(-1, c)]
        # a shorter block at the end, as far as it holds whole groups
        left = len(raw) - whole - 4 * c
        if left >= 0:
            left -= left % (4 * c) if c > 1 else 0
            parts.append(decode_adpcm(raw[whole : whole + 4 * c + left].reshape(1, -1), c).reshape(-1, c))
        out = np.concatenate(parts)
        return out if wav.samples is None else out[: wav.samples]
    if wav.codec == PCM:
        wide = wav.bits // 8
        raw = raw[: len(raw) // (wide * c) * wide * c].reshape(-1, wide)
        if wide == 1:
            out = (raw[:, 0].astype(np.int16) - 128) << 8
        else:  # the two upper bytes of each sample
            out = np.ascontiguousarray(raw[:, -2:]).view("<i2").ravel()
        return out.reshape(-1, c)
    table = MULAW_PCM if wav.codec == MULAW else ALAW_PCM
    return table[raw[: len(raw) // c * c]].reshape(-1, c)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation of samples (or rows of samples) in whole numbers, so results don't depend on the platform."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    at = np.arange(len(pcm) * target // rate, dtype=np.int64) * rate
    i, part = at // target, at % target
    nxt = np.minimum(i + 1, len(pcm) - 1)
    x = pcm.astype(np.int64)
    part = part.reshape(-1, *[1] * (pcm.ndim - 1))
    return ((x[i] * (target - part) + x[nxt] * part) // target).astype(np.int16)


def to_pcm(media: DataFrame, column: str = "media", target: int = 16_000) -> DataFrame:
    """doc_id and pcm, a WAV of the decoded audio of the column at the target rate, with its channels."""

    def run(batches):
        for batch in batches:
            out = []
            for m in batch[column]:
                try:
                    wav = read_wav(m or b"")
                    pcm = resample(expand(wav), wav.rate, target)
                    out.append(write_wav(pcm.astype("<i2").tobytes(), PCM, target, wav.channels))
                except NotWav:
                    out.append(None)
            yield pd.DataFrame({"doc_id": batch.doc_id, "pcm": out})

    return media.select("doc_id", column).mapInPandas(run, "doc_id long, pcm binary")


def store_pcm(media: DataFrame, path: str, column: str = "media", target: int = 16_000) -> DataFrame:
    """to_pcm() written as a Parquet table at the path and read again."""
    to_pcm(media, column, target).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b"\0"), len(raw)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a mu-law WAV."""

    def run(batches):
        for batch in batches:
            got = [payload_of(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_bytes": [n for _, n in got], "media": [write_wav(p, MULAW) for p, _ in got]})

    return common.keyed_texts(docs).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def _sums(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{int(np.sqrt((x * x).sum() / len(x)))}:{int(np.abs(x).max())}:{crossings}"


def feature_of(wavs: list[Wav]) -> list[str]:
    """Of each mono file of 8-bit codes: loudness, peak and zero crossings of its resampled audio, and of its bytes as A-law and as ADPCM blocks."""
    sizes = np.array([len(w.data) // UNIT for w in wavs])
    adpcm = decode_adpcm(np.frombuffer(b"".join(w.data for w in wavs), dtype=np.uint8).reshape(-1, UNIT))[:, :, 0].astype(np.int64)
    energy = np.add.reduceat((adpcm * adpcm).sum(1), np.cumsum(sizes) - sizes).tolist()
    out = []
    for w, e, k in zip(wavs, energy, sizes.tolist(), strict=True):
        wide = resample(expand(w)[:, 0], w.rate, 16_000)
        alaw = expand(replace(w, codec=ALAW))[:, 0]
        out.append(f"mulaw16k={_sums(wide)} alaw={_sums(alaw)} adpcm={int(np.sqrt(e / (k * adpcm.shape[1])))}")
    return out


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes read back."""

    def run(batches):
        for batch in batches:
            wavs = [read_wav(m) for m in batch.media]
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "n_bytes": batch.n_bytes,
                "payload_bytes": [len(w.data) for w in wavs],
                "payload_sha256": [hashlib.sha256(w.data).hexdigest() for w in wavs],
                "tail_crc32": [zlib.crc32(w.data[-UNIT:]) for w in wavs],
                "media_bytes": [len(m) for m in batch.media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in batch.media],
                "feature": feature_of(wavs),
            })

    return stored.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    media, _ = common.saved(spark, store_texts(common.read_table(spark, sf_dir, "documents")), "media", compression="zstd")
    return features(media)
