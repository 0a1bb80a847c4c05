import cmath
import hashlib
import math
import random
import zlib

import numpy as np

from quillmill.llm.media import fingerprint, from_wav, media_columns, to_payload, to_wav


def test_round_trip_and_padding():
    for text, n, size in ((None, 0, 64), ("", 0, 64), ("a" * 64, 64, 64), ("é" * 40, 80, 128)):
        length, payload = to_payload(text)
        assert (length, len(payload)) == (n, size)
        assert from_wav(to_wav(payload)) == payload


def test_a_tone_keeps_its_bin_and_time_code():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 16 / 128)).astype(np.uint8)
    times, codes = fingerprint(tone.tobytes(), peaks=1)
    assert len(times) == len(codes) > 100 and (np.diff(times) >= 0).all()
    assert set(codes >> 20) == {16} and set(codes >> 8 & 0xFFF) == {16}


def naive(samples, frame=128, hop=64, peaks=2, fan=4, reach=12):
    """Peaks from a Fourier sum by definition, and every pair looked at: a set of (time, bin, bin, distance)."""
    x = list(samples) + [128] * (frame - len(samples))
    turn = [cmath.exp(-2j * math.pi * k / frame) for k in range(frame)]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / frame) for n in range(frame)]
    found = []
    for t, start in enumerate(range(0, len(x) - frame + 1, hop)):
        s = [(x[start + n] - 128) * window[n] for n in range(frame)]
        mag = [abs(sum(s[n] * turn[k * n % frame] for n in range(frame))) for k in range(frame // 2 + 1)]
        local = [k for k in range(2, frame // 2) if mag[k] > mag[k - 1] and mag[k] >= mag[k + 1] and mag[k] > 1e-3]
        found += [(t, k) for k in sorted(sorted(local, key=lambda k: -mag[k])[:peaks])]
    return sorted((t, f, g, u - t) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 1 + fan] if u - t <= reach)


def test_equals_the_definition():
    rng = random.Random(7)
    words = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    for n in (0, 3, 60, 150):
        samples = to_payload(b" ".join(rng.choice(words) for _ in range(n)).decode())[1]
        times, codes = fingerprint(samples)
        got = sorted((int(t), int(c) >> 20, int(c) >> 8 & 0xFFF, int(c) & 0xFF) for t, c in zip(times, codes, strict=True))
        assert got == naive(samples)


def test_blocks_do_not_change_the_fingerprint():
    data = bytes(np.random.default_rng(0).integers(0, 255, 20_000, np.uint8))
    a, b = fingerprint(data, block=7), fingerprint(data)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_columns(spark, docs):
    d = docs((1, "hello world " * 50), (2, None), (3, ""), (None, "hello world " * 50), (1, "hello world " * 50))
    got = media_columns(d).collect()
    assert len(got) == 5 and media_columns(d.limit(0)).count() == 0
    for r in got:
        assert bytes(r.payload) == from_wav(bytes(r.media)) and len(r.times) == len(r.codes)
        assert r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.tail_crc32 == zlib.crc32(bytes(r.payload)[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    one = [r for r in got if r.n_bytes == 600]
    assert len(one) == 3 and len({tuple(r.codes) for r in one}) == 1 and len(one[0].codes) > 0


def test_clashing_names_and_long_texts(spark, docs):
    from pyspark.sql import functions as F

    d = docs((1, "some text " * 20), (2, "x" * 300_000), (2, "x" * 300_000))
    clash = d.withColumns({c: F.lit("mine") for c in ("id", "times", "codes", "payload", "media", "n_bytes")})
    assert sorted(map(repr, media_columns(clash).collect())) == sorted(map(repr, media_columns(d).collect()))
