import struct
import zlib

import numpy as np
import pytest

from factloom.llm import media


def brute_unfilter(kinds, residuals, step):
    out = []
    for kind, line in zip(kinds, residuals.tolist()):
        above, row = (out[-1] if out else [0] * len(line)), []
        for x, v in enumerate(line):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(row)
    return np.array(out, np.uint8)


def test_unfilter_equals_definition():
    rng = np.random.default_rng(1)
    for kinds in ([0, 1, 2, 3, 4, 4, 3], [2] * 7, [0] * 7, [1] * 7):
        residuals = rng.integers(0, 256, (7, 24), dtype=np.uint8)
        assert (media.unfilter(np.array(kinds), residuals, 3) == brute_unfilter(kinds, residuals, 3)).all()


@pytest.mark.parametrize("size", [192, 384, 192 * 301])
def test_round_trip_and_damage(size):
    samples = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    png = media.write_png(samples)
    width, height, back = media.read_png(png)
    assert (width, height, back.tobytes()) == (64, size // 192, samples)
    for broken in (png[:-20], png[:60] + bytes([png[60] ^ 1]) + png[61:], b"x" + png):
        with pytest.raises(media.DamagedImage):
            media.read_png(broken)


def test_hash_is_stable_under_small_changes():
    x = np.kron(np.random.default_rng(2).integers(0, 250, (8, 8)), np.ones((8, 24))).astype(np.uint8)
    y = x.copy()
    y[5, 5] += 1
    assert sum(bin(a ^ b).count("1") for a, b in zip(media.cosine_hash(x), media.cosine_hash(y))) <= 4


def test_column_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "é" * 100_000, None), (None, "a", "z"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    found = media.with_media(docs).collect()
    assert len(found) == 5
    by = {(r.id, r.n_bytes): r for r in found}
    assert by[(1, 0)].payload_bytes == 192 and by[(1, 0)].media_sha256 == by[(2, 0)].media_sha256
    assert by[(3, 200_000)].payload_bytes == -(-200_000 // 192) * 192
    assert media.read_png(bytes(by[(None, 1)].media))[2].tobytes() == b"a".ljust(192)
    assert media.with_media(docs.limit(0)).count() == 0


def test_chunk_layout():
    png = media.write_png(b" " * 192)
    assert png[:8] == media.SIGNATURE and struct.unpack(">II", png[16:24]) == (64, 1)
    assert struct.unpack(">I", png[29:33])[0] == zlib.crc32(png[12:29])


def brute_hash(samples):
    """Means of 32 bands and columns of the luminance, its cosine sums by definition, and the median, by plain loops."""
    import math

    height = len(samples)
    light = [[sum(line[3 * x : 3 * x + 3]) for x in range(64)] for line in samples.tolist()]
    small = []
    for r in range(32):
        a, b = r * height // 32, (r + 1) * height // 32
        band = light[a:b] if height >= 32 else [light[a]]
        row = [sum(line[x] for line in band) / len(band) for x in range(64)]
        small.append([(row[2 * x] + row[2 * x + 1]) / 2 for x in range(32)])
    low = [sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    low[0] = 0.0
    middle = sorted(low)
    middle = (middle[31] + middle[32]) / 2
    return [x > middle for x in low], [abs(x - middle) for x in low]


@pytest.mark.parametrize("height", [1, 7, 32, 45, 200])
def test_hash_equals_definition(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 192), dtype=np.uint8)
    want, apart = brute_hash(samples)
    got = np.unpackbits(np.frombuffer(media.cosine_hash(samples), np.uint8)).astype(bool).tolist()
    assert all(g == w or d < 1e-6 for g, w, d in zip(got, want, apart))


def test_query_columns(spark):
    import hashlib

    texts = ["", None, "abc", "é" * 96, "x" * 193, "y" * 200_000, "abc"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int").repartition(3)
    got = {r.id: r for r in media.with_media(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and media.read_png(bytes(r.media))[2].tobytes() == payload
    assert got[2][1:] == got[6][1:] and media.with_media(docs.limit(0)).count() == 0
