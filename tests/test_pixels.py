"""Decoded pictures against those that the JVM's own writers made."""

import struct
import zlib

import numpy as np
import pytest

from catalumen.sources import kernels, pixels


def png(pixels_, colour=2, depth=8, filters=(0,)):
    """A PNG whose rows take the filters in turns (those named here are only None, Sub, Up, Average and Paeth)."""
    rows = np.asarray(pixels_, dtype=np.uint8)
    h, w, c = rows.shape
    flat, out = rows.reshape(h, w * c).astype(int), b""
    for y in range(h):
        kind = filters[y % len(filters)]
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left = np.concatenate([np.zeros(c, int), flat[y][:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        a, b, d = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))][kind]
        out += bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d_: struct.pack(">I", len(d_)) + k + d_ + struct.pack(">I", zlib.crc32(k + d_))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def picture(w=203, h=150, channels=3):
    y, x = np.mgrid[0:h, 0:w]
    waves = [128 + 60 * np.sin(x / (20 + 7 * k)) + 50 * np.cos(y / (15 + 5 * k) + k) for k in range(channels)]
    return np.clip(np.stack(waves, axis=2), 0, 255).astype(np.uint8)


@pytest.fixture
def jvm(spark, tmp_path):
    """write(kind, file, compression, progressive): the picture in another format."""
    j = spark.sparkContext._jvm
    try:
        io, file = j.javax.imageio.ImageIO, j.java.io.File
        io.setUseCache(False)
    except Exception:  # noqa: BLE001
        pytest.skip("no picture writers in this JVM")

    def write(image, kind, compression=None, progressive=False):
        source, target = tmp_path / "source.png", tmp_path / f"x.{kind}"
        source.write_bytes(png(image, 2 if image.shape[2] == 3 else 0))
        read = io.read(file(str(source)))
        writer = io.getImageWritersByFormatName(kind).next()
        how = writer.getDefaultWriteParam()
        if progressive:
            how.setProgressiveMode(1)  # by default
        if compression:
            how.setCompressionMode(2)  # explicitly
            how.setCompressionType(compression)
        if kind == "jpg":
            how.setCompressionMode(2)  # explicitly
            how.setCompressionQuality(0.95)
        target.unlink(missing_ok=True)
        out = io.createImageOutputStream(file(str(target)))
        writer.setOutput(out)
        writer.write(None, j.javax.imageio.IIOImage(read, None, None), how)
        out.close()
        return str(target)

    return write


def grey_of(image):
    return image[..., 0].astype(float) if image.shape[2] == 1 else image @ pixels.WEIGHTS


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("channels", [1, 3])
def test_jpeg_block_means(jvm, channels, progressive):
    image = picture(channels=channels)
    path = jvm(image, "jpg", progressive=progressive)
    got, whole = pixels.luminance(path), grey_of(image)
    h, w = whole.shape
    assert got.shape == (-(-h // 8), -(-w // 8))
    inner = whole[: h // 8 * 8, : w // 8 * 8].reshape(h // 8, 8, w // 8, 8).mean(axis=(1, 3))
    assert np.abs(got[: h // 8, : w // 8] - inner).max() < 2
    data = open(path, "rb").read()
    for cut in range(200, len(data), len(data) // 15):  # a file that breaks off gives what there is, or nothing
        part = pixels.jpeg(data[:cut])
        assert part is None or part.shape == got.shape


def test_jpeg_as_png(jvm, tmp_path):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:480, 0:640]
    sum_ = sum(rng.normal() * 40 * np.cos(np.pi * (i * x / 640 + rng.random())) * np.cos(np.pi * (j * y / 480 + rng.random())) for i in range(8) for j in range(8))
    image = np.repeat(np.clip(128 + sum_, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    (tmp_path / "p.png").write_bytes(png(image))
    a, b = kernels.picture_hash(str(tmp_path / "p.png")), kernels.picture_hash(jvm(image, "jpg"))
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 5


@pytest.mark.parametrize("way", [None, "LZW", "Deflate", "ZLib", "PackBits"])
@pytest.mark.parametrize("channels", [1, 3])
def test_tiff(jvm, way, channels):
    image = picture(channels=channels)
    assert np.allclose(pixels.luminance(jvm(image, "tiff", way)), grey_of(image))


def test_gif(jvm):
    image = np.repeat(picture(channels=1) // 8 * 8, 3, axis=2)  # few enough colours
    for progressive in (False, True):
        assert np.abs(pixels.luminance(jvm(image, "gif", progressive=progressive)) - grey_of(image)).max() < 1


def test_png_of_the_jvm(jvm):
    image = picture()
    for progressive in (False, True):
        assert np.allclose(pixels.luminance(jvm(image, "png", progressive=progressive)), grey_of(image))


def test_png_filters(tmp_path):
    image = picture(37, 29)
    (tmp_path / "x.png").write_bytes(png(image, filters=(0, 1, 2, 3, 4)))
    assert np.allclose(pixels.luminance(str(tmp_path / "x.png")), grey_of(image))


def test_not_a_picture(tmp_path):
    for data in (b"", b"GIF89a", b"II*\0", b"\xff\xd8\xff", b"text"):
        (tmp_path / "x").write_bytes(data)
        try:
            assert pixels.luminance(str(tmp_path / "x")) is None
        except (IndexError, struct.error):  # a scan counts it as a file without a hash
            pass
