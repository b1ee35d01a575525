"""Pixel work on Arrow batches: metrics, perceptual hashes, fidelity, PNG encoding. Rows come from Spark's image source (BGR or BGRA bytes)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3 bytes, RGB; alpha is dropped and grey is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def pixels_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3 or 4 bytes, RGB or RGBA; grey is repeated, alpha stays."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, [2, 1, 0, 3][:channels]]


#: EXIF orientation to (transpose first, flip rows, flip columns).
_TURNS = {2: (False, False, True), 3: (False, True, True), 4: (False, True, False), 5: (True, False, False), 6: (True, False, True), 7: (True, True, True), 8: (True, True, False)}


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as its EXIF orientation wants it shown."""
    if orientation not in _TURNS:
        return a
    swap, rows, columns = _TURNS[orientation]
    a = a.swapaxes(0, 1) if swap else a
    return a[:: -1 if rows else 1, :: -1 if columns else 1]


def _exif_orientation(tiff: bytes) -> int:
    """Tag 0x0112 of the first directory; 1 if there is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    count = struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0
    for k in range(count):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def _jpeg_notes(head: bytes) -> tuple[int, bytes | None]:
    orientation, parts, at = 1, {}, 2
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        size = struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
            orientation = _exif_orientation(body[6:])
        if head[at + 1] == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            parts[body[12]] = body[14:]
        at += 2 + size
    return orientation, b"".join(parts[k] for k in sorted(parts)) or None


def _png_notes(head: bytes) -> tuple[int, bytes | None]:
    orientation, icc, at = 1, None, 8
    while at + 8 <= len(head) and head[at + 4 : at + 8] != b"IDAT":
        size = struct.unpack(">I", head[at : at + 4])[0]
        body = head[at + 8 : at + 8 + size]
        if head[at + 4 : at + 8] == b"iCCP" and b"\0" in body:
            icc = zlib.decompress(body[body.index(b"\0") + 2 :])
        if head[at + 4 : at + 8] == b"eXIf":
            orientation = _exif_orientation(body)
        at += 12 + size
    return orientation, icc


def image_notes(head: bytes) -> tuple[int, bytes | None]:
    """EXIF orientation and ICC profile from the beginning of a JPEG or PNG file; 1 and none where there are none or they are damaged."""
    try:
        if head.startswith(b"\xff\xd8"):
            return _jpeg_notes(head)
        if head.startswith(b"\x89PNG"):
            return _png_notes(head)
    except (struct.error, zlib.error, IndexError):
        pass
    return 1, None


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Whole grey levels by the ITU-R 601 weights in 16-bit fixed point, rounded."""
    r, g, b = (rgb[:, :, k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def relative_luminance(rgb: np.ndarray) -> np.ndarray:
    """By the ITU-R 709 weights, not rounded."""
    return rgb.astype(np.float32) @ np.array([0.2126, 0.7152, 0.0722], np.float32)


def basic_metrics(rgb: np.ndarray) -> tuple[float, float, float]:
    """Mean and standard deviation of the luminance, and the sum of its mean absolute steps to the right and downwards."""
    y = relative_luminance(rgb).astype(np.float64)
    steps = sum(np.abs(np.diff(y, axis=k)).mean() for k in (1, 0) if y.shape[k] > 1)
    return round(float(y.mean()), 3), round(float(y.std()), 3), round(float(steps), 3)


def _lanczos(size: int, out: int, a: int = 3) -> np.ndarray:
    """out x size weights; the kernel widens when the picture shrinks."""
    scale = max(1.0, size / out)
    centre = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize_grey(y: np.ndarray, height: int, width: int) -> np.ndarray:
    across = np.clip(np.rint(y.astype(np.float64) @ _lanczos(y.shape[1], width).T), 0, 255)
    return np.clip(np.rint(_lanczos(y.shape[0], height) @ across), 0, 255).astype(np.int16)


def difference_hash(rgb: np.ndarray, size: int = 8) -> int:
    """size x size bits, row by row and the first highest: whether a pixel of the reduced picture is darker than its right neighbour. Signed for size 8."""
    small = resize_grey(luminance(rgb), max(4, size), max(4, size) + 1)
    value = int("".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    return value - (1 << 64) if value >> 63 else value


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; without variance 1 if the pictures agree, else 0."""
    x, y = a - a.mean(), b - b.mean()
    bottom = float(np.sqrt((x * x).sum() * (y * y).sum()))
    return float((x * y).sum() / bottom) if bottom else float(np.allclose(a, b))


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean SSIM over square windows of pictures in 0..1, by the published definition with sample covariances; correlation for pictures smaller than a window."""
    if min(a.shape) < window:
        return correlation(a, b)

    def mean(v: np.ndarray) -> np.ndarray:
        s = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    n = window**2 / (window**2 - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def resize_rgb(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.stack([resize_grey(rgb[:, :, k], height, width) for k in range(3)], axis=2).astype(np.uint8)


def fidelity_metrics(reference: np.ndarray, cleaned: np.ndarray, pixel_change: float = 0.30, ssim: bool = False) -> dict:
    """Of two RGB pictures; the reference is brought to the size of the other. Without ssim the correlation stands for structure."""
    aspects = reference.shape[1] / reference.shape[0], cleaned.shape[1] / cleaned.shape[0]
    if reference.shape != cleaned.shape:
        reference = resize_rgb(reference, *cleaned.shape[:2])
    a, b = reference.astype(np.float64) / 255, cleaned.astype(np.float64) / 255
    ya, yb = relative_luminance(reference).astype(np.float64) / 255, relative_luminance(cleaned).astype(np.float64) / 255
    corr, delta = correlation(ya, yb), np.abs(a - b)
    out = {
        "structural_similarity": structural_similarity(ya, yb) if ssim else corr, "luminance_correlation": corr, "mean_absolute_difference": float(delta.mean()),
        "changed_area_fraction": float((delta.max(axis=2) > pixel_change).mean()), "aspect_ratio_delta": abs(aspects[0] - aspects[1]) / aspects[0],
    }
    return {k: round(v, 6) for k, v in out.items()}


def encode_png(rgb: np.ndarray, icc: bytes | None = None) -> bytes:
    """8-bit RGB or RGBA, with the colour profile if there is one."""
    h, w, n = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, w * n)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)
    profile = chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc, 6)) if icc else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + profile + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """A picture that encode_png made: 8-bit RGB or RGBA, rows without prediction. Others raise ValueError."""
    at, body, size = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if size is None or size[2:] not in ((8, 2, 0, 0, 0), (8, 6, 0, 0, 0)):
        raise ValueError("not a PNG of this engine")
    w, h, channels = size[0], size[1], 4 if size[3] == 6 else 3
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    if rows[:, 0].any():
        raise ValueError("not a PNG of this engine")
    return rows[:, 1:].reshape(h, w, channels)


def within_megapixels(a: np.ndarray, limit: float, rounded: bool = False) -> np.ndarray:
    """The picture, made smaller if it has more pixels; sides are cut to whole numbers, or rounded."""
    h, w = a.shape[:2]
    if w * h <= limit * 1e6:
        return a
    scale = (limit * 1e6 / (w * h)) ** 0.5
    side = (lambda v: max(1, round(v * scale))) if rounded else (lambda v: max(1, int(v * scale)))
    return np.stack([resize_grey(a[:, :, k], side(h), side(w)) for k in range(a.shape[2])], axis=2).astype(np.uint8)


def crop(rgb: np.ndarray, box: list[int]) -> np.ndarray:
    return rgb[box[1] : box[3], box[0] : box[2]]


_ANALYSIS = "path string, width int, height int, corrupt boolean, has_alpha boolean, brightness_mean double, contrast_stddev double, edge_sharpness double, perceptual_hash long"


def analyze_images(images: DataFrame) -> DataFrame:
    """path, dimensions, metrics and hash of rows of the image source; a picture that could not be decoded is marked corrupt and has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                if h is None or h <= 0:
                    out.append((origin, None, None, True, None, None, None, None, None))
                    continue
                rgb = to_rgb(data.as_py(), h, w, n)
                out.append((origin, w, h, False, n == 4, *basic_metrics(rgb), difference_hash(rgb)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _ANALYSIS.split(", ")])

    i = F.col("image")
    return images.select(i["origin"].alias("path"), i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data")).mapInArrow(run, _ANALYSIS)


def to_png(images: DataFrame) -> DataFrame:
    """path and PNG bytes of the decodable rows of the image source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(to_rgb(d.as_py(), h, w, n)) for h, w, n, d in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), b.column(4))]
            yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], names=["path", "png"])

    i = F.col("image")
    return images.where(i["height"] > 0).select(i["origin"].alias("path"), i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data")).mapInArrow(run, "path string, png binary")
