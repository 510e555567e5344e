"""Images on numpy: decoding, resizing, edge maps and pixel metrics. Columns go through Arrow UDFs."""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import udf

CELL = "struct<path: string, bytes: binary, kind: string>"


def normalised_cell(cell: Column, kind: str) -> Column:
    """An image cell as struct<path, bytes, kind>. kind of the column: binary, struct (bytes, path), string, or array of one of these.

    A string is a data URI, a web address, or else a path; of an array the first element counts. Null and empty cells are null.
    """
    if kind.startswith("array "):
        return normalised_cell(F.get(cell, F.lit(0)), kind.removeprefix("array "))
    empty = lambda t: F.lit(None).cast(t)
    of = lambda p, b, k: F.struct(p.alias("path"), b.alias("bytes"), F.lit(k).alias("kind"))
    if kind == "binary":
        return F.when(cell.isNotNull(), of(empty("string"), cell, "bytes"))
    if kind == "struct":
        return F.when(cell["bytes"].isNotNull(), of(cell["path"], cell["bytes"], "bytes")).when(cell["path"].isNotNull(), of(cell["path"], empty("binary"), "path"))
    uri = F.unbase64(F.regexp_replace(cell, r"\Adata:image/[^,]*,", ""))
    return F.when(cell.startswith("data:image/"), of(empty("string"), uri, "data")).when(cell.rlike(r"\Ahttps?://"), of(cell, empty("binary"), "url")).when(cell.isNotNull(), of(cell, empty("binary"), "path"))


def decode_png(data: bytes) -> np.ndarray:
    """A PNG as uint8 (height, width, channels). Bit depths 8 and 16, no interlacing; palettes are looked up."""
    if not data.startswith(SIGNATURES["png"]):
        raise ValueError("not a PNG")
    at, packed, palette, alpha = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if interlace or depth not in (8, 16):
        raise ValueError("this kind of PNG isn't read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bpp = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    up = np.zeros(w * bpp, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + up
        elif kind == 1:
            row = np.cumsum(line.reshape(w, bpp), axis=0, dtype=np.uint8).reshape(-1)
        else:
            row = _predicted(kind, line, up, bpp)
        out[y] = up = row
    pixels = out.reshape(h, w, channels, depth // 8)[..., 0]
    if colour == 3:
        rgb = palette[pixels[..., 0]]
        if alpha is not None:
            full = np.append(alpha, np.full(max(len(palette) - len(alpha), 0), 255, np.uint8))
            return np.concatenate([rgb, full[pixels[..., 0]][..., None]], axis=2)
        return rgb
    return pixels


def _predicted(kind: int, line: np.ndarray, up: np.ndarray, bpp: int) -> np.ndarray:
    """A row filtered by its average or by Paeth's predictor."""
    row, above = bytearray(line.tobytes()), up.tolist()
    for i, x in enumerate(row):
        left, b = row[i - bpp] if i >= bpp else 0, above[i]
        if kind == 3:
            guess = (left + b) // 2
        else:
            c = above[i - bpp] if i >= bpp else 0
            p = left + b - c
            da, db, dc = abs(p - left), abs(p - b), abs(p - c)
            guess = left if da <= db and da <= dc else b if db <= dc else c
        row[i] = (x + guess) & 255
    return np.frombuffer(bytes(row), np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """uint8 (height, width) or (height, width, 1 to 4) as a PNG."""
    p = pixels[..., None] if pixels.ndim == 2 else pixels
    h, w, c = p.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * c).astype(np.uint8)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def on_white(pixels: np.ndarray) -> np.ndarray:
    """RGB with transparency flattened on white; grey is repeated."""
    p = pixels.astype(np.float64)
    if p.shape[2] in (2, 4):
        a = p[..., -1:] / 255
        p = p[..., :-1] * a + 255 * (1 - a)
    return np.rint(np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p).astype(np.uint8)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma in [0, 1] as float32."""
    p = pixels if pixels.ndim == 3 else pixels[..., None]
    p = p[..., :3] if p.shape[2] >= 3 else np.repeat(p[..., :1], 3, axis=2)
    return (np.rint(p @ np.array([0.299, 0.587, 0.114])) / 255).astype(np.float32)


#: How files of a kind begin, the EXIF tag of the orientation, and its types of two and four bytes.
SIGNATURES = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "webp": b"RIFF"}
ORIENTATION, SHORT, LONG = 0x0112, 3, 4


def kind_of(data: bytes) -> str | None:
    """The kind of an image file by its first bytes."""
    return next((kind for kind, start in SIGNATURES.items() if data.startswith(start)), None)


def _exif(data: bytes) -> bytes:
    """The EXIF block of a PNG or JPEG; empty where there is none."""
    kind, at = kind_of(data), 8
    if kind == "png":
        while at + 8 <= len(data):
            n, name = struct.unpack(">I4s", data[at : at + 8])
            if name == b"eXIf":
                return data[at + 8 : at + 8 + n]
            at += 12 + n
    elif kind == "jpeg":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            n = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + n]
            at += 2 + n
    return b""


def orientation(data: bytes) -> int:
    """The EXIF orientation of an image file, from 1 to 8; 1 where it says none that is valid."""
    block = _exif(data)
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    try:
        at = struct.unpack(order + "I", block[4:8])[0] if order else len(block)
        for i in range(struct.unpack(order + "H", block[at : at + 2])[0] if order else 0):
            entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if tag == ORIENTATION and kind in (SHORT, LONG):
                value = struct.unpack(order + ("H" if kind == SHORT else "I"), entry[8 : 10 if kind == SHORT else 12])[0]
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def upright(pixels: np.ndarray, turned: int) -> np.ndarray:
    """Pixels as an EXIF orientation wants them shown: from 5 on the axes change places, then each axis may be reversed."""
    p = np.swapaxes(pixels, 0, 1) if turned >= 5 else pixels
    return p[:: -1 if turned in (3, 4, 7, 8) else 1, :: -1 if turned in (2, 3, 6, 7) else 1]


def local_bytes(path: str) -> bytes:
    """What a file of a folder that all workers have holds."""
    return Path(path.removeprefix("file:")).read_bytes()


@dataclass(frozen=True)
class Loader:
    """Opens images of any origin as RGB on white, upright: bytes, a data URI or base64 text, a path or a web address.

    PNG is decoded here. decoders: what turns the bytes of another kind of SIGNATURES into pixels. fetch and open: what
    gives the bytes behind a web address and a path. What can't be opened is a ValueError.
    """

    decoders: dict[str, Callable[[bytes], np.ndarray]] = field(default_factory=dict)
    fetch: Callable[[str], bytes] | None = None
    open: Callable[[str], bytes] = local_bytes

    def bytes_of(self, image: bytes | str) -> bytes:
        if not isinstance(image, str):
            return bytes(image)
        if image.startswith(("http://", "https://")):
            if self.fetch is None:
                raise ValueError("nothing fetches web addresses here")
            return self.fetch(image)
        try:
            if not image.startswith("data:"):
                return self.open(image)
        except (OSError, ValueError):  # then it may be base64
            pass
        try:
            return base64.b64decode(image.split(",", 1)[-1] if image.startswith("data:") else image, validate=True)
        except binascii.Error as e:
            raise ValueError(f"neither a path nor base64: {image[:80]}") from e

    def __call__(self, image: bytes | str) -> np.ndarray:
        try:
            data = self.bytes_of(image)
            kind = kind_of(data)
            decode = self.decoders.get(kind) or (decode_png if kind == "png" else None)
            if decode is None:
                raise ValueError(f"no decoder of {kind or 'this kind of file'}")
            return on_white(upright(decode(data), orientation(data)))
        except (OSError, TypeError, KeyError, struct.error, zlib.error) as e:
            raise ValueError(f"an image that can't be opened: {e}") from e


def load_bytes(data: bytes | str) -> np.ndarray:
    """Pixels of an image as it stands in its file, from PNG bytes or a base64 data URI of them."""
    return decode_png(Loader().bytes_of(data))


def as_png(cell: Column, loader: Loader | None = None) -> Column:
    """A cell of `normalised_cell` as bytes of an upright RGB PNG on white, which all metrics take; null where it can't be opened."""
    opened = loader or Loader()

    @udf(returnType=T.BinaryType(), useArrow=True)
    def convert(path, data):
        try:
            return encode_png(opened(bytes(data) if data is not None else path)) if data is not None or path else None
        except ValueError:
            return None

    return convert(cell["path"], cell["bytes"])


def require_grey(image: np.ndarray) -> np.ndarray:
    """The image if it is a 2-D float32 in [0, 1], else ValueError."""
    if image.ndim != 2 or image.dtype != np.float32 or image.min() < -1e-6 or image.max() > 1 + 1e-6:
        raise ValueError("a grey image is 2-D, float32 and in [0, 1]")
    return image


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    def weights(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(x.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), x - low

    a, b, f = weights(image.shape[0], height)
    c, d, g = weights(image.shape[1], width)
    more = (slice(None),) * 0 + (None,) * (image.ndim - 2)
    f, g = f[(slice(None), None, *more)], g[(None, slice(None), *more)]
    rows = image[a] * (1 - f) + image[b] * f
    return (rows[:, c] * (1 - g) + rows[:, d] * g).astype(image.dtype)


def lanczos(image: np.ndarray, height: int, width: int, lobes: int = 3) -> np.ndarray:
    """Resampled by a windowed sinc, which widens where the image shrinks; uint8 stays within its range."""

    def weights(n: int, m: int) -> np.ndarray:
        x = (np.arange(n) + 0.5 - (np.arange(m)[:, None] + 0.5) * n / m) / max(n / m, 1)
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
        return w / w.sum(axis=1, keepdims=True)

    rows = np.tensordot(weights(image.shape[0], height), image, 1)
    out = np.moveaxis(np.tensordot(weights(image.shape[1], width), rows, (1, 1)), 0, 1)
    return np.clip(out.round(), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)


def trim_square(pixels: np.ndarray, size: int | None = None) -> np.ndarray:
    """RGB without its white border, centred on a white square: of the longer side, or of `size`, to which that side is resized."""
    inked = np.argwhere((pixels < 255).any(axis=2))
    if len(inked):
        (y0, x0), (y1, x1) = inked.min(axis=0), inked.max(axis=0) + 1
        pixels = pixels[y0:y1, x0:x1]
    h, w = pixels.shape[:2]
    side = size or max(h, w)
    if max(h, w) != side:
        h, w = max(round(h * side / max(h, w)), 1), max(round(w * side / max(h, w)), 1)
        pixels = lanczos(pixels, h, w)
    out = np.full((side, side, pixels.shape[2]), 255, pixels.dtype)
    out[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = pixels
    return out


def is_blank(pixels: np.ndarray) -> bool:
    """Whether all pixels have one colour."""
    return bool((pixels == pixels[:1, :1]).all())


def _filtered(image: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Separable filter of both axes."""
    r = len(kernel) // 2
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode=mode)
        out = sum(k * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def gaussian(size: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma if sigma else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def canny(image: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Edges (0 or 1) of a grey image in [0, 255]: Sobel gradients, thinned along their direction, traced from strong to weak."""
    wide = np.pad(image.astype(np.float64), 1, mode="edge")
    at = lambda dy, dx: wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    padded = np.pad(size, 1)
    near = lambda dy, dx: padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx]
    sector = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    keep = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        keep |= (sector == k) & (size > near(-dy, -dx)) & (size >= near(dy, dx))
    strong, weak = keep & (size > high), keep & (size > low)
    while True:
        spread = np.pad(strong, 1)
        grown = weak & np.any([spread[1 + dy : spread.shape[0] - 1 + dy, 1 + dx : spread.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        if (grown == strong).all():
            return strong.astype(np.float64)
        strong = grown | strong


def edge_map(image: np.ndarray) -> np.ndarray:
    """Canny edges, thickened by one pixel and blurred by a 13 x 13 Gaussian."""
    edges = np.pad(canny(np.rint(image * 255)), 1)
    thick = np.max([edges[1 + dy : edges.shape[0] - 1 + dy, 1 + dx : edges.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return _filtered(thick, gaussian(13))


def z_score(image: np.ndarray) -> np.ndarray:
    std = image.std()
    return (image - image.mean()) / (std if std >= 1e-6 else 1.0)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a if a.shape == b.shape else resize(a, *b.shape[:2])


def _square_error(predicted: np.ndarray, reference: np.ndarray, edges: bool) -> float:
    of = edge_map if edges else np.asarray
    return float(((z_score(of(_alike(predicted, reference)).astype(np.float64)) - z_score(of(reference).astype(np.float64))) ** 2).mean())


def edge_similarity(predicted: np.ndarray, reference: np.ndarray) -> float:
    """1 less the mean squared difference of standardised edge maps, in [-1, 1]."""
    return float(np.clip(1 - _square_error(predicted, reference, True), -1, 1))


def pixel_similarity(predicted: np.ndarray, reference: np.ndarray) -> float:
    """1 less the mean squared difference of standardised pixels, in [-1, 1]."""
    return float(np.clip(1 - _square_error(predicted, reference, False), -1, 1))


def pixel_distance(predicted: np.ndarray, reference: np.ndarray, edges: bool = False) -> float:
    """Half the mean squared difference of standardised pixels (or, with edges, of edge maps), in [0, 2]."""
    return float(np.clip(_square_error(predicted, reference, edges) / 2, 0, 2))


def psnr(predicted: np.ndarray, reference: np.ndarray) -> float:
    """Peak signal-to-noise ratio in decibels for a range of 1; infinite for equal images."""
    error = float(((_alike(predicted, reference).astype(np.float64) - reference) ** 2).mean())
    return float("inf") if error == 0 else float(10 * np.log10(1 / error))


def ssim(predicted: np.ndarray, reference: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity over Gaussian windows, for a range of 1."""
    x, y = _alike(predicted, reference).astype(np.float64), reference.astype(np.float64)
    k, c1, c2 = gaussian(size, sigma), 0.01**2, 0.03**2
    mx, my = _filtered(x, k), _filtered(y, k)
    vx, vy, vxy = _filtered(x * x, k) - mx * mx, _filtered(y * y, k) - my * my, _filtered(x * y, k) - mx * my
    full = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    r = size // 2
    inner = full[r:-r, r:-r] if min(full.shape) > 2 * r else full
    return float(inner.mean())


IMAGE_METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mse", "mse_nocanny", "ssim", "psnr")])


@udf(returnType=IMAGE_METRICS, useArrow=True)
def image_metrics(predicted, reference):
    """All pixel metrics of a pair of PNGs, each decoded once; null where one can't be read."""
    try:
        p, r = (Loader()(bytes(x)) for x in (predicted, reference))
    except (ValueError, TypeError):
        return None
    gp, gr, sp, sr = grey(p), grey(r), grey(trim_square(p)), grey(trim_square(r))
    return edge_similarity(gp, gr) * 100, pixel_distance(gp, gr) * 100, ssim(sp, sr), psnr(gp, gr)


@udf(returnType=T.StructType([T.StructField("edge", T.DoubleType()), T.StructField("pixel", T.DoubleType())]), useArrow=True)
def reward_similarities(predicted, reference):
    """Edge and pixel similarity of a pair of PNGs: -1 each where the prediction is absent or unreadable, 0 without a reference."""
    if reference is None:
        return 0.0, 0.0
    try:
        p, r = (grey(Loader()(bytes(x))) for x in (predicted, reference))
    except (ValueError, TypeError):
        return -1.0, -1.0
    return edge_similarity(p, r), pixel_similarity(p, r)


@udf(returnType=T.BooleanType(), useArrow=True)
def blank_image(data):
    """Whether a PNG shows one colour only, or can't be read."""
    try:
        return is_blank(decode_png(bytes(data)))
    except (ValueError, TypeError, KeyError, struct.error, zlib.error):
        return True


@udf(returnType=T.BooleanType(), useArrow=True)
def readable_png(data):
    """Whether bytes are a PNG that can be decoded."""
    try:
        return decode_png(bytes(data)).size > 0
    except (ValueError, TypeError, KeyError, struct.error, zlib.error):
        return False


@udf(returnType=T.BinaryType(), useArrow=True)
def png_of_rows(data, height, width, channels):
    """The PNG of an image source's bytes, whose colours stand as blue, green, red and alpha."""
    pixels = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
    return encode_png(on_white(pixels if channels == 1 else pixels[..., [2, 1, 0, 3][:channels]]))
