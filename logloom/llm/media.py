"""Media columns: Netpbm and BMP images to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

``decode`` reads P1-P6 Netpbm and PAM (P7), and uncompressed BMP of 1, 4, 8, 24 and 32 bits, into uint8 or uint16 arrays of
height x width x channels. ``area_resize`` takes the exact mean over each target pixel's area from an integral image (with
fractions of pixels at the borders). ``tile`` makes the NPY bytes of a resized image, ``difference_hash`` 64 bits that say
whether brightness falls from each pixel of a 9 x 8 picture to its right neighbour. ``media_columns`` applies them to a binary
column of a DataFrame.

``text_media`` keeps any text as an image without loss: its UTF-8 bytes, filled up with zeros to a positive multiple of 64, are
the 8-bit samples of a PGM picture 64 wide. The pictures and their NPY tiles are written as a Parquet table to the shared folder
and read back; everything that is returned comes from the bytes read back.

Edge cases: null media give null columns; bytes that aren't a readable image give null columns and a message in ``error``; a
null text is an empty one (64 zero bytes); extra columns are passed through by ``media_columns`` and ignored by ``text_media``.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

#: Samples in a row of a text's picture; pixels on a side of a tile.
UNIT, SIDE = 64, 32


def _header(raw: bytes, count: int) -> tuple[list[int], int]:
    """count numbers after the magic, white space and comments left out; the place after the single space that ends them."""
    out, at = [], 2
    while len(out) < count:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 35):
            if raw[at] == 35:
                while at < len(raw) and raw[at] not in (10, 13):
                    at += 1
            else:
                at += 1
        end = at
        while end < len(raw) and 48 <= raw[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("the header is cut off")
        out.append(int(raw[at:end]))
        at = end
    return out, at + 1


def _samples(raw: bytes, at: int, shape: tuple[int, int, int], most: int) -> np.ndarray:
    if not 0 < most < 65536:
        raise ValueError("the largest sample is out of range")
    kind = np.dtype(">u2") if most > 255 else np.dtype("u1")
    n = int(np.prod(shape))
    if len(raw) - at < n * kind.itemsize:
        raise ValueError("samples are missing")
    return np.frombuffer(raw, kind, n, at).reshape(shape).astype(kind.newbyteorder("="))


def decode_netpbm(raw: bytes) -> np.ndarray:
    magic = raw[:2]
    if magic == b"P7":
        head, _, _ = raw.partition(b"ENDHDR\n")
        at = len(head) + 7
        field = {k: v for k, v in (x.split(None, 1) for x in head.decode("ascii").splitlines()[1:] if x and x[0] != "#" and " " in x)}
        return _samples(raw, at, (int(field["HEIGHT"]), int(field["WIDTH"]), int(field["DEPTH"])), int(field["MAXVAL"]))
    if magic in (b"P1", b"P4"):
        (width, height), at = _header(raw, 2)
        if magic == b"P1":
            bits = np.frombuffer(raw[at - 1 :], np.uint8)
            bits = bits[(bits == 48) | (bits == 49)][: width * height] - 48
        else:
            row = -(-width // 8)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width].reshape(-1)
        if len(bits) < width * height:
            raise ValueError("samples are missing")
        return ((1 - bits) * 255).astype(np.uint8).reshape(height, width, 1)
    if magic not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (width, height, most), at = _header(raw, 3)
    shape = (height, width, 3 if magic in (b"P3", b"P6") else 1)
    if magic in (b"P5", b"P6"):
        return _samples(raw, at, shape, most)
    values = np.array(raw[at:].split()[: int(np.prod(shape))], np.int64)
    return values.astype(np.uint16 if most > 255 else np.uint8).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    num = lambda at, kind: int(np.frombuffer(raw, kind, 1, at)[0])
    start, width, height, depth, packing = num(10, "<u4"), num(18, "<i4"), num(22, "<i4"), num(28, "<u2"), num(30, "<u4")
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP isn't supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    flat = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        flat = flat[::-1]
    if depth >= 24:
        return flat[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1].copy()
    colours = num(46, "<u4") or 1 << depth
    palette = np.frombuffer(raw, np.uint8, colours * 4, 14 + num(14, "<u4")).reshape(-1, 4)[:, 2::-1]
    index = flat if depth == 8 else np.unpackbits(flat, axis=1) if depth == 1 else np.stack((flat >> 4, flat & 15), axis=2).reshape(rows, -1)
    return palette[index[:, :width]]


def decode(raw: bytes) -> np.ndarray:
    """height x width x channels; ValueError for bytes that aren't an image of a supported kind."""
    try:
        return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (KeyError, IndexError, TypeError, UnicodeDecodeError) as e:
        raise ValueError(f"not a readable image: {e}") from e


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey picture as binary PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def _edges(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(target + 1) * (size / target)
    low = np.minimum(np.floor(at).astype(np.int64), size - 1)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The exact mean of each target pixel's area, as float64.

    Sums come from the integral image; of its rows only those at target edges are made, so a tall image needs no copy of itself.
    """
    rows, columns, depth = image.shape
    y, fy = _edges(rows, height)
    x, fx = _edges(columns, width)
    cuts = np.unique(np.concatenate((y, y + 1)))
    inner = cuts[cuts < rows]
    bands = np.add.reduceat(image.reshape(rows, -1), inner, axis=0, dtype=np.int64).reshape(len(inner), columns, depth)
    whole = np.zeros((len(cuts), columns + 1, depth))
    np.cumsum(np.cumsum(bands, axis=0)[: len(cuts) - 1], axis=1, out=whole[1:, 1:])
    fy, fx = fy[:, None, None], fx[None, :, None]
    up, down = whole[np.searchsorted(cuts, y)], whole[np.searchsorted(cuts, y + 1)]
    line = up + (down - up) * fy
    left, right = line[:, x], line[:, x + 1]
    total = left + (right - left) * fx
    cell = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    return cell / ((rows / height) * (columns / width))


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness (ITU-R BT.601 weights) of three or more channels; the first channel of fewer."""
    if image.shape[2] < 3:
        return image[:, :, :1].astype(np.float64)
    return (image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(image: np.ndarray) -> str:
    small = np.round(area_resize(grey(image), 8, 9)[:, :, 0], 6)
    return np.packbits((small[:, :-1] > small[:, 1:]).reshape(-1)).tobytes().hex()


def tile(image: np.ndarray, side: int) -> bytes:
    """NPY bytes of the image resized to side x side, in its own sample type."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, np.iinfo(image.dtype).max).astype(image.dtype), allow_pickle=False)
    return out.getvalue()


COLUMNS = "height int, width int, channels int, tile binary, dhash string, error string"


def media_columns(df: DataFrame, media_col: str, side: int = SIDE, into: str = "media") -> DataFrame:
    """df with a struct column ``into``: size, NPY tile and difference hash of each image, or what was wrong with it."""
    rest = [df[c] for c in df.columns if c != into]
    src = df.select(F.struct(*rest).alias("rest"), df[media_col].alias("raw"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("height", "width", "channels", "tile", "dhash", "error")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        for batch in batches:
            found = []
            for raw in batch.column("raw").to_pylist():
                if raw is None:
                    found.append((None,) * 6)
                    continue
                try:
                    image = decode(raw)
                    found.append((*image.shape, tile(image, side), difference_hash(image), None))
                except ValueError as e:
                    found.append((None, None, None, None, None, str(e)))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.StructArray.from_arrays(columns, names)], ["rest", "media"])

    kind = dict(src.dtypes)["rest"]
    return src.mapInArrow(go, f"rest {kind}, media struct<{COLUMNS.replace(' ', ':').replace(',:', ',')}>").select("rest.*", F.col("media").alias(into))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = SIDE) -> DataFrame:
    """doc_id, n_bytes, media and tile: each text as the bytes of a PGM picture, and that picture's NPY tile."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "body"):
                data, off = K.utf8(part.column("body"))
                raw = data.tobytes()
                media, tiles, sizes = [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    rows = max(1, -(-(b - a) // UNIT))
                    payload = raw[a:b] + bytes(rows * UNIT - (b - a))
                    media.append(encode_pgm(np.frombuffer(payload, np.uint8).reshape(rows, UNIT)))
                    tiles.append(tile(decode(media[-1]), side))
                    sizes.append(b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary())], ["doc_id", "n_bytes", "media", "tile"])

    return src.mapInArrow(store, f"doc_id {dict(src.dtypes)['id']}, n_bytes long, media binary, tile binary")


FOUND = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "tile_shape": pa.string(), "tile_sha256": pa.string(),
}


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored pictures and tiles hold: payload digests, the difference hash of the decoded picture, and the tile's array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, npy in zip(batch.column("media").to_pylist(), batch.column("tile").to_pylist(), strict=True):
                image, small = decode(raw), np.load(io.BytesIO(npy), allow_pickle=False)
                payload = image.tobytes()
                found.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image),
                    "x".join(map(str, small.shape)), hashlib.sha256(small.tobytes()).hexdigest(),
                ))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), FOUND.values(), strict=True)] if found else [pa.array([], k) for k in FOUND.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *FOUND])

    kind = dict(stored.dtypes)["doc_id"]
    names = ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in FOUND.items())
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, {names}")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_back(written(text_media(docs, id_col, text_col), "media"))
