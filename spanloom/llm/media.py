"""Media columns: Netpbm and BMP files as numpy arrays, area-resized, cut into NPY tiles, with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.batches import BATCH_BYTES, small_batches
from spanloom.llm import textkernel as tk


#: Samples that an image may have if its file is smaller than they are: written as text, as bits, or through a palette.
MOST_PLAIN, MOST_SPREAD = 1 << 22, 1 << 27


class BadImage(ValueError):
    """Bytes that are not an image of a supported format."""


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic of a Netpbm file, comments skipped, and the position of the raster."""
    at, out = 2, []
    while len(out) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise BadImage("a number is missing in the header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _plain_numbers(data: bytes, at: int, count: int, digits: bool) -> np.ndarray:
    text = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
    parts = [c for c in text.decode("ascii", "replace") if c in "01"] if digits else text.split()
    if len(parts) < count:
        raise BadImage("the raster is too short")
    return np.array(parts[:count], dtype=np.int64)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width x channels, uint8 or (for a maximum over 255) uint16, 0 to the largest; bitmaps are 0 or 255."""
    kind = data[1] - 48
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind <= 3
    numbers, at = _header(data, 2 if bitmap else 3)
    (width, height), top = numbers[:2], 1 if bitmap else numbers[2]
    if not (0 < width and 0 < height and 0 < top < 65536):
        raise BadImage("impossible size or maximum")
    channels = 3 if colour else 1
    count = width * height * channels
    if (plain and count > MOST_PLAIN) or (bitmap and count > MOST_SPREAD):
        raise BadImage("too many samples for this format")
    if plain:
        flat = _plain_numbers(data, at, count, bitmap)
    elif bitmap:
        row = -(-width // 8)
        raster = np.frombuffer(data, np.uint8, offset=at)
        if len(raster) < row * height:
            raise BadImage("the raster is too short")
        flat = np.unpackbits(raster[: row * height].reshape(height, row), axis=1)[:, :width].ravel()
    else:
        step = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
        if len(data) - at < count * step.itemsize:
            raise BadImage("the raster is too short")
        flat = np.frombuffer(data, step, count, at)
    if bitmap:
        flat = flat.astype(np.uint8, copy=False)
        np.subtract(1, flat, out=flat)
        flat *= 255
    elif flat.max() > top:
        raise BadImage("a sample is over the maximum")
    elif top not in (255, 65535):  # samples fill their type
        flat = np.rint(np.arange(top + 1) * ((255 if top < 256 else 65535) / top)).astype(np.uint16)[flat]
    return flat.astype(np.uint8 if top < 256 else np.uint16, copy=False).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as height x width x 3 (RGB), uint8."""
    if len(data) < 54:
        raise BadImage("the header is too short")
    start, head, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise BadImage("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if bits < 24 and rows * width * 3 > MOST_SPREAD:
        raise BadImage("too many samples for this format")
    if len(data) - start < stride * rows:
        raise BadImage("the raster is too short")
    raster = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        pixel = raster[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = raster[:, :width]
        else:
            per = 8 // bits
            spread = (raster[:, :, None] >> (8 - bits * (np.arange(per) + 1)).astype(np.uint8)) & np.uint8((1 << bits) - 1)
            index = spread.reshape(rows, -1)[:, :width]
        if index.max(initial=0) >= used:
            raise BadImage("a colour is not in the palette")
        pixel = palette[index]
    return pixel[::-1] if height > 0 else pixel


def decode(data: bytes) -> np.ndarray:
    """An image of either format, height x width x channels.  Whatever is wrong with the bytes is a BadImage."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except BadImage:
        raise
    except (ValueError, IndexError, OverflowError, struct.error) as why:
        raise BadImage(f"malformed: {why}") from why
    raise BadImage("neither Netpbm nor BMP")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Height x width x 3 (P6) or x 1 (P5) samples of 8 bits, without loss."""
    height, width, channels = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(pixels).tobytes()


def _between(total: np.ndarray, parts: int, size: int, first: int) -> np.ndarray:
    """``parts`` times the sums between neighbouring cuts of a length ``size`` into equal parts, of a piece that begins at ``first``.

    total: the piece's running sums.  Cuts inside a sample are interpolated; all numbers stay whole.
    """
    n = len(total) - 1
    cuts = np.clip(np.arange(parts + 1) * size - first * parts, 0, n * parts)
    low = np.minimum(cuts // parts, n - 1)
    rest = (cuts - low * parts).reshape(-1, *[1] * (total.ndim - 1))
    return np.diff(total[low] * (parts - rest) + total[low + 1] * rest, axis=0)


def area_resize(pixels: np.ndarray, height: int, width: int, side: int = 512) -> np.ndarray:
    """Means over equal areas, height x width x channels, float64, from integral images interpolated at the cuts.

    Pieces of side x side pixels have an integral image each, so memory doesn't grow with the image; sums are exact.
    """
    h, w, c = pixels.shape
    out = np.zeros((height, width, c), dtype=np.int64)
    for y in range(0, h, side):
        for x in range(0, w, side):
            piece = pixels[y : y + side, x : x + side]
            total = np.zeros((piece.shape[0] + 1, piece.shape[1] + 1, c), dtype=np.int64)
            np.cumsum(np.cumsum(piece, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
            rows = _between(total, height, h, y)
            out += _between(rows.swapaxes(0, 1), width, w, x).swapaxes(0, 1)
    return out / (h * w)


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel: the mean of the colours."""
    return pixels.mean(axis=2, keepdims=True)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 grey means is below its right neighbour's."""
    small = grey(area_resize(pixels, 8, 9))[:, :, 0]
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(values: np.ndarray) -> bytes:
    """The bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def tiles(pixels: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of the tiles of at most side x side pixels that cover an image."""
    h, w, _ = pixels.shape
    return [(i // side, j // side, npy(np.ascontiguousarray(pixels[i : i + side, j : j + side]))) for i in range(0, h, side) for j in range(0, w, side)]


TILE_SCHEMA = T.StructType(
    [T.StructField("media_id", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("dhash", T.StringType()),
     T.StructField("tile_row", T.IntegerType()), T.StructField("tile_column", T.IntegerType()), T.StructField("npy", T.BinaryType()), T.StructField("error", T.StringType())]
)


def _thumbnail(pixels: np.ndarray, size: int) -> np.ndarray:
    """size x size means of 8 bits."""
    return np.rint(area_resize(pixels, size, size) / (1 if pixels.dtype == np.uint8 else 257)).astype(np.uint8)


def _bounded(rows: Iterator[tuple], schema: T.StructType | pa.Schema, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most about ``most`` bytes of binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


TILE_ARROW = pa.schema(
    [("media_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tile_row", pa.int32()), ("tile_column", pa.int32()), ("npy", pa.binary()), ("error", pa.string())]
)


def media_tiles(media: DataFrame, id_column: str = "media_id", data_column: str = "data", size: int = 64, side: int = 32) -> DataFrame:
    """A row for each NPY tile of each image, resized to ``size`` x ``size`` (uint8, rounded) and cut to ``side``.

    An image that can't be decoded, or null or empty bytes, give one row whose ``error`` says why and whose other columns
    but media_id are null.  height and width are those of the stored image; dhash is taken from it too.  Null ids are kept;
    repeated rows give their tiles each, equal bytes equal tiles; other columns are ignored; an empty table stays empty.
    """
    small_batches(media.sparkSession)

    def tiled(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise BadImage("null")
                    pixels = decode(data.as_buffer().to_pybytes())
                    own = (key, *pixels.shape[:2], difference_hash(pixels))
                    yield from [(*own, i, j, tile, None) for i, j, tile in tiles(_thumbnail(pixels, size), side)]
                except BadImage as why:
                    yield (key, *[None] * 6, str(why))

    own = media.selectExpr(f"cast(`{id_column}` as long) media_id", f"cast(`{data_column}` as binary) data")
    return own.mapInArrow(lambda batches: _bounded(tiled(batches), TILE_ARROW), TILE_SCHEMA)


def write_tiles(tiles_: DataFrame, path: str) -> None:
    """Append the tiles to a table of NPY files at ``path``: a row is one file, in its column ``npy``; failed images are under error=true.

    A store of billions of tiles is a table, not billions of small files; ``read_tile`` gives the array of a row.
    """
    tiles_.withColumn("failed", F.col("error").isNotNull()).write.mode("append").partitionBy("failed").parquet(path)


def read_tile(data: bytes) -> np.ndarray:
    """The array of an NPY file's bytes."""
    return np.load(io.BytesIO(data), allow_pickle=False)


#: Samples of one image row of a stored text: 192 pixels of three.
ROW = 576


MEDIA_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tile", pa.binary())])


def text_media(texts: DataFrame, thumbnail: int = 16) -> DataFrame:
    """(doc_id, n_bytes, media, tile): whole texts (null: empty) as P6 images, and each image's thumbnail as one NPY tile.

    Images are 192 pixels wide and padded with 255 to whole rows, at least one.  Null and repeated ids are kept as they
    are, equal texts give equal images; other columns are ignored; an empty table stays empty.
    """
    small_batches(texts.sparkSession)

    def stored(batches):
        for batch in batches:
            data, offsets, _ = tk.text_buffers(batch.column(1))
            for key, s, e in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                samples = np.full(max(1, -(-(e - s) // ROW)) * ROW, 255, dtype=np.uint8)
                samples[: e - s] = data[s:e]
                pixels = samples.reshape(-1, ROW // 3, 3)
                yield key, e - s, encode_ppm(pixels), npy(_thumbnail(pixels, thumbnail))

    own = texts.selectExpr("cast(doc_id as long) doc_id", "text")
    return own.mapInArrow(lambda batches: _bounded(stored(batches), MEDIA_ARROW), "doc_id long, n_bytes long, media binary, tile binary")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: sizes, checksums and the difference hash of each image, and its tile's checksum.

    media: (doc_id, n_bytes, media, tile).  ``feature`` is the difference hash; ``tile_shape`` is that of the array in the
    NPY tile.  Rows come back one for one, whatever their ids; equal bytes give equal values.  Stored bytes that can't be
    decoded are an error: the store is damaged.
    """
    small_batches(media.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_shape", "tile_sha256"]

    def rows(batches):
        for batch in batches:
            out = []
            for item, tile in zip(batch.column(2), batch.column(3), strict=True):
                stored, tile = item.as_buffer().to_pybytes(), tile.as_buffer().to_pybytes()
                pixels = decode(stored)
                payload = np.ascontiguousarray(pixels).tobytes()
                shape = "x".join(map(str, read_tile(tile).shape))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(pixels), shape, hashlib.sha256(tile).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media", "tile").mapInArrow(
        rows,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, tile_shape string, tile_sha256 string",
    )
