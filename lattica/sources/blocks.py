"""Block and image files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.schema import Grid


def write_blocks(packed: DataFrame, path: str, grid: Grid, mode: str = "errorifexists") -> None:
    """Packed blocks as Parquet, near blocks in the same files."""
    bx, by, bz = K.block_coords("bid", grid)
    keyed = packed.withColumn("morton", K.morton_key(bx, by, bz))
    keyed.repartitionByRange("morton").sortWithinPartitions("morton").write.mode(mode).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("bid", "data")


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "bid", mode: str = "errorifexists") -> None:
    """A table whose joins on the block key need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole binary files, one row each: (path, length, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


# --- image tiles ---------------------------------------------------------------------

def png_bytes(rgb: np.ndarray, row_filter: int = 0) -> bytes:
    """Encode rows of 8-bit RGB as PNG, all rows under one of the five row filters."""
    h, w, _ = rgb.shape

    def piece(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    rows = rgb.reshape(h, w, 3).astype(np.int16)
    up, left, corner = (np.zeros_like(rows) for _ in range(3))
    up[1:], left[:, 1:], corner[1:, 1:] = rows[:-1], rows[:, :-1], rows[:-1, :-1]
    guess = _predicted(row_filter, left, up, corner)
    raw = np.concatenate([np.full((h, 1), row_filter, np.uint8), (rows - guess).astype(np.uint8).reshape(h, w * 3)], axis=1).tobytes()
    return (b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + piece(b"IDAT", zlib.compress(raw, 6)) + piece(b"IEND", b""))


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a row filter takes a byte to be, from the bytes to the left, above and above left."""
    if kind == 0:
        return np.zeros_like(left)
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) // 2
    if kind == 4:
        # of the three the one nearest to left + up - corner, the first of equals
        p = left + up - corner
        by_left, by_up, by_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
    raise ValueError(f"no row filter {kind}")


def png_pixels(data: bytes) -> np.ndarray:
    """Decode an 8-bit RGB or RGBA PNG without interlacing; alpha is left out.

    A filter that looks left is undone along the row by a running sum, one that looks up for the
    whole row, and the two that mix both pixel by pixel.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, w, h, n = 8, b"", 0, 0, 3
    while at < len(data):
        (size,) = struct.unpack(">I", data[at:at + 4])
        tag, part = data[at + 4:at + 8], data[at + 8:at + 8 + size]
        if tag == b"IHDR":
            w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", part[:13])
            if depth != 8 or colour not in (2, 6) or woven:
                raise ValueError("only 8-bit RGB and RGBA without interlacing")
            n = 3 if colour == 2 else 4
        if tag == b"IDAT":
            body += part
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + n * w)
    kinds, out = rows[:, 0], rows[:, 1:].reshape(h, w, n).copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    # rows of one kind in a row go together where no row needs the one above
    y = 0
    while y < h:
        end = y + 1
        while end < h and kinds[end] == kinds[y]:
            end += 1
        if kinds[y] == 1:
            np.cumsum(out[y:end], axis=1, out=out[y:end], dtype=np.uint8)
        elif kinds[y] == 2:
            if y:
                out[y] += out[y - 1]
            np.cumsum(out[y:end], axis=0, out=out[y:end], dtype=np.uint8)
        elif kinds[y]:
            for k in range(y, end):
                above = out[k - 1].astype(np.int16) if k else np.zeros((w, n), np.int16)
                left = corner = np.zeros(n, np.int16)
                for x in range(w):
                    out[k, x] += _predicted(int(kinds[y]), left, above[x], corner).astype(np.uint8)
                    left, corner = out[k, x].astype(np.int16), above[x]
        y = end
    return out[:, :, :3]


def png_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """Pixels (x, y, r, g, b) as PNG tiles (tx, ty, png); a tile bounds what a task holds."""
    keyed = pixels.select(F.floor(F.col("x") / tile).cast("bigint").alias("tx"), F.floor(F.col("y") / tile).cast("bigint").alias("ty"), "x", "y", "r", "g", "b")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        img = np.zeros((tile, tile, 3), np.uint8)
        img[pdf["y"].to_numpy() - ty * tile, pdf["x"].to_numpy() - tx * tile] = pdf[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"tx": [tx], "ty": [ty], "png": [png_bytes(img)]})

    return keyed.groupBy("tx", "ty").applyInPandas(encode, "tx bigint, ty bigint, png binary")


def read_png_tiles(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles back to pixels."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tx, ty, png in zip(pdf["tx"], pdf["ty"], pdf["png"]):
                img = png_pixels(png)
                y, x = np.mgrid[0:tile, 0:tile]
                yield pd.DataFrame({"x": (x + tx * tile).ravel(), "y": (y + ty * tile).ravel(), **{c: img[..., i].ravel().astype(np.int32) for i, c in enumerate("rgb")}})
    return tiles.select("tx", "ty", "png").mapInPandas(decode, "x bigint, y bigint, r int, g int, b int")
