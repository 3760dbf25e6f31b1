"""Image kernels over rasters (IMG): luminance, contrast stretch with whitening, sharpening. Numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of red, green and blue in luminance; sides from which an image is sharpened, and by how much.
LUMA, SHARP_SIDE, SHARP = np.array([0.299, 0.587, 0.114]), 400, 0.35


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., :3].astype(np.float64) @ LUMA


def sampled_range(pixels: np.ndarray) -> tuple[float, float, float]:
    """(mean, least, greatest) luminance of every n-th pixel, of about ten thousand."""
    flat = pixels.reshape(-1, pixels.shape[-1])
    luma = luminance(flat[:: max(1, flat.size // flat.shape[1] * 4 // 40000)])
    return (float(luma.mean()), float(luma.min()), float(luma.max())) if len(luma) else (0.0, 255.0, 0.0)


def stretched(pixels: np.ndarray) -> np.ndarray:
    """Ink darker, paper white, and a mild curve between; colours keep their proportions, near-white becomes white."""
    _, least, greatest = sampled_range(pixels)
    black, white = min(65.0, max(20.0, least + 15)), max(185.0, min(245.0, greatest - 10))
    luma = luminance(pixels)
    t = (luma - black) / max(1.0, white - black)
    curve = np.where(t < 0.5, 2 * t * t, 1 - (2 - 2 * t) ** 2 / 2) * 255
    new = np.where(luma <= black, luma * 0.7, np.where(luma >= white, 255.0, np.clip(curve, 0, 255)))
    ratio = np.divide(new, luma, out=np.zeros_like(new), where=luma > 0)
    out = pixels.copy()
    out[..., :3] = np.clip(np.floor(pixels[..., :3] * ratio[..., None] + 0.5), 0, 255).astype(np.uint8)
    out[new > 240, :3] = 255
    return out


def sharpened(pixels: np.ndarray, amount: float = SHARP) -> np.ndarray:
    """Unsharp mask with a Gaussian of one pixel, of images above the side limit and of pixels that aren't near white."""
    if min(pixels.shape[:2]) <= SHARP_SIDE:
        return pixels
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    kernel /= kernel.sum()
    rgb = pixels[..., :3].astype(np.float64)
    blurred = rgb
    for axis in (0, 1):
        padded = np.pad(blurred, [(3, 3) if k == axis else (0, 0) for k in range(3)], mode="edge")
        blurred = sum(w * np.take(padded, range(k, k + rgb.shape[axis]), axis=axis) for k, w in enumerate(kernel))
    out = pixels.copy()
    sharp = np.clip(rgb + (rgb - blurred) * amount, 0, 255)
    dark = (rgb < 240).any(axis=-1)
    out[dark, :3] = np.floor(sharp[dark] + 0.5).astype(np.uint8)
    return out


def is_aged(least: Column, greatest: Column) -> Column:
    """A scan of an aged page: no real black, no real white, or little between."""
    return (least > 30) | (greatest < 225) | (greatest - least < 170)


def enhance(df: DataFrame) -> DataFrame:
    """`df` of Spark's image source (a struct `image`) with enhanced data, and min_luma, max_luma, aged. A raster that can't be read stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, low, high = [], [], []
            for r in batch.to_pylist():
                try:
                    px = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                    rgb = px[..., ::-1] if r["nChannels"] == 3 else px[..., [2, 1, 0, 3]] if r["nChannels"] == 4 else np.repeat(px, 3, axis=2)
                    _, a, b = sampled_range(rgb)
                    new = sharpened(stretched(rgb))
                    back = new[..., ::-1] if r["nChannels"] == 3 else new[..., [2, 1, 0, 3]] if r["nChannels"] == 4 else new[..., :1]
                    data.append(np.ascontiguousarray(back).tobytes())
                except (ValueError, IndexError, TypeError):
                    a, b = None, None
                    data.append(r["data"])
                low.append(a)
                high.append(b)
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(data, pa.binary())).append_column("min_luma", pa.array(low, pa.float64())).append_column("max_luma", pa.array(high, pa.float64()))

    flat = df.select("image.*")
    schema = ", ".join(f"`{n}` {t}" for n, t in flat.dtypes) + ", min_luma double, max_luma double"
    return flat.mapInArrow(run, schema).withColumn("aged", is_aged(F.col("min_luma"), F.col("max_luma")))


def luma_of_arrays(values: Column) -> Column:
    """Sum, least and greatest of an array of luminances, JVM-side."""
    return F.struct(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.array_min(values).cast("double").alias("least"), F.array_max(values).cast("double").alias("greatest"))
