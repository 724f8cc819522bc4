"""Media columns: progressive JPEG files in a binary column, read back as full-resolution RGB tensors.

The writer stores bytes without loss in the format's own unit, the quantised coefficient: 192 bytes are one
8 x 8 block of each of three components, in zigzag order, less ``BIAS`` so that common letters are small. The
reader accumulates a file's scans into coefficients, from which the bytes come back exactly, and turns the
same coefficients into samples, chroma upsampled, and an RGB tensor.

A task holds the files of about ``BATCH`` bytes at a time; a longer text is a batch of its own, so memory
follows the longest text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm import jpeg
from hornfels.llm.common import crc, free_names, read_table

#: Bytes that a unit of the payload has, and the byte that fills it up.
UNIT, FILL = 192, b"\x20"
BIAS, BATCH = 96, 1_500_000
#: Pixels of the largest image that ``tensors`` decodes by default: a header of a few bytes can claim 2^32.
PIXELS = 1 << 27


def payload(data: bytes) -> bytes:
    return data + FILL * (-len(data) % UNIT if data else UNIT)


def write_files(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload (a positive multiple of UNIT); its comment says how many units it has."""
    units = [len(p) // UNIT for p in payloads]
    grids = [(w := math.isqrt(n - 1) + 1, -(-n // w)) for n in units]
    filled = b"".join(p + bytes([BIAS]) * (UNIT * (w * h - n)) for p, n, (w, h) in zip(payloads, units, grids, strict=True))
    coef = np.frombuffer(filled, np.uint8).astype(np.int16).reshape(-1, 3, 64) - BIAS
    return jpeg.encode(grids, coef, [b"units %d" % n for n in units])


def read_files(files: list[bytes], payloads: bool = True) -> Iterator[tuple[bytes, np.ndarray]]:
    """Payload (of a file that ``write_files`` made) and RGB tensor of each file."""
    images, coef = jpeg.decode(files)
    plain = all(c.h == c.v == 1 for i in images for c in i.components) and all((q == 1).all() for i in images for q in i.quant.values())
    samples = jpeg.inverse(coef, np.ones(64, np.float32)) if plain else None
    for image in images:
        stored = b""
        if payloads:
            units = int(image.comment.split()[1])
            parts = [coef[c.base : c.base + units] for c in image.components]
            stored = (np.stack(parts, 1) + BIAS).astype(np.uint8).tobytes()
        own = (lambda c: samples[c.base : c.base + c.stride * c.rows]) if plain else None
        yield stored, jpeg.rgb(image, coef, own)


def batches_of(sizes: list[int], most: int = BATCH) -> Iterator[slice]:
    start, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def with_media(docs: DataFrame, column: str = "media", text: str = "text") -> DataFrame:
    """``docs`` with a file of each whole text in ``column``; null text counts as empty and has a file of one unit.

    The new column has underscores behind its name where ``docs`` has it.
    """

    def write(texts: pd.Series) -> pd.Series:
        data = [payload((t or "").encode("utf-8")) for t in texts]
        return pd.Series([f for s in batches_of(list(map(len, data))) for f in write_files(data[s])], dtype=object)

    return docs.withColumn(*free_names(docs.columns, column), F.pandas_udf(write, "binary")(F.col(text)))


def readable(files: list[bytes | None], payloads: bool, most: int | None = None) -> Iterator[tuple[bytes, np.ndarray] | str | None]:
    """What ``read_files`` gives of each file, or why it can't be read; null of null. One bad file spoils no other."""
    sound: list[bytes] = []
    problems: list[str | None] = []
    for f in files:
        problems.append(None if f is None else "")
        if f is not None:
            try:
                image = jpeg.parse(f)
                if not image.components or not image.width * image.height:
                    raise ValueError("no image")
                if most is not None and image.width * image.height > most:
                    raise ValueError(f"{image.width * image.height} pixels")
                sound.append(f)
            except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError) as e:
                problems[-1] = f"{type(e).__name__}: {e}"
    try:
        done: Iterator = iter(list(read_files(sound, payloads))) if sound else iter(())
    except (ValueError, IndexError, KeyError, TypeError, AttributeError):
        done = (_alone(f, payloads) for f in sound)
    for p in problems:
        yield next(done) if p == "" else p


def _alone(file: bytes, payloads: bool) -> tuple[bytes, np.ndarray] | str:
    try:
        return next(read_files([file], payloads))
    except (ValueError, IndexError, KeyError, TypeError, AttributeError) as e:
        return f"{type(e).__name__}: {e}"


def _with_read(media: DataFrame, column: str, made: str, of: Callable[[bytes, tuple[bytes, np.ndarray]], tuple], payloads: bool, most: int | None, drop: bool) -> DataFrame:
    """``media`` with the columns ``made`` of each file and ``problem``, which says why they are null."""
    names = [c.split()[0] for c in made.split(", ")]

    def read(files: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for s in batches_of([len(f) if f is not None else 0 for f in files]):
            own = [bytes(f) if f is not None else None for f in files.iloc[s]]
            for f, x in zip(own, readable(own, payloads, most), strict=True):
                rows.append((*of(f, x), None) if isinstance(x, tuple) else (*[None] * len(names), x))
        out = pd.DataFrame(rows, columns=[*names, "problem"], dtype=object)
        return out.astype({c.split()[0]: "Int64" if c.endswith("long") else "Int32" for c in made.split(", ") if c.endswith((" long", " int"))})

    left = [c for c in media.columns if not drop or c != column]
    out = media.select(*[F.col(f"`{c}`") for c in left], F.pandas_udf(read, f"{made}, problem string")(F.col(column)).alias("_read of files"))
    return out.select(*[F.col(f"`{c}`") for c in left], *[F.col(f"`_read of files`.{n}").alias(m) for n, m in zip([*names, "problem"], free_names(left, *names, "problem"), strict=True)])


def tensors(media: DataFrame, column: str = "media", most: int = PIXELS) -> DataFrame:
    """``media`` with height, width and tensor (height x width x 3 bytes) of each file.

    A null file has nulls; so has one that is malformed, cut off, not progressive or above ``most`` pixels, and
    ``problem`` says why. New columns have underscores behind their names where ``media`` has them.
    """
    return _with_read(media, column, "height int, width int, tensor binary", lambda _, x: (x[1].shape[0], x[1].shape[1], x[1].tobytes()), False, most, False)


def feature(x: np.ndarray) -> str:
    """Shape, mean of each channel in thousandths, and checksum of a tensor."""
    means = x.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (x.shape[0] * x.shape[1])
    return f"{x.shape[1]}x{x.shape[0]} rgb {means[0]},{means[1]},{means[2]} crc {crc(x.tobytes()):08x}"


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame, column: str = "media") -> DataFrame:
    """What op3 reports, all from the stored bytes; other columns of ``media`` stay, nulls and problems as in ``tensors``."""

    def of(f: bytes, x: tuple[bytes, np.ndarray]) -> tuple:
        stored, tensor = x
        return len(stored), hashlib.sha256(stored).hexdigest(), crc(stored[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(tensor)

    return _with_read(media, column, _DIGEST, of, True, None, True)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return digests(with_media(docs.withColumn("n_bytes", size)).drop("text"))
