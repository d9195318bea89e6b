"""Raster timing files (XML) as pixels with their time of dwell."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

PIXELS = "x int, y int, t_start double, t_end double, abs_start double, abs_end double"
#: Pixels handed on at once.
BATCH = 20_000
# Spellings of length units.
UNITS = {"mm": "mm", "millimeter": "mm", "millimetre": "mm", "um": "um", "µm": "um", "μm": "um", "micrometer": "um", "micrometre": "um", "micron": "um"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def start_seconds(text: str) -> float:
    """Seconds since 1970 of an ISO time with an offset or Z."""
    return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()


class Raster:
    """One file, read from front to back. info is complete once all pixels have been taken.

    Times are seconds: a pixel's offset and its image's timeShift, both in
    milliseconds, from the start of the raster; abs_* from 1970. A file without
    a start time or an <image> element is refused; the elements may have any
    namespace or none.
    """

    def __init__(self, path: str):
        self.path = path
        self.info: dict = dict.fromkeys(("width", "height", "raster_start", "pixel_size_x", "pixel_size_y", "pixel_size_unit"))

    def pixels(self) -> Iterator[tuple]:
        root, image, start, shift = None, None, None, 0.0
        units: dict[str, str | None] = {}
        with open(self.path, "rb") as f:
            for event, e in ET.iterparse(f, events=("start", "end")):
                name = _local(e.tag)
                if event == "start":
                    if root is None:
                        root = e
                        if not e.attrib.get("startTime"):
                            raise ValueError(f"{self.path}: no start time")
                        start = self.info["raster_start"] = start_seconds(e.attrib["startTime"])
                    elif name == "image" and image is None:
                        image, shift = e, float(e.attrib.get("timeShift", 0.0))
                        self.info["width"], self.info["height"] = int(e.attrib["width"]), int(e.attrib["height"])
                    continue
                if name == "pixel" and image is not None:
                    begin = (float(e.attrib["offset"]) + shift) / 1000.0
                    end = begin + float(e.attrib["duration"]) / 1000.0
                    yield int(e.attrib["x"]), int(e.attrib["y"]), begin, end, start + begin, start + end
                    # What has been read is let go, so a file of any size fits.
                    image.clear()
                elif name in ("spacingX", "spacingY") and e.text and e.text.strip():
                    self.info["pixel_size_x" if name == "spacingX" else "pixel_size_y"] = float(e.text)
                    units[name] = UNITS.get((e.attrib.get("units") or "").strip().lower())
        if image is None:
            raise ValueError(f"{self.path}: no image")
        self.info["pixel_size_unit"] = units.get("spacingX") or units.get("spacingY")


def parse(path: str) -> tuple[list[tuple], dict]:
    """(pixels, info) of one file: width, height, raster_start, pixel_size_x, pixel_size_y, pixel_size_unit (um, mm or None)."""
    raster = Raster(path)
    return list(raster.pixels()), raster.info


def pixels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sample_path, pixel_id (from 1 in the file's order) and the pixels of each file; a file (one slide) is read by one task, as a stream."""

    def read(frames):
        import pandas as pd

        for frame in frames:
            for path in frame["path"]:
                held: list[tuple] = []
                n = 0
                for p in Raster(path).pixels():
                    n += 1
                    held.append((path, n, *p))
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    names = ["sample_path", "pixel_id", "x", "y", "t_start", "t_end", "abs_start", "abs_end"]
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInPandas(read, "sample_path string, pixel_id bigint, " + PIXELS)
