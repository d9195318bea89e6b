"""mzML scan files as a Spark data source (format "mzml").

    spark.dataSource.register(MzmlSource)
    spark.read.format("mzml").load("/data/*.mzML")

A file is cut into byte ranges; a range yields the spectra that begin in it, so
one large file is read by many tasks. Columns a query does not use are not
decoded when ``arrays`` is "false".
"""

from __future__ import annotations

import base64
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ionloom.sources.files import listed, opened

SCHEMA = (
    "file_name string, position bigint, scan_id bigint, native_id string, ms_level int, parent_scan_id bigint, polarity string, rt double, filter_string string, precursor_mz double, precursor_charge int, precursor_intensity double, "
    "isolation_window_target double, isolation_window_lower double, isolation_window_upper double, collision_energy double, tic double, n_peaks int, mz_min double, mz_max double, mz array<float>, intensity array<float>"
)
# Accessions of the controlled vocabulary that are read.
CV = {
    "level": "MS:1000511", "rt": "MS:1000016", "positive": "MS:1000130", "negative": "MS:1000129", "filter": "MS:1000512", "tic": "MS:1000285",
    "selected_mz": "MS:1000744", "charge": "MS:1000041", "peak_intensity": "MS:1000042", "target": "MS:1000827", "lower": "MS:1000828", "upper": "MS:1000829", "energy": "MS:1000045",
    "mz_array": "MS:1000514", "intensity_array": "MS:1000515", "float64": "MS:1000523", "float32": "MS:1000521", "zlib": "MS:1000574", "profile": "MS:1000128", "minute": "UO:0000031",
}
_OPEN = re.compile(rb"<spectrum[\s>]")
_ATTR = re.compile(r'([\w:]+)\s*=\s*"([^"]*)"')
_BINARY = re.compile(r"<binaryDataArray[\s>].*?</binaryDataArray>", re.S)


def cv_params(text: str) -> dict[str, dict[str, str]]:
    """Attributes of each cvParam by accession; of repeated ones the first."""
    out: dict[str, dict[str, str]] = {}
    for m in re.finditer(r"<cvParam\b([^>]*)>", text):
        attrs = dict(_ATTR.findall(m.group(1)))
        out.setdefault(attrs.get("accession", ""), attrs)
    return out


def _number(params: dict, key: str, kind=float):
    try:
        return kind(params[CV[key]]["value"])
    except (KeyError, ValueError):
        return None


def scan_number(native: str | None) -> int | None:
    m = re.search(r"scan=(\d+)", native or "")
    return int(m.group(1)) if m else None


def decode_array(text: str) -> tuple[str | None, np.ndarray | None]:
    """("mz" or "intensity", values rounded to four decimals as singles); None for what cannot be decoded."""
    params = cv_params(text)
    name = "mz" if CV["mz_array"] in params else "intensity" if CV["intensity_array"] in params else None
    body = re.search(r"<binary>(.*?)</binary>", text, re.S)
    if name is None or body is None:
        return None, None
    try:
        data = base64.b64decode(body.group(1))
        if CV["zlib"] in params and data:
            data = zlib.decompress(data)
        values = np.frombuffer(data, "<f8" if CV["float64"] in params else "<f4")
    except (ValueError, zlib.error):
        return None, None
    return name, np.round(values.astype(float), 4).astype(np.float32)


def parse_spectrum(text: str, arrays: bool = True) -> dict | None:
    """Values of one <spectrum> element; None without a retention time or for levels other than 1 and 2."""
    head = dict(_ATTR.findall(text[: text.index(">")]))
    first_array = text.find("<binaryDataArrayList")
    plain = text if first_array < 0 else text[:first_array]
    params = cv_params(plain)
    level, rt = _number(params, "level", int), _number(params, "rt")
    if level not in (1, 2) or rt is None:
        return None
    if params[CV["rt"]].get("unitAccession") == CV["minute"] or params[CV["rt"]].get("unitName") == "minute":
        rt *= 60.0
    reference = re.search(r'<precursor\b[^>]*spectrumRef\s*=\s*"([^"]*)"', plain)
    out = {
        "native_id": head.get("id"), "scan_id": scan_number(head.get("id")), "ms_level": level, "rt": rt,
        "parent_scan_id": scan_number(reference.group(1)) if reference else None,
        "polarity": "POSITIVE" if CV["positive"] in params else "NEGATIVE" if CV["negative"] in params else None,
        "filter_string": params.get(CV["filter"], {}).get("value"), "precursor_mz": _number(params, "selected_mz"), "precursor_charge": _number(params, "charge", int),
        "precursor_intensity": _number(params, "peak_intensity"), "isolation_window_target": _number(params, "target"), "isolation_window_lower": _number(params, "lower"),
        "isolation_window_upper": _number(params, "upper"), "collision_energy": _number(params, "energy"), "tic": _number(params, "tic"),
        "is_profile": CV["profile"] in params,
    }
    if arrays and first_array >= 0:
        for m in _BINARY.finditer(text, first_array):
            name, values = decode_array(m.group())
            if name:
                out[name] = values
    return out


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def spectra(path: str, begin: int = 0, end: int | None = None, chunk: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(byte position, text) of the <spectrum> elements that begin within the range."""
    with opened(path) as f:
        f.seek(begin)
        held, at = b"", begin
        while True:
            data = f.read(chunk)
            held += data
            while True:
                m = _OPEN.search(held)
                if not m:
                    # A tag cut by the chunk's end may begin in the last few bytes.
                    keep = min(len(held), 16)
                    at += len(held) - keep
                    held = held[len(held) - keep :]
                    break
                position = at + m.start()
                if end is not None and position >= end:
                    return
                close = held.find(b"</spectrum>", m.start())
                if close < 0:
                    break
                close += len(b"</spectrum>")
                yield position, held[m.start() : close].decode("utf-8", "replace")
                held, at = held[close:], at + close
            if not data:
                return
            if end is not None and at >= end and not _OPEN.search(held):
                return


class MzmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.arrays = options["path"], options.get("arrays", "true") == "true"
        self.size = int(options.get("maxPartitionBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.path.split(",") for f in listed(p, ".mzML")]
        if not files:
            raise FileNotFoundError(self.path)
        return [_Range(p, lo, min(lo + self.size, size)) for p, size in files for lo in range(0, max(1, size), self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for position, text in spectra(partition.path, partition.begin, partition.end):
            s = parse_spectrum(text, self.arrays)
            if s is None:
                continue
            if s["is_profile"]:
                raise ValueError(f"{partition.path} holds profile spectra; centroid it first")
            mz, intensity = s.get("mz"), s.get("intensity")
            n = None if mz is None else len(mz)
            some = n is not None and n > 0
            yield (
                partition.path.rpartition("/")[2], position, s["scan_id"], s["native_id"], s["ms_level"], s["parent_scan_id"], s["polarity"], s["rt"], s["filter_string"], s["precursor_mz"], s["precursor_charge"], s["precursor_intensity"],
                s["isolation_window_target"], s["isolation_window_lower"], s["isolation_window_upper"], s["collision_energy"], s["tic"], n, float(mz.min()) if some else None, float(mz.max()) if some else None,
                None if mz is None else mz.tolist(), None if intensity is None else intensity.tolist(),
            )


class MzmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MzmlReader(self.options)


def last_of_each_scan(df: DataFrame) -> DataFrame:
    """Of scans with one number in a file the last counts."""
    rest = [c for c in df.columns if c not in ("file_name", "scan_id")]
    best = df.groupBy("file_name", "scan_id").agg(F.max_by(F.struct(*rest), "position").alias("_r"))
    return best.select(*[F.col(c) if c in ("file_name", "scan_id") else F.col(f"_r.{c}").alias(c) for c in df.columns])


def instrument_info(path: str) -> dict[str, str]:
    """Header values of a file: model, serial number, ionization, analyzer, start time, source file, as far as they are given. Read up to the list of spectra."""
    text = ""
    with opened(path) as f:
        for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace"):
            head, cut, _ = line.partition("<spectrumList")
            text += head
            if cut:
                break
    out = {}
    for name, pattern in (("acquisition_start", r'startTimeStamp\s*=\s*"([^"]*)"'), ("source_file", r'<sourceFile\b[^>]*\bname\s*=\s*"([^"]*)"'), ("serial_number", r'accession="MS:1000529"[^>]*value="([^"]*)"')):
        m = re.search(pattern, text)
        if m:
            out[name] = m.group(1)
    for name, tag in (("ionization", "source"), ("analyzer", "analyzer")):
        m = re.search(rf"<{tag}\b[^>]*>\s*<cvParam\b[^>]*\bname=\"([^\"]*)\"", text)
        if m:
            out[name] = m.group(1)
    m = re.search(r'<(?:instrumentConfiguration|referenceableParamGroup)\b[^>]*>\s*<cvParam\b[^>]*\bname="([^"]*)"', text)
    if m:
        out["instrument_model"] = m.group(1)
    return out
