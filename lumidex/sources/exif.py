"""Capture facts from the EXIF block of a JPEG, TIFF or PNG file, read from its bytes."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pyarrow as pa

# Fixed values of the EXIF standard: the fields that are read, and bytes of each type of value.
MAKE, MODEL, ORIENTATION, CHANGED, EXIF_IFD, ISO, TAKEN = 271, 272, 274, 306, 34665, 34855, 36867
EXPOSURE, F_NUMBER, SHUTTER, FOCAL, MODE, LENS = 33434, 33437, 37377, 37386, 41986, 42036
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_WHOLE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
_REAL = {11: "f", 12: "d"}
_TIMES = ("%Y:%m:%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y:%m:%d")
#: The facts with their types, for Spark and for Arrow.
_TYPES = {"make": "string", "model": "string", "iso": "int", "orientation": "int", "taken_at": "timestamp_ntz", "exposure_time": "double", "f_number": "double", "shutter_speed": "double", "focal_length": "double", "exposure_mode": "int", "lens": "string"}
FACTS = "struct<" + ",".join(f"{k}:{t}" for k, t in _TYPES.items()) + ">"
ARROW = pa.struct([(k, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}[t]) for k, t in _TYPES.items()])


def block(data: bytes) -> bytes | None:
    """The TIFF structure with the EXIF fields, if the file has one."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data  # offsets count from the file's start
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return next((body for kind, body in _png_chunks(data) if kind == b"eXIf"), None)
    if data[:2] == b"\xff\xd8":
        return next((body[6:] for mark, body in _jpeg_segments(data) if mark == 0xE1 and body[:6] == b"Exif\0\0"), None)
    return None


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # padding
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # marks without a body
            at += 2
        elif mark in (0xD9, 0xDA):  # the picture itself
            return
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            yield mark, data[at + 4 : at + 2 + size]
            at += 2 + max(2, size)


def _fields(tiff: bytes, order: str, at: int) -> dict[int, object]:
    """Whole numbers and texts of one directory; values that lie outside the block are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(tiff):
        return out
    for n in range(struct.unpack_from(order + "H", tiff, at)[0]):
        here = at + 2 + 12 * n
        if here + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, here)
        size = _BYTES.get(kind, 0) * count
        place = here + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, here + 8)[0]
        if not size or place + size > len(tiff):
            continue
        if kind == 2:
            out[tag] = tiff[place : place + size].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in _WHOLE:
            out[tag] = struct.unpack_from(order + _WHOLE[kind], tiff, place)[0]
        elif kind in (5, 10):
            top, bottom = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, place)
            out[tag] = top / bottom if bottom else None
        elif kind in _REAL:
            out[tag] = struct.unpack_from(order + _REAL[kind], tiff, place)[0]
    return out


def _time(value: object) -> datetime.datetime | None:
    for form in _TIMES:
        try:
            return datetime.datetime.strptime(value, form) if isinstance(value, str) else None
        except ValueError:
            pass
    return None


def capture_facts(data: bytes) -> dict:
    """The facts of ``FACTS`` from a file's bytes; what is missing or cannot be read is empty or None.

    Exposure and shutter speed, aperture and focal length are numbers as they stand in the block.
    """
    fields: dict[int, object] = {}
    tiff = block(data)
    if tiff is not None and len(tiff) >= 8 and tiff[:2] in (b"II", b"MM"):
        order = "<" if tiff[:2] == b"II" else ">"
        fields = _fields(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        deeper = fields.get(EXIF_IFD)
        if isinstance(deeper, int):
            fields = _fields(tiff, order, deeper) | fields
    text = lambda tag: fields[tag] if isinstance(fields.get(tag), str) else ""
    measured = lambda tag: float(fields[tag]) if isinstance(fields.get(tag), (int, float)) else None
    number = lambda tag: int(fields[tag]) if isinstance(fields.get(tag), (int, float)) and 0 < fields[tag] < 2**31 else None
    mode = fields.get(MODE)
    return {
        "make": text(MAKE),
        "model": text(MODEL),
        "iso": number(ISO),
        "orientation": number(ORIENTATION),
        "taken_at": _time(fields.get(TAKEN)) or _time(fields.get(CHANGED)),
        "exposure_time": measured(EXPOSURE),
        "f_number": measured(F_NUMBER),
        "shutter_speed": measured(SHUTTER),
        "focal_length": measured(FOCAL),
        "exposure_mode": mode if isinstance(mode, int) and abs(mode) < 2**31 else None,
        "lens": text(LENS),
    }


def upright_steps(orientation: int | None) -> tuple[bool, int]:
    """Whether rows are to be mirrored left to right first, and by how many quarters then turned (counter-clockwise), to stand upright."""
    return {2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 1), 6: (False, 3), 7: (True, 3), 8: (False, 1)}.get(orientation or 1, (False, 0))
