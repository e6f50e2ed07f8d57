"""A small reader of the EXIF fields that the catalog keeps."""

from __future__ import annotations

import struct

#: The tags that are read.
MAKE, MODEL, ORIENTATION, DATE_TIME, EXIF_IFD, ORIGINAL = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x9003


def _tiff(data: bytes) -> bytes | None:
    """The TIFF block of a JPEG's EXIF segment, or of a TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker in (0xDA, 0xD9) or size < 2:
            return None
        at += 2 + size
    return None


def _fields(block: bytes, order: str, start: int) -> dict[int, bytes | int]:
    """Text and whole-number fields of a directory."""
    out: dict[int, bytes | int] = {}
    (count,) = struct.unpack_from(order + "H", block, start)
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", block, start + 2 + 12 * i)
        place = start + 10 + 12 * i
        if kind == 2:
            at = place if n <= 4 else struct.unpack_from(order + "I", block, place)[0]
            out[tag] = block[at : at + n]
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), block, place)[0]
    return out


def read(data: bytes) -> dict[str, str | int | None]:
    """make, model, taken (the text of the original date, else of the date) and orientation; never raises on bad data."""
    none = {"make": None, "model": None, "taken": None, "orientation": None}
    try:
        block = _tiff(data)
        if not block:
            return none
        order = "<" if block[:2] == b"II" else ">"
        main = _fields(block, order, struct.unpack_from(order + "I", block, 4)[0])
        sub = _fields(block, order, main[EXIF_IFD]) if isinstance(main.get(EXIF_IFD), int) else {}
    except (struct.error, IndexError):
        return none

    def text(fields: dict, tag: int) -> str | None:
        raw = fields.get(tag)
        return (raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None) if isinstance(raw, bytes) else None

    orientation = main.get(ORIENTATION)
    return {"make": text(main, MAKE), "model": text(main, MODEL), "taken": text(sub, ORIGINAL) or text(main, DATE_TIME), "orientation": orientation if isinstance(orientation, int) else None}
