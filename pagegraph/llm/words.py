"""Words over UTF-8 bytes.

Texts are lower-cased for A-Z only. A word is a run of digits, a-z and any
non-ASCII character, so working on bytes gives the same words as working on
code points. Null is the empty text.
"""

from __future__ import annotations

import pyarrow as pa


def _fold() -> bytes:
    t = bytearray(b" " * 256)
    for c in range(256):
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            t[c] = c
        elif 65 <= c <= 90:
            t[c] = c + 32
    return bytes(t)


FOLD = _fold()

#: Characters that are neither white space (space, tab to carriage return) nor A-Z keep their value.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def spaced(text: bytes) -> list[bytes]:
    """Lower-cased runs of anything but space, tab, newline, VT, FF and CR."""
    return [w for w in text.translate(LOWER).split(b" ") if w]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as bytes; null becomes b''."""
    col = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in col.cast(pa.string() if pa.types.is_null(col.type) else col.type).cast(pa.binary()).to_pylist()]
