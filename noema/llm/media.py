"""Media columns: payloads stored losslessly as progressive JPEG, and RGB tensors and features of stored files.

Sixty-four bytes of payload are the coefficients of one block (each byte less
128, quantised by one), six blocks a unit of 16 x 16 pixels. Reading back
accumulates the file's scans in coefficient arrays, which hold the payload,
and transforms them to a full-resolution RGB tensor.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noema.llm.frames import keyed_text, map_batches
from noema.llm.progressive_jpeg import decode, encode, image, layout, units_rgb
from noema.llm.words import chunks, texts_of

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCK = 64
#: Bytes of payload that are coded at a time; a longer text stands alone.
CHUNK = 1 << 19


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\x00")


def store(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload; its comment has the payload's number of blocks."""
    blocks = np.array([len(p) // BLOCK for p in payloads], np.int64)
    across, down = layout(-(-blocks // 6))
    rows = across * down * 6
    coefficients = np.zeros((int(rows.sum()), BLOCK), np.int64)
    for begin, n, payload in zip((np.cumsum(rows) - rows).tolist(), blocks.tolist(), payloads, strict=True):
        coefficients[begin : begin + n] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK).astype(np.int64) - 128
    notes = [b"\xff\xfe\x00\x0a" + int(n).to_bytes(8, "big") for n in blocks]
    return [f[:2] + note + f[2:] for f, note in zip(encode(coefficients, across, down), notes, strict=True)]


def load(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload of each file and its RGB units."""
    coefficients, across, down, parsed = decode(files)
    rows = across * down * 6
    begin = np.cumsum(rows) - rows
    data = (coefficients + 128).astype(np.uint8)
    payloads = [data[b : b + int.from_bytes(f[6:14], "big")].tobytes() for b, f in zip(begin.tolist(), files, strict=True)]
    rgb = units_rgb(coefficients, parsed[0].quantization) if files else np.zeros((0, 16, 16, 3), np.uint8)
    edges = (begin // 6).tolist()
    return payloads, [rgb[e : e + int(n)] for e, n in zip(edges, across * down, strict=True)]


def feature(units: np.ndarray) -> str:
    """Pixels, means and spreads of red, green and blue, in hundredths."""
    flat = units.reshape(-1, 3).astype(np.int64)
    n, total, squares = len(flat), flat.sum(0), (flat * flat).sum(0)
    spread = [int(s * n - t * t) ** 0.5 / n for s, t in zip(squares.tolist(), total.tolist(), strict=True)]
    return f"{n}:" + ",".join(f"{t * 100 // n}" for t in total.tolist()) + ":" + ",".join(f"{int(s * 100)}" for s in spread)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Stores every whole text, reads it back, and returns digests and features; with ``keep`` also the file (media), and the tensor (rgb: bytes of height x width x 3, with height and width).

    One pass without a shuffle. A null text counts as empty (64 zero bytes); a null id stays
    null; equal texts have equal values; repeated rows each give a row; an empty table gives
    none; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = texts_of(batch.column(1)), []
        for a, b in chunks(texts, CHUNK):
            files = store([payload_of(t) for t in texts[a:b]])
            payloads, tensors = load(files)
            for text, file, payload, units in zip(texts[a:b], files, payloads, tensors, strict=True):
                row = [len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature(units)]
                if keep:
                    height, width = (int.from_bytes(file[k : k + 2], "big") for k in (file.index(b"\xff\xc2") + 5, file.index(b"\xff\xc2") + 7))
                    row += [file, image(units, width // 16, height // 16).tobytes(), height, width]
                rows.append(row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "rgb", "height", "width"]
        use = len(names) if keep else 7
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(use))], ["doc_id", *names[:use]])

    return map_batches(keyed_text(docs, id_col, text_col), run, SCHEMA + ", media binary, rgb binary, height int, width int" * keep)
