"""Whole Arrow columns of sequences as one numpy array of bytes, for functions that visit every base of long sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def letters(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one byte for each character, ends of the sequences with 0 before them); characters beyond ASCII become their first byte, nulls are empty."""
    seqs = pc.fill_null(seqs, "")
    if not len(seqs):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(seqs.type) else np.int32
    edge = np.frombuffer(seqs.buffers()[1], kind)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
    raw = seqs.buffers()[2]
    d = np.frombuffer(raw, np.uint8)[edge[0] : edge[-1]] if raw else np.empty(0, np.uint8)
    edge = edge - edge[0]
    if len(d) and d.max() >= 128:
        head = (d & 0xC0) != 0x80
        edge = np.concatenate(([0], np.cumsum(head)))[edge]
        d = d[head]
    return d, edge


def mapped(d: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(d.tobytes().translate(table), np.uint8)


def strings(d: np.ndarray, edge: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """The ASCII bytes between the edges as strings; null where valid is false."""
    out = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(d)))
    return out if valid is None else pc.if_else(valid, out, pa.scalar(None, pa.string()))


def lists(values: pa.Array, edge: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """Lists of the values between the edges; null where valid is false."""
    if valid is None or pc.all(valid).as_py() in (True, None):
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values)
    missing = np.append(~valid.to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32), mask=missing), values)
