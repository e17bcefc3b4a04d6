"""A tiny ONNX model written by hand: last_hidden_state = table[input_ids]."""

from __future__ import annotations

import numpy as np

FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _value(name: str, kind: int, *dims: str | int) -> bytes:
    shape = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def gather_model(table: np.ndarray) -> bytes:
    rows, dim = table.shape
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "last_hidden_state") + _field(4, "Gather")
    tensor = _field(1, rows) + _field(1, dim) + _field(2, FLOAT) + _field(8, "table") + _field(9, table.astype("<f4").tobytes())
    inputs = [_value(n, INT64, "batch", "length") for n in ("input_ids", "attention_mask", "token_type_ids")]
    graph = _field(1, node) + _field(2, "g") + _field(5, tensor)
    graph += b"".join(_field(11, i) for i in inputs) + _field(12, _value("last_hidden_state", FLOAT, "batch", "length", dim))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
