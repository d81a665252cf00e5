"""The symmetric scalar codec on blocks of vectors (NumPy, for Arrow kernels)."""

from __future__ import annotations

import numpy as np

from .vectors import CODE_LIMIT

TINY = float(np.finfo(np.float32).tiny)


def encode_block(x: np.ndarray, precision: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, inverse magnitude) of each row; single precision as stored, half away from zero."""
    x = np.asarray(x, np.float32)
    top = CODE_LIMIT[precision]
    peak = np.abs(x).max(axis=1, initial=0)
    scale = np.where(peak == 0, np.float32(1), (peak / np.float32(top)).astype(np.float32)).astype(np.float32)
    spread = x * (np.float32(1) / scale)[:, None]
    rounded = np.trunc(spread.astype(np.float64) + np.copysign(0.5, spread))
    codes = np.clip(rounded, -top, top).astype(np.int16)
    return codes, scale, inverse_magnitude(x)


def inverse_magnitude(x: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), TINY)


def list_matrix(column, kind: type = np.float32) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)
