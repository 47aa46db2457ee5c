"""Radix orders of unsigned numbers, as stable counting passes of 16 bits."""

from __future__ import annotations

import numpy as np


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by unsigned ``keys``, the first one most significant.

    One stable pass per 16 bits, from the least significant; numpy sorts 16-bit values by
    counting. Digits that all rows share are passed over.
    """
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def starts_of_runs(keys: list[np.ndarray]) -> np.ndarray:
    changed = np.zeros(len(keys[0]), dtype=bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.nonzero(changed)[0]


def equal_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that agree with another one in all ``digits``, and the group of each.

    A sort by the most significant digit first, limited to the depth of the digits: after
    every pass, rows that are alone in their group leave, so later passes see
    repeats only. Rows of one group follow each other.
    """
    rows = np.arange(len(digits[0]))
    group = np.zeros(len(rows), dtype=np.uint32)
    for digit in digits:
        if not len(rows):
            break
        order = radix_order([group, digit[rows]])
        rows, group = rows[order], group[order]
        starts = starts_of_runs([group, digit[rows]])
        sizes = np.diff(np.append(starts, len(rows)))
        shared = np.repeat(sizes > 1, sizes)
        group = np.repeat(np.arange(len(starts), dtype=np.uint32), sizes)[shared]
        rows = rows[shared]
    return rows, group
