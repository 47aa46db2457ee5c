"""Terms of a text as runs of kept bytes of its UTF-8 form, with A-Z in lower case.

A class of terms names the ASCII characters it keeps; every byte of a character outside
ASCII is kept, so a term never cuts one.
"""

from __future__ import annotations

import string

import numpy as np

LETTERS = string.ascii_letters
LETTERS_AND_DIGITS = string.ascii_letters + string.digits


def lowering_table(kept: str) -> bytes:
    """For ``bytes.translate``: kept characters in lower case, all other ASCII as a space."""
    ascii_part = (chr(code).lower() if chr(code) in kept else " " for code in range(128))
    return "".join(ascii_part).encode() + bytes(range(128, 256))


def term_bounds(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in translated bytes."""
    inside = joined != ord(" ")
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.nonzero(edges == 1)[0]
    return starts, np.nonzero(edges == -1)[0] - starts
