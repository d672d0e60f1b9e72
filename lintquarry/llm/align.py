"""Bit-parallel edit distances between sequences of symbols."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def masks(pattern: Sequence) -> dict:
    """For each symbol the bits of the places where the pattern has it."""
    out: dict = {}
    bit = 1
    for s in pattern:
        out[s] = out.get(s, 0) | bit
        bit <<= 1
    return out


def infix(pattern_masks: dict, m: int, text: Sequence) -> list[int]:
    """For each end in text (1 after its first symbol), the least distance of the m-symbol pattern to a piece of text that
    ends there (Myers 1999)."""
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = every, 0, m, []
    get = pattern_masks.get
    for s in text:
        eq = get(s, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | x
        right_up = down | ~(diagonal | up) & every
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = right_up << 1 & every
        right_down = right_down << 1 & every
        up = right_down | ~(diagonal | right_up) & every
        down = right_up & diagonal & every
        out.append(score)
    return out


def within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two arrays if it is at most ``most``, else most + 1.

    What both begin or end with goes first. Then only cells of the alignment within ``most`` of the diagonal are
    computed, a column at a time, as the bits of a window that moves down with the diagonal (Hyyro 2003).
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    differ = np.flatnonzero(a != b[: len(a)])
    head = int(differ[0]) if len(differ) else len(a)
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    tail = int(differ[0]) if len(differ) else len(a)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    if most <= 0:
        return 1
    return _band(masks(a.tolist()), len(a), b.tolist(), most)


def _band(eq_of: dict, m: int, text: list, most: int) -> int:
    """Rows j - most to j + most of column j; bit most + i - j stands for row i."""
    width = 2 * most + 1
    every = (1 << width) - 1
    # before the first column: rows 1 to most + 1 grow by one each; rows above the matrix are level
    up, down, score = every >> most << most, 0, min(most, m)
    middle, get = 1 << (2 * most), eq_of.get
    n = len(text)
    # the score at the window's last row may still fall by one with each diagonal up to the end's
    give_up = 2 * most + n - m
    for j in range(1, n + 1):
        eq = get(text[j - 1], 0)
        shift = j - 1 - most
        eq = (eq >> shift if shift >= 0 else eq << -shift) & every
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        right_up = down | ~(diagonal | up) & every
        right_down = diagonal & up
        if j + most <= m:  # the window's last row is in the matrix: follow it down the diagonal
            if not diagonal & middle:
                score += 1
                if score > give_up:
                    return most + 1
        else:  # follow row m, one bit higher up with each column
            bit = 1 << (2 * most - (j + most - m))
            if right_up & bit:
                score += 1
            elif right_down & bit:
                score -= 1
        below = diagonal >> 1
        up = right_down | ~(below | right_up) & every
        down = below & right_up
    return score if score <= most else most + 1

