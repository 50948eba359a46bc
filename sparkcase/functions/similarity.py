"""String and vector similarity.

Edit distances by insertion and deletion, and Jaro-Winkler, have no built-in in
Spark; they are Arrow UDFs meant for distinct pairs. The rest are columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    """2 * common subsequence / total length; two empty strings are alike."""
    if a is None or b is None:
        return None
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str | None, b: str | None) -> float | None:
    """The best of comparing shared words with shared plus own words of either side."""
    if a is None or b is None:
        return None
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 1.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    scores = [indel(one, two)]
    if shared:
        scores += [indel(shared, one), indel(shared, two)]
    return max(scores)


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Letters of a text whose places are the bits of one word.
WORD = 64


def letter_masks(texts: list[str]) -> dict[str, np.ndarray]:
    """For each letter of some texts of up to 64 letters, the places it has in each of them, as bits."""
    width = max(map(len, texts), default=0)
    codes = np.zeros((width, len(texts)), np.uint32)
    for i, text in enumerate(texts):
        codes[: len(text), i] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes += 1  # 0 is no letter
    for i, text in enumerate(texts):
        codes[len(text) :, i] = 0
    out = {}
    for code in np.unique(codes):
        if code:
            bits = np.zeros(len(texts), np.uint64)
            for k in range(width):
                bits |= (codes[k] == code).astype(np.uint64) << np.uint64(k)
            out[chr(int(code) - 1)] = bits
    return out


def _winkler_row(a: str, n: int, masks: dict[str, np.ndarray], count: int) -> np.ndarray:
    """Jaro-Winkler of one text with so many texts of n letters, 1 to 64, given by their masks."""
    reach = max(max(len(a), n) // 2 - 1, 0)
    free, steps = np.full(count, ~np.uint64(0)), []
    for i, c in enumerate(a):
        low, high = max(0, i - reach), min(n, i + reach + 1)
        if c in masks and low < high:
            hit = masks[c] & np.uint64((1 << high) - (1 << low))
            hit &= free
            hit &= np.negative(hit)  # the first place
            free ^= hit
            steps.append((masks[c], np.negative((hit != 0).view(np.uint8).astype(np.uint64))))
    rest = ~free
    m, wrong = np.bitwise_count(rest).astype(np.int64), np.zeros(count, np.uint64)
    for mask, got in steps:
        place = np.negative(rest)
        place &= rest
        place &= got
        rest ^= place
        place &= ~mask
        wrong |= place
    swaps = np.bitwise_count(wrong).astype(np.int64)
    jaro = np.where(m > 0, (m / max(len(a), 1) + m / n + (m - swaps // 2) / np.maximum(m, 1)) / 3, 0.0)
    prefix, same = np.zeros(count, np.int64), np.ones(count, bool)
    for k in range(min(4, len(a), n)):
        same &= (masks[a[k]] >> np.uint64(k) & np.uint64(1) != 0) if a[k] in masks else False
        prefix += same
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


def jaro_winkler_block(left: list[str], right: list[str]) -> np.ndarray:
    """The score of every text of the left with every one of the right, a row a left text."""
    out = np.zeros((len(left), len(right)))
    lengths = np.array([len(b) for b in right])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        some = [right[k] for k in at]
        if 1 <= n <= WORD:
            masks = letter_masks(some)
            for i, a in enumerate(left):
                out[i, at] = _winkler_row(a, int(n), masks, len(at))
        else:
            for i, a in enumerate(left):
                out[i, at] = [jaro_winkler(a, b) for b in some]
    return out


def _pairwise(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(over, DoubleType())


ratio_udf, token_set_udf, jaro_winkler_udf = _pairwise(indel), _pairwise(token_set), _pairwise(jaro_winkler)


def token_sort_ratio(a: Column, b: Column) -> Column:
    def ordered(x: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: w != "")), " ")

    return ratio_udf(ordered(a), ordered(b))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clipped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))
