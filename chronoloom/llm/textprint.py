"""Fingerprints of many texts at once: tokens, sentences, shingles and SimHash, in NumPy.

The texts of a batch are one array of code points. A token is a run of letters and digits or a run of
other signs; its hash is a polynomial of its code points modulo 2**64, taken from prefix sums, so no
token is ever a Python object. A token that holds a digit counts as "0". Sentences end at a line break
or after a full stop, exclamation or question mark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE = 5
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_NUMBER = np.uint64(0x2545F4914F6CDD1D)
_TABLE = 0x20000
_ROWS = 1 << 15
_LANES = np.uint64(0x0001000100010001)
_CACHE: dict = {}


def _classes() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 other sign, for the code points below _TABLE (others count as signs)."""
    if "classes" not in _CACHE:
        _CACHE["classes"] = np.array([2 if c.isdigit() else 1 if c.isalnum() else 0 if c.isspace() or c == "\0" else 3 for c in map(chr, range(_TABLE))] + [3], dtype=np.uint8)
    return _CACHE["classes"]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n and their inverses modulo 2**64."""
    held = _CACHE.get(base)
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        one, inverse = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        one[0] = inverse[0] = 1
        held = _CACHE[base] = (np.cumprod(one, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64))
    return held


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of values[first:last], whatever its position."""
    powers, inverses = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix((sums[last] - sums[first]) * inverses[first])


@dataclass
class Prints:
    """Per text i (those without tokens are left out, see ``texts``): hashes, SimHash, shingles and sentences."""

    texts: np.ndarray  # position of the text in the batch
    h1: np.ndarray
    h2: np.ndarray
    sim: np.ndarray
    shingles: list[np.ndarray]
    owner: np.ndarray  # per sentence: position in ``texts``
    sentence: np.ndarray  # its hash: words only, signs aside
    begin: np.ndarray  # where it lies in the joined text
    end: np.ndarray
    words: np.ndarray  # how many words it has
    hits: list[np.ndarray]  # per vocabulary: how many of its tokens belong to it
    runs: np.ndarray  # how many of its words repeat one letter three times or more


def _tokens(joined: str):
    """Code points, their groups, and begin, end and hash of every token."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[np.minimum(code, _TABLE)]
    group = np.where(kind == 2, 1, kind)
    before = np.concatenate(([0], group[:-1]))
    at = np.flatnonzero((group > 0) & (group != before))
    end = np.flatnonzero((group > 0) & (group != np.concatenate((group[1:], [0])))) + 1
    token = _spans(code.astype(np.uint64) + np.uint64(1), at, end)
    digits = np.concatenate(([0], np.cumsum(kind == 2)))
    token[digits[end] > digits[at]] = _NUMBER
    return code, kind, group, at, end, token


def vocabulary(words) -> np.ndarray:
    """Which tokens belong to a set of words: their sorted hashes ("0" stands for every number)."""
    return np.unique(_tokens("\0".join(words) + "\0")[5])


def fingerprint(joined: str, vocabularies: list[np.ndarray] = ()) -> Prints:
    """Fingerprints of texts that are joined by, and end with, a NUL sign."""
    code, kind, group, at, end, token = _tokens(joined)
    doc = np.concatenate(([0], np.cumsum(code == 0)))[at]
    texts, first = np.unique(doc, return_index=True)
    last = np.append(first[1:], len(doc))
    owner = np.repeat(np.arange(len(texts)), last - first)
    h1, h2 = _spans(token, first, last), _spans(mix(token ^ np.uint64(_SECOND)), first, last, _SECOND)

    blank = kind == 0
    stop = (code == 33) | (code == 46) | (code == 63)
    broken = (code == 10) | (code == 0)
    broken[1:] |= blank[1:] & stop[:-1]
    piece = np.concatenate(([0], np.cumsum(broken)))[at]
    p0 = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(piece) else np.empty(0, dtype=np.int64)
    p1 = np.append(p0[1:], len(piece)) if len(p0) else p0
    worded = group[at] == 1
    words = np.concatenate(([0], np.cumsum(worded)))
    said = _spans(token[worded], words[p0], words[p1])
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], code[1:] == code[:-1])))))
    run = (end - at >= 3) & (same[end] - same[np.minimum(at + 1, len(code))] == end - at - 1) & worded
    counts = [_counted(run, p0, p1), *(_counted(_among(token, v), p0, p1) for v in vocabularies)]
    some = words[p1] > words[p0]
    p0, p1 = p0[some], p1[some]
    sets = shingles(token, owner, h1)
    return Prints(
        texts, h1, h2, simhash(sets), sets, owner[p0], said[some], at[p0], end[p1 - 1],
        (words[p1] - words[p0]), [c[some] for c in counts[1:]], counts[0][some],
    )


def shingle_sets(joined: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """``texts`` and ``shingles`` of ``fingerprint``, without the rest."""
    code, _, _, at, _, token = _tokens(joined)
    doc = np.concatenate(([0], np.cumsum(code == 0)))[at]
    texts, first = np.unique(doc, return_index=True)
    last = np.append(first[1:], len(doc))
    return texts, shingles(token, np.repeat(np.arange(len(texts)), last - first), _spans(token, first, last))


def _counted(flag: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(flag)))
    return upto[last] - upto[first]


def _among(token: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Tokens that belong to a vocabulary: a table of 16 bits first, then the exact test."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low[(token & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = np.isin(token[at], vocabulary)
    return out


def shingles(token: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes of five-token shingles per text; a shorter text is one shingle."""
    if not len(whole):
        return []
    n = len(token) - SHINGLE + 1
    mixed = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for j in range(SHINGLE):
            mixed = (mixed ^ token[j : j + n]) * _MULTIPLIERS[j]
            mixed ^= mixed >> np.uint64(29)
        inside = owner[:n] == owner[SHINGLE - 1 :]
        mixed, of = mixed[inside], owner[:n][inside]
    else:
        of = np.empty(0, dtype=owner.dtype)
    short = np.bincount(owner, minlength=len(whole)) < SHINGLE
    mixed, of = np.concatenate([mixed, whole[short]]), np.concatenate([of, np.flatnonzero(short)])
    order = np.lexsort((mixed, of))
    mixed, of = mixed[order], of[order]
    new = np.ones(len(mixed), dtype=bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (of[1:] != of[:-1])
    return np.split(mixed[new], np.cumsum(np.bincount(of[new], minlength=len(whole)))[:-1])


def simhash(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit SimHash of each set of hashes, as signed longs."""
    ones = np.zeros((len(sets), 64), dtype=np.int64)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    feature, of = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    for a in range(0, len(feature), _ROWS):  # below 2**16, so that four counters of 16 bits share a word
        part, whose = feature[a : a + _ROWS], of[a : a + _ROWS]
        begin = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        who = whose[begin]
        for k in range(16):
            lanes = np.add.reduceat((part >> np.uint64(k)) & _LANES, begin)
            ones[who, k::16] += lanes.view(np.uint16).reshape(-1, 4)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()
