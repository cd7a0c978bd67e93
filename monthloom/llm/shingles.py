"""Hashed word shingles of whole texts, computed on the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more than texts).

    A word is a run of bytes other than white space; ``fold`` maps bytes, by default A-Z to a-z. Works through about 512 KB at a time,
    cut between words.
    """
    first_of_text = np.zeros(len(data) + 1, bool)
    first_of_text[offsets[:-1]] = True
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not first_of_text[end]:  # to the next white space or text, 64 KB at a time
            stop = _SPACE[data[end:end + 65536]] | first_of_text[end:end + 65536][:len(data) - end]
            hit = int(stop.argmax())
            if stop[hit]:
                end += hit
                break
            end += len(stop)
        piece = data[at:end]
        inside = ~_SPACE[piece]
        begins = inside & first_of_text[at:end]
        begins[1:] |= inside[1:] & ~inside[:-1]
        if len(piece):
            begins[0] |= inside[0]
        begin = np.flatnonzero(begins)
        if len(begin):
            spots = np.flatnonzero(inside)
            word = np.cumsum(begins)[spots] - 1
            place = spots - begin[word]
            power = np.cumprod(np.full(int(place.max()) + 1, _STEP))
            terms = _BYTE[fold[piece[spots]]] * power[place]
            hashes.append(mix(np.add.reduceat(terms, np.flatnonzero(place == 0))))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Yields the sorted distinct hashes of each text's k-word shingles.

    Fewer than k words: the whole sequence is the one shingle. No words: an empty set.
    """
    words, bounds = word_hashes(data, offsets)
    rolled = chain(words, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a:b - k + 1])
        elif b > a:
            yield mix(chain(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = max(0, len(words) - k + 1)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * _STEP + words[j:j + n])
    return h
