"""Word shingles of whole texts as sorted 64-bit hashes."""

import numpy as np
import xxhash

from voxtab.llm.common import split_words


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text: of `width` words in lower case (A-Z); a text with
    fewer words is one shingle, one without words has none. Sorted by hash."""
    codes, unique, bounds = split_words([t.lower() for t in texts])
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in unique], np.uint64)[codes]
    n = max(len(hashes) - width + 1, 0)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = mixed(rolled + hashes[k : k + n])
    found = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            found.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                value = mixed(value + h)
            found.append(value)
        else:
            found.append(np.zeros(0, np.uint64))
    return found
