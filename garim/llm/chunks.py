"""Token ids of many texts by a library's encoder, which is asked once for each distinct piece of text.

Texts are cut where no token can cross, so the ids of a text are those of its pieces. What was asked is remembered by
the Python worker, up to a bound, for its later batches and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pieces that are remembered at once; then memory starts afresh.
REMEMBERED = 400_000


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in larger ones, of at least so many bytes but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def taken(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges values[bounds[i]:bounds[i + 1]] for each i of `which`, one after the other, and their n + 1 bounds."""
    sizes = np.diff(bounds)[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(out[-1]) + np.repeat(bounds[:-1][which] - out[:-1], sizes)], out


class Remembered:
    """Results of `ask` (keys in, one result each out), kept by key."""

    def __init__(self, ask: Callable[[list[str]], list], most: int | None = None):
        self.ask, self.most = ask, most
        self.known: dict[str, object] = {}

    def __call__(self, keys: list[str]) -> list:
        """The result for each key; keys should be distinct."""
        if len(self.known) > (self.most or REMEMBERED):
            self.known.clear()
        known = self.known
        missing = [k for k in keys if k not in known]
        if missing:
            known.update(zip(missing, self.ask(missing), strict=True))
        return [known[k] for k in keys]


def flat(results: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of 32-bit integers, given by their bytes, as one array and n + 1 bounds."""
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in results], dtype=np.int64)]) // 4
    return np.frombuffer(b"".join(results), np.int32), bounds


def encoded(pieces: pa.ListArray, lookup: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each given by its pieces, one after the other, and the bounds of the texts (n + 1)."""
    words = pieces.flatten().dictionary_encode()
    values, bounds = flat(lookup(words.dictionary.to_pylist()))
    ids, ends = taken(values, bounds, words.indices.to_numpy())
    offsets = pieces.offsets.to_numpy()
    return ids, ends[offsets - offsets[0]]
