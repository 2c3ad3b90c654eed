"""A bounded memory of what each distinct string encodes to."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches ids[first : first + count], end to end."""
    return ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


class Known:
    """Distinct strings and the ids each encodes to; begins afresh when it holds more than ``most``."""

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int):
        self.compute, self.most = compute, most
        self.clear()

    def clear(self) -> None:
        self.strings = pa.array([], pa.string())
        self.ids, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings end to end, and how many each has."""
        coded = strings.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.strings)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            if len(self.strings) + found.null_count > self.most:
                self.clear()
                place[:] = -1
            new = coded.dictionary.filter(pa.array(place < 0))
            ids, count = self.compute(new)
            place[place < 0] = len(self.strings) + np.arange(len(new))
            self.strings = pa.concat_arrays([self.strings, new])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        first = np.cumsum(self.count) - self.count
        return gathered(self.ids, first[at], self.count[at]), self.count[at]
