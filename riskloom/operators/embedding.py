"""Vectors of texts by a model that each worker loads once: subword ids cut at a length, padded batches with masks, means over the tokens.

A model is named by where it is made, "module:function", so that a saved bundle can say it; small_encoder() is one of fixed weights, and stands where no trained weights are at hand.
"""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

# Texts that go to the model together, and tokens that a text is cut to.
BATCH, MAX_TOKENS = 32, 512


class TextEncoder(Protocol):
    """What a model has to do: ids of a text, and hidden states (texts x tokens x width) of padded ids under their masks."""

    width: int
    pad_id: int

    def ids(self, text: str) -> list[int]: ...

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


@dataclass
class SmallEncoder:
    """One attention layer over hashed pieces of words, with weights by a fixed seed."""

    width: int = 32
    vocabulary: int = 4096
    piece: int = 4
    pad_id: int = 0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(7)
        made = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.table = rng.standard_normal((self.vocabulary, self.width)).astype(np.float32)
        self.query, self.key, self.value, self.out = (made(self.width, self.width) for _ in range(4))
        at, i = np.arange(MAX_TOKENS)[:, None], np.arange(self.width)[None]
        self.places = np.sin(at / 10_000 ** (2 * (i // 2) / self.width) + (i % 2) * np.pi / 2).astype(np.float32)

    def ids(self, text: str) -> list[int]:
        """A start, pieces of at most four characters of each word, and an end; ids by checksums."""
        named = [1 + zlib.crc32(w[a : a + self.piece].encode("utf-8", "surrogatepass")) % (self.vocabulary - 3) for w in text.split() for a in range(0, len(w), self.piece)]
        return [self.vocabulary - 2, *named, self.vocabulary - 1]

    def states(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = self.table[ids] + self.places[: ids.shape[1]]
        scores = (x @ self.query) @ (x @ self.key).transpose(0, 2, 1) / np.sqrt(np.float32(self.width))
        scores = np.where(mask[:, None, :] > 0, scores, np.float32(-1e9))
        weight = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (weight / weight.sum(-1, keepdims=True)) @ (x @ self.value)
        return np.tanh(x + mixed) @ self.out


def small_encoder() -> SmallEncoder:
    return SmallEncoder()


@lru_cache(maxsize=1)
def loaded(name: str) -> TextEncoder:
    """The model of "module:function", once per worker."""
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)()


SMALL = f"{__name__}:small_encoder"


def pooled_states(model: TextEncoder, texts: list[str]) -> np.ndarray:
    """A vector a text: the mean of its tokens' states; texts are cut to MAX_TOKENS ids, the last of which stays the end."""
    ids = [x if len(x) <= MAX_TOKENS else [*x[: MAX_TOKENS - 1], x[-1]] for x in map(model.ids, texts)]
    longest = max(map(len, ids), default=1)
    padded, mask = np.full((len(ids), max(longest, 1)), model.pad_id), np.zeros((len(ids), max(longest, 1)), np.float32)
    for i, x in enumerate(ids):
        padded[i, : len(x)], mask[i, : len(x)] = x, 1.0
    states = model.states(padded, mask)
    return ((states * mask[..., None]).sum(1) / np.maximum(mask.sum(1), 1e-9)[:, None]).astype(np.float32)


def encoded(text: Column, name: str = SMALL, batch: int = BATCH) -> Column:
    """The vector of a text under the model of that name; null counts as empty."""

    def made() -> Callable[[np.ndarray], np.ndarray]:
        model = loaded(name)
        return lambda texts: pooled_states(model, [str(x) for x in texts])

    return predict_batch_udf(made, return_type=ArrayType(FloatType()), batch_size=batch)(F.coalesce(text, F.lit("")))


def channels(rows: DataFrame, one: str, two: str, out: str, name: str = SMALL) -> DataFrame:
    """rows with both channels' vectors as one."""
    return rows.withColumn(out, F.concat(encoded(F.col(one), name), encoded(F.col(two), name)).cast("array<double>"))
