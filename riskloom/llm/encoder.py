"""Ids of many texts by a byte-level tokenizer file, in columns."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts of texts that are remembered, the longest of them in bytes, and the new parts that the library takes at once.
PARTS, LONGEST, AT_ONCE = 1 << 19, 48, 4096
#: What often follows a word.
_TAILS = ".,;:!?"
#: Texts of which not every white space stands alone, inside, and is a space or a line end; control and format characters count as white space here.
_ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f\x{80}-\x{a0}\x{ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Where an odd text is cut.
_SPLIT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Mark the first part of a text, which has no space before it, and a tail.
_HEAD, _TAIL = "\x01", "\x02"
_ENDED, _PLAIN = r"([\pL\pN])([.,;:!?])([ \n]|\z)", r"\A[\x01\n]?[\pL\pM\pN\pP\pS]+\z"


class Encoder:
    """Ids of texts by a byte-level tokenizer file, each frequent part encoded once.

    A single space between two other characters begins a token of its own word, a single line end there is a token by itself, and a letter or digit ends its token before a point or the like, so that
    a text may be cut at all three without changing its ids; special tokens hold none of them. Arrow splits the texts and numbers their distinct parts; the tokenizer sees only parts that are new, many of them
    in one text with line ends between, which it tells apart again; ids are then gathered for all parts at once. When too many parts are remembered, those that came up once are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are as many as the cores
        self.model = Tokenizer.from_file(path)
        (self.line,) = self._encode(["\n"])[0].tolist()
        tails = self._encode(list(_TAILS))
        self.names = pa.array([_TAIL + x for x in _TAILS])
        self.lens = np.array([len(x) for x in tails])
        self.pool, self.starts, self.hits = np.concatenate(tails), np.cumsum(self.lens) - self.lens, np.full(len(tails), 2)

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]

    def _keep(self, slots: np.ndarray) -> None:
        """Remember these slots alone."""
        self.pool, self.lens, self.names, self.hits = self._gathered(slots), self.lens[slots], self.names.take(pa.array(slots)), self.hits[slots]
        self.starts = np.cumsum(self.lens) - self.lens

    def _add(self, names: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lens) - lens])
        self.names, self.pool = pa.concat_arrays([self.names, names]), np.concatenate([self.pool, ids])
        self.lens, self.hits = np.concatenate([self.lens, lens]), np.concatenate([self.hits, np.zeros(len(lens), np.int64)])

    def _learn(self, parts: pa.Array) -> None:
        """Encode new parts. Plain ones go in one text: after a line end, a part with its space or line end is what it is alone, and only line ends give the line end's id."""
        alone = pc.or_(pc.invert(pc.match_substring_regex(parts, _PLAIN)), pc.match_substring(parts, "<|"))
        plain = pc.filter(parts, pc.invert(alone))
        if len(plain):
            lined = pc.replace_substring_regex(pc.replace_substring_regex(plain, r"\A([^\n\x01])", "\n \\1"), r"\A\x01", "\n")
            ends, data = np.frombuffer(lined.buffers()[1], np.int32)[lined.offset : lined.offset + len(lined) + 1].tolist(), lined.buffers()[2]
            cuts = [*ends[: len(plain) : AT_ONCE], ends[-1]]
            ids = np.concatenate(self._encode([data[a:b].to_pybytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)]))
            begin = np.flatnonzero(ids == self.line)
            if len(begin) != len(plain):
                raise ValueError("the tokenizer doesn't keep line ends apart")
            own = pc.starts_with(plain, "\n").to_numpy(zero_copy_only=False)  # their line end is theirs
            used = np.ones(len(ids), bool)
            used[begin[~own]] = False
            self._add(plain, ids[used], np.diff(np.append(begin, len(ids))) - ~own)
        others = pc.filter(parts, alone)
        if len(others):
            ids = self._encode([x[1:] if x[:1] == _HEAD else x if x[:1] == "\n" else " " + x for x in others.to_pylist()])
            self._add(others, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _slots(self, parts: pa.Array) -> np.ndarray:
        """The slots of distinct parts; new ones are encoded."""
        found = pc.index_in(parts, value_set=self.names)
        if found.null_count:
            self._learn(pc.filter(parts, pc.is_null(found)))
            found = pc.index_in(parts, value_set=self.names)
        return found.to_numpy()

    def _gathered(self, slots: np.ndarray) -> np.ndarray:
        lens = self.lens[slots]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[slots] - ends + lens, lens)
        return self.pool[at]

    def tokens(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit numbers, where each text's ids begin and the last ones end). Each text's ids end with end_id, if given. Null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        even = pc.replace_substring_regex(pc.filter(texts, pa.array(~odd)), _ENDED, rf"\1 {_TAIL}\2\3")
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_HEAD, even, ""), "\n", " \n"), " ")
        by_hand = [_SPLIT.split(_HEAD + t) if _HEAD not in t and _TAIL not in t else [_HEAD + t] for t in pc.filter(texts, pa.array(odd)).to_pylist()]
        n_parts = np.zeros(len(texts), np.int64)
        n_parts[~odd], n_parts[odd] = np.diff(split.offsets.to_numpy()), [len(x) for x in by_hand]
        first = np.cumsum(n_parts) - n_parts
        flat = pa.concat_arrays([split.flatten(), pa.array([y for x in by_hand for y in x], pa.string())]).dictionary_encode()
        slots = self._slots(flat.dictionary)
        of = slots[flat.indices.to_numpy()]
        if odd.any():  # odd texts come last among the parts; put all back in the order of the texts
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            begin = np.empty(len(texts), np.int64)
            begin[order] = np.cumsum(n_parts[order]) - n_parts[order]
            of = of[np.repeat(begin - first, n_parts) + np.arange(len(of))]
        ids = self._gathered(of)
        ends = np.concatenate([[0], np.cumsum(self.lens[of])])
        bounds = ends[np.append(first, len(of))]
        self.hits += np.bincount(of, minlength=len(self.hits))
        self._forget()
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds

    def _forget(self) -> None:
        """Long parts are known for one call only; of too many parts those stay that came up more than once, if they are few enough."""
        short = pc.less_equal(pc.binary_length(self.names), LONGEST).to_numpy(zero_copy_only=False)
        if len(self.names) > PARTS:
            often = short & (self.hits > 1)
            self.hits[:] = 0
            self.hits[: len(_TAILS)] = 2
            self._keep(np.flatnonzero(often) if often.sum() <= PARTS // 2 else np.arange(len(_TAILS)))
        elif not short.all():
            self._keep(np.flatnonzero(short))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers, little-endian."""
        flat, bounds = self.tokens(pa.array(texts, pa.string()))
        return [flat[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Once per worker."""
    return Encoder(path)
