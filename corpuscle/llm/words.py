r"""Ids of texts by way of their words: each distinct word of a batch is encoded once.

Byte-level pre-tokenisers split before every run of white space.  A text without
doubled or trailing blanks therefore falls into pieces that are encoded each for
itself: words after one space, and words after a line end.  A last mark after a
Latin letter is a piece of its own as well.  Arrow splits a batch, finds its distinct
words and looks them up among those met lately; numpy gathers the ids of all words
from one flat pool.  Nothing is done word by word in Python.

Texts that do not fall apart in this way (``regular`` says which do) are left to the
caller.  The pool keeps at most ``POOL_BYTES`` between batches: when it is full, the
words not met for longest go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

POOL_BYTES, BATCH_BYTES = 20 << 20, 2 << 20
TAILS = [".", ",", ";", ":", "!", "?"]
TAILED = "[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]$"
WHITE = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LESS_LF = WHITE.replace(r"\n", "")
#: A blank before more white space or the end; a line end before other white space or the end; a double line end after white space.
ODD = rf" [{WHITE}]| \z|\n[{LESS_LF}]|\n\z|[{WHITE}]\n\n|\A[{WHITE}]"


def regular(texts: pa.Array, marks: list[str]) -> np.ndarray:
    """Which texts fall into words; ``marks`` are special tokens, which may hold blanks."""
    odd = pc.match_substring_regex(texts, ODD)
    for m in marks:
        odd = pc.or_(odd, pc.match_substring(texts, m))
    return ~odd.to_numpy(zero_copy_only=False)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of Arrow batches joined until they hold ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    given = 0
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]
            held = []
            given += 1
            if given % 8 == 0:
                give_back(False)
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]


def lead(words: pa.Array) -> pa.Array:
    """Words as they stand in a text: after a space, or after the line end that they begin with."""
    return pc.binary_join_element_wise(pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")


class WordPool:
    """``learn`` gives the ids (flat, and how many of each) of words as ``lead`` shows them; a line end is one id."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], pool_bytes: int = POOL_BYTES):
        self.learn, self.most = learn, pool_bytes
        self.words = pa.array([], pa.string())
        self.pool, self.starts, self.sizes, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.clock = 0
        ids, sizes = learn(pa.array(["x" + t for t in TAILS]))  # the mark stands alone after a letter
        ends = np.cumsum(sizes)
        self.tails = [ids[e - s + 1 : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]

    def _forget(self) -> None:
        """Keeps the words met last, up to half of the room."""
        order = np.argsort(-self.used, kind="stable")
        cost = np.cumsum(4 * self.sizes[order] + pc.binary_length(self.words).to_numpy(zero_copy_only=False)[order] + 28)
        keep = np.sort(order[: np.searchsorted(cost, self.most // 2)])
        self.words = self.words.take(pa.array(keep))
        self.pool = gather(self.pool, self.starts[keep], self.sizes[keep])
        self.sizes, self.used = self.sizes[keep], self.used[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _find(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the pool; new words are learnt."""
        if self.pool.nbytes + self.words.nbytes + 24 * len(self.words) > self.most:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(pc.is_null(at)).unique()
            ids, sizes = self.learn(new)
            starts = len(self.pool) + np.cumsum(sizes) - sizes
            self.words = pa.concat_arrays([self.words, new])
            self.pool = np.concatenate([self.pool, ids])
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            at = pc.index_in(words, value_set=self.words)
        found = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.clock += 1
        self.used[found] = self.clock
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has.  All texts are regular."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        of, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        tailed = pc.match_substring_regex(distinct, TAILED)
        stems = pc.if_else(tailed, pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        tail = pc.if_else(tailed, pc.index_in(pc.utf8_slice_codeunits(distinct, -1), value_set=pa.array(TAILS)), len(TAILS))
        place, tail = self._find(stems), pc.fill_null(tail, len(TAILS)).to_numpy(zero_copy_only=False)
        # each word is two runs of the pool: its stem and its mark
        marks = [*self.tails, np.empty(0, np.uint32)]
        mark_size = np.array([len(m) for m in marks], np.int64)
        mark_at = len(self.pool) + np.cumsum(mark_size) - mark_size
        pool = np.concatenate([self.pool, *marks])
        runs = np.stack([self.starts[place], mark_at[tail]], 1)[of].reshape(-1)
        sizes = np.stack([self.sizes[place], mark_size[tail]], 1)[of]
        upto = np.concatenate([[0], np.cumsum(sizes.sum(1))])
        counts = upto[offsets[1:]] - upto[offsets[:-1]]
        sizes = sizes.reshape(-1)
        opens = 2 * offsets[:-1]  # the line end put before a text is no part of it
        runs[opens] += 1
        sizes[opens] -= 1
        return gather(pool, runs, sizes), counts - 1


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of the pool that begin at ``starts``, one after the other."""
    some = np.flatnonzero(sizes)
    starts, sizes = starts[some], sizes[some]
    if not len(some):
        return pool[:0]
    step = np.ones(int(sizes.sum()), np.int32 if len(pool) < 1 << 31 else np.int64)
    step[0] = starts[0]
    step[np.cumsum(sizes)[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return pool[np.cumsum(step, out=step)]
