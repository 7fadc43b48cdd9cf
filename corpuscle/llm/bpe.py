"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

``Bpe`` reads a byte-level merge list.  ``transduce`` turns the bytes of a pre-token,
which may arrive in blocks of any size, into ids while it reads.  For each position
it finds the one token that ends there in the encoding of the bytes so far: the
candidates are the tokens that end at the position, longest first, by an automaton
over the vocabulary; the right one stays apart from the token before it when the
two are merged alone (``fits``: no merge joins them at any stage of their making).

``lookahead`` is the merge list's sufficient lookahead.  Let two texts agree up to a
position.  Where their encodings differ furthest to the left, a merge joined a token
``a`` to a token ``b`` in one of them alone, because what stands at the start of ``b``
was made, by an earlier merge, in one of them alone; and so on up to the position.
A chain of such merges has ranks that rise and, link by link, left parts that stand at
the left edge of the next right part.  So tokens further back than the heaviest
chain, weighed by the bytes of the left parts, are stable whatever follows, and are
emitted.  The kept state is some multiples of that length, for a text of any length.

Every id comes from the transducer.  Words of ordinary texts pass it once for each
batch and are then looked up (``words.WordPool``); texts with doubled blanks, special
tokens or words beyond ``LONG`` characters are read as streams.

Decoding maps ids to bytes and runs a byte-to-text state machine that keeps an
unfinished character only.

Null texts count as empty; an empty text has no ids and decodes to an empty text.
Rows with a null doc_id are passed on with that null.  Repeated rows are encoded
each for itself.  Extra columns of the input are not carried into the digests.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker
from .words import WordPool, gathered, lead, regular

# The pre-tokeniser's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG, BLOCK, PAIRS = 1000, 1 << 12, 200_000
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 62
LONG_WORD = rf"[^ \n]{{{LONG}}}"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes follow, in
    order, from code point 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE file, its encoder and its decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        letters = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in vocab if t not in self.special}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.table: list[bytes] = [b""] * size
        for t, b in as_bytes.items():
            self.table[vocab[t]] = b
        for t, i in self.special.items():
            self.table[i] = t.encode()
        self.base = [vocab[t] for _, t in sorted((b, t) for t, b in as_bytes.items() if len(b) == 1)]
        self.pairs: dict[int, int] = {}  # left id, right id -> rank, merged id
        self.merges = [(vocab[x], vocab[y]) for x, y in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        names = {i: t for t, i in vocab.items()}
        for rank, (x, y) in enumerate(self.merges):
            self.pairs.setdefault(x << ID_BITS | y, rank << ID_BITS | vocab[names[x] + names[y]])
        # how each token is made: by which merge, of which two; -1 for single bytes
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        reached = []
        for i in map(vocab.__getitem__, as_bytes):
            made, last = self._merge(self.table[i])
            if made == [i]:
                reached.append(i)
                if last:
                    self.left[i], self.right[i], self.rank[i] = last
        self.max_token = max(len(self.table[i]) for i in reached)
        self.lookahead = self._lookahead()
        self._automaton(reached)
        self.known: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self.emitted = 0  # ids that the transducer has given, for tests
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = WordPool(self._learn)

    def _merge(self, raw: bytes) -> tuple[list[int], tuple[int, int, int] | None]:
        """The ids of a few bytes, lowest-ranked pair first, leftmost first; and the last merge (left, right, rank)."""
        ids, last = [self.base[b] for b in raw], None
        while True:
            found = min((self.pairs.get(x << ID_BITS | y, NEVER), i) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False))) if len(ids) > 1 else (NEVER, 0)
            if found[0] == NEVER:
                return ids, last
            i = found[1]
            last = ids[i], ids[i + 1], found[0] >> ID_BITS
            ids[i : i + 2] = [found[0] & ID_MASK]

    def _lookahead(self) -> int:
        """The bytes of the heaviest chain of merges (see above), and of one token."""
        best = [0] * len(self.table)  # by left part: the heaviest chain that ends with such a merge
        most = 0
        for x, y in self.merges:
            weight, edge = 0, y
            while edge >= 0:  # the tokens at the left edge of y
                weight = max(weight, best[edge])
                edge = self.left[edge]
            best[x] = max(best[x], weight + len(self.table[x]))
            most = max(most, best[x])
        return most + self.max_token

    def _automaton(self, tokens: list[int]) -> None:
        """For every string that begins a token: its next states and the longest token at its end."""
        self.next, self.back, self.longest = {}, [0], [-1]
        node_of = {}
        for i in tokens:
            at = 0
            for byte in self.table[i]:
                to = self.next.get(at << 8 | byte)
                if to is None:
                    to = self.next[at << 8 | byte] = len(self.back)
                    self.back.append(0)
                    self.longest.append(-1)
                at = to
            self.longest[at] = i
            node_of[i] = at
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        todo = deque([0])
        own = [t >= 0 for t in self.longest]
        while todo:
            at = todo.popleft()
            for byte, to in children.get(at, ()):
                todo.append(to)
                if at:
                    back = self.back[at]
                    while back and back << 8 | byte not in self.next:
                        back = self.back[back]
                    self.back[to] = self.next.get(back << 8 | byte, 0)
                if not own[to]:
                    self.longest[to] = self.longest[self.back[to]]
        self.shorter = [-1] * len(self.table)  # the longest token at the end of a token
        for i, at in node_of.items():
            self.shorter[i] = self.longest[self.back[at]]
        self.sizes = [len(t) for t in self.table]

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged alone.

        Walks back through their making: at each stage one token ends at the border
        and one begins there; they must not be a pair that merges before the next
        stage.  Of equal ranks the left merge comes first.
        """
        pairs, rank, left, right = self.pairs, self.rank, self.left, self.right
        ends_a = ends_b = NEVER
        while True:
            q = pairs.get(a << ID_BITS | b)
            if q is not None:
                q >>= ID_BITS
                if q < ends_a and q <= ends_b:
                    return False
            if rank[a] >= rank[b]:
                if rank[a] < 0:
                    return True
                ends_a, a = rank[a], right[a]
            else:
                ends_b, b = rank[b], left[b]

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one pre-token that arrives in blocks of any size.

        State: for each byte after the last id emitted, the token that ends there.
        """
        go, back, longest, shorter, sizes, known = self.next, self.back, self.longest, self.shorter, self.sizes, self.known
        ends: list[int] = [-1]  # ends[0]: the token before the bytes that are kept
        state, limit, window = 0, 4 * self.lookahead, self.lookahead
        for block in blocks:
            for byte in block:
                to = go.get(state << 8 | byte)
                while to is None:
                    state = back[state]
                    to = go.get(state << 8 | byte)
                state = to
                token, n = longest[state], len(ends)
                while True:
                    at = n - sizes[token]
                    if at >= 0:
                        before = ends[at]
                        if before < 0:
                            if at == 0:
                                break
                        else:
                            key = before << ID_BITS | token
                            fit = known.get(key)
                            if fit is None:
                                fit = self._look(key, before, token)
                            if fit:
                                break
                    token = shorter[token]
                    if token < 0:
                        raise ValueError("the merge list leaves a byte without a token")
                ends.append(token)
                if n > limit:  # tokens that end before the window are stable
                    out = self._chain(ends, n)
                    kept = n
                    while kept > n - window:
                        kept -= sizes[out.pop()]
                    self.emitted += len(out)
                    yield from out
                    del ends[:kept]
        out = self._chain(ends, len(ends) - 1)
        self.emitted += len(out)
        yield from out

    def _look(self, key: int, a: int, b: int) -> bool:
        fit = self.older.get(key)
        if fit is None:
            fit = self.fits(a, b)
        if len(self.known) >= PAIRS // 2:  # two generations, so that memory is bounded
            self.older = self.known.copy()
            self.known.clear()
        self.known[key] = fit
        return fit

    def _chain(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at])
            at -= self.sizes[ends[at]]
        return out[::-1]

    def stream(self, text: str) -> Iterator[int]:
        """The ids of any text, one pre-token after the other, each read in blocks."""
        at = 0
        found = self.marks.finditer(text) if self.marks is not None and any(s in text for s in self.special) else ()
        for start, end, mark in chain(((m.start(), m.end(), self.special[m.group()]) for m in found), [(len(text), len(text), -1)]):
            piece = text[at:start]  # blanks before a special token do not look past it
            for m in self.split.finditer(piece):
                a, b = m.span()
                yield from self.transduce(piece[i : min(i + BLOCK, b)].encode() for i in range(a, b, BLOCK))
            if mark >= 0:
                yield mark
            at = end

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = []
        split, transduce = self.split.findall, self.transduce
        for word in lead(words).to_pylist():
            for t in split(word):
                ids.extend(transduce((t.encode(),)))
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def encode_all(self, texts: pa.Array) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian 32-bit integers, in blocks."""
        texts = pc.fill_null(texts, "")
        plain = regular(texts, list(self.special))
        if (pc.max(pc.binary_length(texts)).as_py() or 0) > LONG:
            plain &= ~pc.match_substring_regex(texts, LONG_WORD).to_numpy(zero_copy_only=False)
        ids, counts = self.words.encode(texts.filter(pa.array(plain)))
        raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(counts)).tolist()
        parts = iter(zip([0, *ends], ends, strict=False))
        for p, t in zip(plain.tolist(), texts, strict=True):
            if p:
                a, b = next(parts)
                yield (raw[i : min(i + 4 * BLOCK, b)] for i in range(a, b, 4 * BLOCK))
            else:
                yield self.encode(t.as_py())

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of one text, read as a stream."""
        ids = self.stream(text or "")
        while block := list(islice(ids, BLOCK)):
            yield np.array(block, "<u4").tobytes()

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text from blocks of ids: an unfinished character waits for its bytes."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.table
        for block in blocks:
            yield machine.decode(b"".join([table[i] for i in np.frombuffer(block, "<u4").tolist()]))
        yield machine.decode(b"", True)


def digest(bpe: Bpe, blocks: Iterable[bytes]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
    ids, out, n = hashlib.sha256(), hashlib.sha256(), 0

    def seen() -> Iterator[bytes]:
        nonlocal n
        for block in blocks:
            ids.update(block)
            n += len(block) // 4
            yield block

    for piece in bpe.decode(seen()):
        out.update(piece.encode())
    return n, ids.hexdigest(), out.hexdigest()


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, then n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    names = [id_col, *keep]
    src = docs.select(*[F.col(c) for c in names], F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_worker(("bpe", path), lambda: Bpe(path))
        for *rest, texts in gathered(batches):
            got = [digest(bpe, blocks) for blocks in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return src.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and, as an array of ints, the ids of the text; a column ``out_col`` is replaced."""

    def run(texts: pa.Array) -> pa.Array:
        bpe = kept_in_worker(("bpe", path), lambda: Bpe(path))
        each = [np.frombuffer(b"".join(blocks), "<u4").astype(np.int32) for blocks in bpe.encode_all(texts)]
        return pa.array(each, pa.list_(pa.int32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out_col, F.arrow_udf(run, "array<int>")(F.col(text_col)))
