"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs the documents of its own partition as they come. Whole windows are
cut off a long document. What remains is placed into an open window of that fill for
which the sum of squared numbers of open windows, over all fills, becomes smallest, or
opens a window. An array has the number of open windows of each fill, to the token, and
the choice is one pass over it. The rule keeps windows spread over all fills, so the
longer a partition goes on, the more documents find a window that they complete.

At the end of a partition the windows still open are merged, pieces being cut to fill the
fullest from the emptiest, and the last one is cut into powers of two.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from tensorloom.llm.common import pick, trimmed

WINDOW, END = 2048, 1
#: Tokens in a task's open windows beyond which these are merged, as at the end of a partition.
HELD = 8 << 20
#: Units of text whose ids a worker remembers, and their length; the memory starts anew beyond it.
REMEMBERED, UNIT = 100_000, 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of whole texts, as little-endian 32-bit bytes.

    A text is cut before each single space. The tokenizer's pattern puts a space
    in front of what follows, so such units have ids of their own; a unit that is
    empty or starts with white space may share a run of white space with the unit
    before it, and then the whole text is encoded at once. Short units repeat, and
    their ids are remembered.
    """

    def __init__(self, tokenizer: str, ranks: str | None) -> None:
        self.path, self.whole_ = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f).get("added_tokens") or ()]
        if ranks:  # the same vocabulary, encoded faster
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            self.encode = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        self.seen: dict[str, bytes | None] = {}

    @property
    def whole(self):
        """The tokenizer itself, read when a text first needs it."""
        if self.whole_ is None:
            from tokenizers import Tokenizer

            self.whole_ = Tokenizer.from_file(self.path)
        return self.whole_

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self.encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        seen = self.seen
        first, *units = text.split(" ")
        try:
            return self._bytes(first) + b"".join([seen[u] for u in units])
        except KeyError:
            pass
        except TypeError:
            return self._bytes(text)
        if len(seen) > REMEMBERED:
            seen.clear()
        out = [self._bytes(first)]
        for u in units:
            if u in seen:
                ids = seen[u]
            else:
                ids = None if not u or u[0].isspace() else self._bytes(" " + u)
                if len(u) <= UNIT:
                    seen[u] = ids
            if ids is None:
                return self._bytes(text)
            out.append(ids)
        return b"".join(out)


class Piece:
    """``ids`` of a document from token ``start``; ``total`` tokens has the document."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start: int, ids: bytes, total: int) -> None:
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def front(self, n: int) -> Piece:
        """Cut the first ``n`` tokens off."""
        cut = Piece(self.doc_id, self.start, self.ids[: n * 4], self.total)
        self.start, self.ids = self.start + n, self.ids[n * 4 :]
        return cut


class Window:
    __slots__ = ("pieces", "fill")

    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.fill = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece)


class SumOfSquares:
    """Open windows by fill, and their numbers in an array."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.fills: dict[int, list[Window]] = {}
        #: tokens in open windows
        self.held = 0
        #: windows closed so far: cut off long documents, completed by a placement, and by merging at the end
        self.whole = self.placed = self.merged = 0
        self.closed: list[list[tuple]] = []

    def add(self, doc_id, ids: bytes) -> None:
        piece = Piece(doc_id, 0, ids, len(ids) // 4)
        while len(piece) >= self.window:
            whole = Window()
            whole.put(piece.front(self.window))
            self._close(whole)
            self.whole += 1
        if len(piece):
            self.place(piece)

    def choose(self, n: int) -> int:
        """The fill with the smallest sum of squares after a piece of ``n`` tokens went there;
        of equals the fullest. 0 opens a window. A window leaves its fill and enters
        another; a full one counts no more."""
        counts, last = self.counts, self.window - n
        change = 2 * (counts[n : self.window] - counts[:last]) + 2  # from fill h to h + n
        change = np.append(change, 1 - 2 * counts[last])
        change[counts[: last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[n] + 1
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> None:
        fill = self.choose(len(piece))
        if fill:
            window = self.fills[fill].pop()
            self.counts[fill] -= 1
        else:
            window = Window()
        window.put(piece)
        if window.fill == self.window:
            self._close(window)
            self.placed += 1
            self.held -= self.window - len(piece)
            return
        self._open(window)
        self.held += len(piece)
        if self.held > HELD:
            window = self.merge()
            if window is not None:
                self._open(window)
                self.held = window.fill

    def _open(self, window: Window) -> None:
        self.fills.setdefault(window.fill, []).append(window)
        self.counts[window.fill] += 1

    def merge(self) -> Window | None:
        """Fill the fullest open windows from the emptiest; at most one is left, which is returned."""
        left = sorted((w for own in self.fills.values() for w in own), key=lambda w: -w.fill)
        self.counts[:], self.fills, self.held = 0, {}, 0
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            window = left[lo]
            while window.fill < self.window and hi > lo:
                gap, source = self.window - window.fill, left[hi]
                piece = source.pieces[-1]
                if len(piece) <= gap:
                    window.put(source.pieces.pop())
                    source.fill -= len(piece)
                else:
                    window.put(piece.front(gap))
                    source.fill -= gap
                if not source.fill:
                    hi -= 1
            lo += 1
            if window.fill < self.window:
                return window
            self._close(window)
            self.merged += 1
        return None

    def finish(self) -> None:
        """Merge what is open, and cut the last window into powers of two."""
        window = self.merge()
        if window is None:
            return
        bits, rest = window.fill, window.pieces
        for k in range(bits.bit_length() - 1, -1, -1):
            if bits >> k & 1:
                part, room = Window(), 1 << k
                while part.fill < room:
                    gap = room - part.fill
                    part.put(rest.pop(0) if len(rest[0]) <= gap else rest[0].front(gap))
                self._close(part)

    def _close(self, window: Window) -> None:
        """Of a closed window only what is returned is kept."""
        self.closed.append([(p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.total) for p in window.pieces])

    def drain(self) -> list[list[tuple]]:
        out, self.closed = self.closed, []
        return out


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` and ``ranks`` are the paths of one public byte-level vocabulary in
    its two formats (by default ``byte_bpe_50k``); without ``ranks`` the slower
    library encodes alone. A document's ids end with id 1. ``sequence_id`` has the
    task's partition in its upper bits. Sequences are full, but for a few at the
    end of a partition whose lengths are powers of two: nothing is padded.

    Null text counts as empty: one piece, the end id. A null id is passed on.
    Repeated rows are packed one by one. An empty table gives no rows; columns not
    named are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer, ranks = str(tokenizer), ranks and str(ranks)
    src = pick(df, doc_id=id_col, text_=text_col)
    src = src.select(src.doc_id.cast("long"), src.text_.cast("string"))
    end = np.asarray([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = Tokens(tokenizer, ranks), SumOfSquares(window)
        number = TaskContext.get().partitionId() << 40

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(7)]
            for pieces in windows:
                at = 0
                for piece in pieces:
                    for column, x in zip(out, (*piece, number, at), strict=True):
                        column.append(x)
                    at += piece[2]
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, tokens(text.as_py() or "") + end)
            yield rows(packer.drain())
        packer.finish()
        yield rows(packer.drain())

    return src.mapInArrow(trimmed(run), SCHEMA)
