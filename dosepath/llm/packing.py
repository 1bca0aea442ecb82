"""Vector bin packing of examples into sequences, by the dot-product heuristic.

Every example is a vector of demands: tokens, one segment, and loss-bearing
tokens.  A sequence starts with the vector of its limits; the waiting example
that fits and has the largest dot product with what is left of the limits goes
in next.  When none fits whole, an example is cut whose head fills the rest of the
tokens (where cutting is allowed).  Tokens are never dropped: examples longer
than a sequence first give pieces that fill one alone, and their rest waits with
the others.

Loss-bearing tokens are those of spans of the text (answers in instruction data);
without spans, all tokens of a document but its first, which nothing precedes.

Each input partition is packed as a stream inside one task: nothing is shuffled,
memory holds one Arrow batch and a window of waiting examples, and a lost task
is repeated with the same result.  A sequence stays open while examples come, so
short ones fill it too; at most one sequence of a partition is left partly filled
by tokens, unless the limit of segments or of loss-bearing tokens closes it.

Nulls and edges: a null text is empty (its document is the end token alone); a
null doc_id stays null; null or empty spans bear no loss, spans may overlap and
reach beyond the text; repeated rows are packed each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import release, ship

ship(__name__)

SPECIAL = {"<|endoftext|>": 50256}  # of byte_bpe_50k.json; the file of ranks has none
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def byte_bpe(ranks: bytes, pattern: str, special: dict[str, int] | None = None):
    """(encoder of a list of texts, byte length of an id), from a file of ranks; strings of ``special`` get their ids, all else is ordinary text."""
    import tiktoken

    special = special or {}
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
    return (lambda texts: [own.encode(t, allowed_special="all") if any(x in t for x in special) else own.encode_ordinary(t) for t in texts]), lambda i: len(own.decode_single_token_bytes(i))


def loss_of(text: str, spans: list | None, sizes: list[int]) -> np.ndarray:
    """Which tokens (of these byte sizes, and the end token) start inside a span of code points; the end token does as the last one does."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # of code points
    bears = np.zeros(len(raw) + 1, np.int64)
    for s in spans or []:
        if s and s["start"] is not None and s["end"] is not None and s["end"] > s["start"]:
            lo, hi = (starts[min(max(0, x), len(starts) - 1)] for x in (s["start"], s["end"]))
            bears[lo] += 1
            bears[hi] -= 1
    at = np.r_[0, np.cumsum(sizes)[:-1]].astype(int) if sizes else np.zeros(0, int)
    found = bears.cumsum()[at] > 0
    return np.r_[found, found[-1:].any()]


class Packer:
    """Packs a stream of examples; ``put`` and ``end`` yield (item, sequence, offset, start, length).

    limits: tokens, segments, loss-bearing tokens of a sequence.  An example comes
    with the running count of its loss-bearing tokens (from 0, one entry more than
    tokens).
    """

    def __init__(self, limits: tuple[int, int, int], window: int, cut: bool):
        self.limits = np.array(limits, dtype=np.int64)
        self.window, self.cut = window, cut
        self.need = np.zeros((window + 1, 3), dtype=np.int64)
        self.start = np.zeros(window + 1, dtype=np.int64)
        self.items: list = []
        self.sequence, self.next = 0, 1
        self.left, self.offset = self.limits.copy(), 0

    def head(self, losses: np.ndarray, start: int, tokens: int, loss: int) -> int:
        """Tokens from ``start`` on that stay within ``tokens`` and ``loss``."""
        end = min(start + tokens, len(losses) - 1)
        return int(np.searchsorted(losses[start : end + 1], losses[start] + loss, side="right")) - 1

    def put(self, item, losses: np.ndarray):
        start, size = 0, len(losses) - 1
        while size - start >= self.limits[0] or losses[size] - losses[start] > self.limits[2]:
            first = self.head(losses, start, int(self.limits[0]), int(self.limits[2]))
            if not first:
                raise ValueError("a token bears more loss than a sequence may")
            yield item, self.next, 0, start, first  # alone
            self.next += 1
            start += first
        if start == size:
            return
        k = len(self.items)
        self.need[k] = size - start, 1, losses[size] - losses[start]
        self.start[k] = start
        self.items.append((item, losses))
        while len(self.items) > self.window:
            yield from self._place()

    def end(self):
        while self.items:
            yield from self._place()

    def _put_in(self, k: int, size: int):
        item, losses = self.items[k]
        start = int(self.start[k])
        piece = item, self.sequence, self.offset, start, size
        self.left -= (size, 1, losses[start + size] - losses[start])
        self.offset += size
        if size == self.need[k, 0]:
            last = len(self.items) - 1
            self.need[k], self.start[k], self.items[k] = self.need[last], self.start[last], self.items[last]
            self.items.pop()
        else:
            self.start[k] += size
            self.need[k] = self.need[k, 0] - size, 1, losses[-1] - losses[start + size]
        return piece

    def _place(self):
        """One more piece in the open sequence, or a new sequence."""
        need = self.need[: len(self.items)]
        fits = (need <= self.left).all(axis=1)
        if fits.any():
            weigh = (need / self.limits) @ (self.left / self.limits)
            weigh[~fits] = -1
            k = int(weigh.argmax())
            yield self._put_in(k, int(need[k, 0]))
            return
        if self.cut and (self.left[:2] > 0).all():
            size = int(self.left[0])
            best, most = -1, 0
            for k in np.argsort(np.where(need[:, 0] > size, need[:, 0], np.iinfo(np.int64).max), kind="stable").tolist():  # the least remainder first
                first = self.head(self.items[k][1], int(self.start[k]), min(size, int(need[k, 0]) - 1), int(self.left[2]))
                if first > most:
                    best, most = k, first
                if most == size:
                    break
            if most:
                yield self._put_in(best, most)
                return
        self.sequence, self.next = self.next, self.next + 1
        self.left, self.offset = self.limits.copy(), 0


def pack(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    *,
    special: dict[str, int] | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int | None = None,
    max_loss_tokens: int | None = None,
    loss: str | None = None,
    window: int = 256,
    cut: bool = True,
) -> DataFrame:
    """Tokenise and pack all rows of ``docs`` (doc_id, text).

    ``special``: ids of the tokenizer's special tokens, as they are found in texts.
    Limits of a sequence: ``max_tokens``, ``max_segments`` pieces and
    ``max_loss_tokens`` tokens that bear loss; the latter two are ``max_tokens``
    unless given, so that plain documents are padded by neither.  ``loss``: a column
    of spans (array of struct of start, end in code points) whose tokens bear loss.
    With ``cut=False`` only documents longer than a sequence are cut.
    """
    limits = max_tokens, max_segments or max_tokens, max_loss_tokens or max_tokens
    with open(ranks_file, "rb") as f:  # on the driver; executors get the bytes, about 1 MB
        ranks = f.read()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bytes_of = byte_bpe(ranks, pattern, special)
        base = TaskContext.get().partitionId() << 32
        packer = Packer(limits, window, cut)
        out: list[tuple] = []

        def place(item, sequence, offset, start, length):
            doc_id, ids, losses = item
            own = ids[start : start + length]
            out.append((doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), base + sequence, offset, int(losses[start + length] - losses[start])))

        def drained():
            rows, out[:] = out[:], []
            names = [c.split()[0] for c in OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids_of), 64):
                some = [t or "" for t in texts.slice(lo, 64).to_pylist()]
                spans = batch.column("loss").slice(lo, 64).to_pylist() if loss else [None] * len(some)
                for doc_id, text, own, ids in zip(ids_of[lo : lo + 64], some, spans, encode(some), strict=True):
                    bears = loss_of(text, own, [bytes_of(i) for i in ids]) if loss else np.arange(len(ids) + 1) > 0
                    ids.append(end_id)
                    losses = np.r_[0, bears.cumsum()]
                    for x in packer.put((doc_id, np.array(ids, dtype="<u4"), losses), losses):
                        place(*x)
                if len(out) > 5000:
                    yield drained()
        for x in packer.end():
            place(*x)
        if out:
            yield drained()
        release()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if loss:
        columns.append(F.col(loss).cast("array<struct<start:long,end:long>>").alias("loss"))
    return docs.select(*columns).mapInArrow(packed, OUT)
