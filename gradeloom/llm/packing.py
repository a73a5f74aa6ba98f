"""Packing documents into training sequences by order-preserving dynamic programming.

The tokens of a partition's documents form one stream, in the order in which they are
read. Cuts of the stream into windows of at most ``length`` tokens are chosen so that
padding plus penalties is smallest:

    best[j] = min over i in [j - length, j) of  best[i] + (length - (j - i)) + penalty[j]

``penalty`` is 0 at the end of a document, small after a sentence and larger elsewhere.
Everything that depends on i is ``best[i] + i``, so the minimum over the sliding range is
the head of a monotone queue and each candidate enters and leaves it once. A window whose
length is a power of two needs no padding; the last window of a partition is therefore
cut into powers of two.

Nothing is shuffled: a partition packs what it reads, in blocks of bounded size, and what
follows the last cut of a block is carried into the next one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from gradeloom.llm.tokens import encoder

#: Cost of a cut, in tokens of padding.
AFTER_SENTENCE, INSIDE_SENTENCE = 24, 96
#: Distance of further candidates where no sentence ends for long.
GAP = 64
#: Tokens of a block, a bound of a task's memory.
BLOCK = 1 << 20

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(np, ids, ends, closing):
    """Positions where the stream may be cut, with their penalties, in order."""
    kind = np.full(len(ids) + 1, -1, np.int64)
    kind[1:][closing[ids]] = AFTER_SENTENCE
    kind[ends] = 0
    kind[0] = 0
    at = np.flatnonzero(kind >= 0)
    steps = np.diff(at)
    wide = np.flatnonzero(steps > GAP)
    if len(wide):
        more = np.concatenate([np.arange(at[w] + GAP, at[w + 1], GAP) for w in wide])
        kind[more] = INSIDE_SENTENCE
        at = np.flatnonzero(kind >= 0)
    return at, kind[at]


def windows(at: list[int], penalties: list[int], length: int) -> list[int]:
    """Cuts (first and last position included) of least cost; ``at`` has no step above ``length``."""
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    keys = [at[0]] + [0] * (len(at) - 1)
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = keys[i] + length - here + penalties[j]
        keys[j] = key = best[j] + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return [at[0], *reversed(cuts)]


def powers(length: int) -> list[int]:
    """``length`` as powers of two, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack(
    docs: DataFrame, length: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``length`` tokens.

    A document's tokens are the ids of its text followed by ``end_id``; a null text is
    empty, so its document is one token. Every token lies in exactly one piece. Columns:
    the id, ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32``
    of the little-endian ids, ``doc_tokens``, ``sequence_id`` (partition and number in it)
    and ``offset`` in the sequence; with ``with_ids`` the ids too. ``length`` has to be a
    power of two. Sequences shorter than ``length`` are to be padded unless their length is
    a power of two. Documents with equal or null ids are separate documents; an empty table
    gives no rows; only the id and the text are read, so other columns cannot clash.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("length has to be a power of two")
    vocabulary_file = vocabulary

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = encoder(vocabulary_file)
        # a token closes a sentence if its text ends in a stop or holds a line end
        closing = np.zeros(bpe.n_vocab, bool)
        for token in range(bpe.n_vocab):
            piece = bpe.decode_single_token_bytes(token).rstrip(b' "\')')
            closing[token] = piece[-1:] in (b".", b"!", b"?") or b"\n" in piece
        closing[end_id] = False  # its ends are document ends
        base, number = TaskContext.get().partitionId() << 33, 0
        docs: list = []  # [id, ids, tokens of it before this block]
        held = 0
        found: list[tuple] = []

        def place(cuts, stream_docs, ids):
            """Record the pieces between the cuts; documents are in the order of the stream."""
            nonlocal number
            sizes = [len(d[1]) for d in stream_docs]
            d, begin = 0, 0  # current document and its position in the stream
            for low, high in zip(cuts, cuts[1:]):
                at = low
                while at < high:
                    while begin + sizes[d] <= at:
                        begin += sizes[d]
                        d += 1
                    stop = min(high, begin + sizes[d])
                    name, _, before, total = stream_docs[d]
                    part = ids[at:stop]
                    found.append((name, before + at - begin, stop - at, zlib.crc32(part.tobytes()), total, base + number, at - low, part if with_ids else None))
                    at = stop
                number += 1

        def solve(last: bool):
            nonlocal docs, held
            if not docs:
                return
            ids = np.concatenate([d[1] for d in docs])
            ends = np.cumsum([len(d[1]) for d in docs])
            at, cost = candidates(np, ids, ends, closing)
            cuts = windows(at.tolist(), cost.tolist(), length)
            if last:
                tail = cuts.pop() - cuts[-1] if len(cuts) > 1 else 0
                for size in powers(tail):
                    cuts.append(cuts[-1] + size)
            else:
                cuts.pop()  # the last window may still grow
            place(cuts, docs, ids)
            done, rest, begin = cuts[-1], [], 0
            for name, own, before, total in docs:
                stop = begin + len(own)
                if stop > done:
                    skip = max(0, done - begin)
                    rest.append((name, own[skip:], before + skip, total))
                begin = stop
            docs, held = rest, len(ids) - done

        def rows():
            nonlocal found
            names, start, size, crc, total, sequence, offset, parts = zip(*found) if found else [()] * 8
            found = []
            columns = [pa.array(names, id_type), *(pa.array(c, pa.int64()) for c in (start, size, crc, total, sequence, offset))]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=out_names)

        id_type = pa.int64()
        out_names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(bpe.encode(text or "", allowed_special="all") + [end_id], "<u4")
                docs.append((name, ids, 0, len(ids)))
                held += len(ids)
                if held >= BLOCK:
                    solve(False)
            if found:
                yield rows()
        solve(True)
        if found:
            yield rows()

    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, {FIELDS}" + (", ids array<int>" if with_ids else "")
    return docs.select(id_column, text_column).mapInArrow(run, schema)
