"""Packing documents into training sequences by multiway differencing.

Karmarkar-Karp keeps a heap of partial partitions into k windows and merges the
two with the largest imbalance, the fullest window of one with the emptiest of
the other. The windows come out near-equal; where one exceeds the capacity, its
surplus is cut off and moved to windows with room, and if none has room, the
window count rises and the group is packed again.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token id that ends a document.
END = 0
#: Remainders packed together; bounds the time of a group and the memory of a task.
GROUP = 512
#: Pieces that a task holds before it hands them on: 2 MB of ids where a sequence has 1024.
HELD = 512
#: No cut leaves a piece shorter than this, unless a document is.
LEAST_CUT = 16
#: Strings that are one id wherever a text holds them, as the vocabulary's ``tokenizers`` file has it.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Byte-level BPE from a rank file; special strings are single ids where ``allowed_special`` says so."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` in each of ``windows`` windows, by multiway differencing."""
    if windows == 1:
        return [list(range(len(lengths)))]
    halves: list[tuple[int, int]] = [(-1, -1)] * (len(lengths) + 1)  # node -> its two parts; node i + 1 is item i
    heap = []
    for i, n in enumerate(lengths):
        sums, nodes = np.zeros(windows, np.int64), np.zeros(windows, np.int64)
        sums[0], nodes[0] = n, i + 1
        heap.append((-n, i, sums, nodes))
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        sums, others = sums + other[::-1], others[::-1]
        both = np.flatnonzero((nodes > 0) & (others > 0))
        merged = np.where(nodes > 0, nodes, others)
        if len(both):
            merged[both] = np.arange(len(halves), len(halves) + len(both))
            halves.extend(zip(nodes[both].tolist(), others[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, merged))
        serial += 1
    found = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node] if node else []
        while stack:
            x = stack.pop()
            if x <= len(lengths):
                items.append(x - 1)
            else:
                stack.extend(halves[x])
        found.append(sorted(items))
    return found


def _level(windows: list[list[tuple[int, int, int]]], capacity: int, least: int) -> bool:
    """Cut surplus off windows over the capacity and move it to windows with room; False if some finds no room."""
    room = [capacity - sum(n for _, _, n in w) for w in windows]
    spare: list[tuple[int, int, int]] = []
    for at, window in enumerate(windows):
        while room[at] < 0:
            i = max(range(len(window)), key=lambda x: window[x][2])
            item, start, n = window[i]
            cut = min(max(-room[at], least), n)
            if n - cut < least:
                cut = n
                del window[i]
            else:
                window[i] = (item, start, n - cut)
            spare.append((item, start + n - cut, cut))
            room[at] += cut
    spare.sort(key=lambda x: (-x[2], x))
    free = [(-r, at) for at, r in enumerate(room) if r > 0]
    heapq.heapify(free)
    while spare:
        item, start, n = spare.pop(0)
        if not free:
            return False
        r, at = heapq.heappop(free)
        take = min(n, -r)
        if take < n:
            take = min(take, n - least)
            if take < least:
                return False
            spare.insert(0, (item, start + take, n - take))
        windows[at].append((item, start, take))
        if -r - take > 0:
            heapq.heappush(free, (r + take, at))
    return True


def pack(lengths: list[int], capacity: int, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(item, start, length)`` that cover every item, none over ``capacity``."""
    count = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = [[(i, 0, lengths[i]) for i in w] for w in difference(lengths, count)]
        if _level(windows, capacity, least):
            return [w for w in windows if w]
        count += 1


def _rows(batches, path: str, capacity: int, names: list[str]):
    encode, part, serial = tokenizer(path), TaskContext.get().partitionId(), 0
    waiting: list[tuple] = []  # (id, tokens of the remainder, start, tokens in all)
    out: list[tuple] = []

    def emit(window) -> None:
        nonlocal serial
        offset = 0
        for doc, tokens, start, total in window:
            out.append((doc, start, len(tokens), tokens.astype("<u4").tobytes(), total, (part << 32) + serial, offset))
            offset += len(tokens)
        serial += 1

    def flush() -> None:
        for window in pack([len(x[1]) for x in waiting], capacity):
            emit([(d, tokens[s : s + n], start + s, total) for i, s, n in window for d, tokens, start, total in [waiting[i]]])
        waiting.clear()

    def batch():
        columns = list(zip(*out)) if out else [[]] * 7
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        out.clear()
        return found

    kinds = None
    for got in batches:
        kinds = [got.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for doc, text in zip(got.column(0).to_pylist(), got.column(1)):
            tokens = np.append(encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(END)).astype(np.uint32)
            whole = len(tokens) // capacity * capacity
            for start in range(0, whole, capacity):
                emit([(doc, tokens[start : start + capacity], start, len(tokens))])
                if len(out) >= HELD:
                    yield batch()
            if whole < len(tokens):
                waiting.append((doc, tokens[whole:].copy(), whole, len(tokens)))
            if len(waiting) >= GROUP:
                flush()
            if len(out) >= HELD:
                yield batch()
    if waiting:
        flush()
    if kinds:
        yield batch()


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """Pieces of packed sequences: ``(id_col, start, length, ids binary, doc_tokens, sequence_id, offset)``.

    A document is its token ids and one end id (0); a null or empty text is the
    end id alone. ``ids`` holds the piece as little-endian unsigned 32-bit ids,
    ``start`` counts the document's ids before it, ``offset`` those before it in
    its sequence. A document that fills whole sequences gives those first; the
    remainders of up to ``GROUP`` documents are packed together. Each input row
    is packed by itself, so repeated rows and null ids are kept. Documents stay
    in their partition: nothing is shuffled, and a task holds one group. An
    empty table gives an empty result; other columns are not read.
    """
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(lambda batches: _rows(batches, path, capacity, names), schema)
