"""Cost-balanced packing of tokenized documents into training sequences.

Method. Attention over a sequence costs ``linear * tokens + quadratic * sum(piece tokens ** 2)``.
Whole pieces of ``capacity`` tokens fill a sequence each. The rests are taken in windows, longest
first; each goes to the sequence of lowest cost that has room for it, and where none has room it is
cut over the cheapest sequences with room left. Windows are made inside a task, so nothing is
shuffled, memory is bounded by the window, and a task that is run again gives the same pieces.
The last tokens of a task, less than a sequence, go to sequences of a power of two in length, which
are not padded.

Defined cases: a null text is empty and yields the end id alone; repeated rows are packed like any
others; a very long text is cut to as many pieces as it wants; rests of equal length go in the order
they came, and of sequences of equal cost the first takes the next; other columns are not looked at,
whatever their names; an empty table gives no pieces. Each id of a document lies in exactly one piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.llm.workers import tidy

PIECES = (
    "{id} string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, cost double"
)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text, as the vocabulary file of the same name for ``tokenizers`` gives them.

    The merges are the same; this reader is several times faster. Special strings in a text become
    their special id, as there.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path or default_ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )
    return lambda text: np.array(own.encode(text, allowed_special="all"), dtype="<u4")


def cost_of(lengths: list[int], linear: float = 1.0, quadratic: float = 1 / 1024) -> float:
    return linear * sum(lengths) + quadratic * sum(x * x for x in lengths)


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) of items no longer than ``capacity``.

    As many sequences as the tokens fill are opened; every one of them but the last is full.
    """
    total = sum(lengths)
    full, tail = divmod(total, capacity)
    rooms = [capacity] * full
    while tail:  # sequences of a power of two need no padding
        rooms.append(1 << (tail.bit_length() - 1))
        tail -= rooms[-1]
    room = np.array(rooms, dtype=np.int64)
    cost = np.zeros(len(rooms))
    pieces = []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    #: Lowest cost first. An entry is out of date once its sequence has taken another piece.
    heap = [(0.0, s) for s in range(len(rooms))]
    for i in order:
        left, at = lengths[i], 0
        if not left:
            continue
        aside = []
        while heap:
            c, s = heapq.heappop(heap)
            if c != cost[s] or not room[s]:
                continue
            if room[s] >= left:
                break
            aside.append((c, s))
            if len(aside) > 64:  # none near the cheapest has room: look at all at once
                fit = np.flatnonzero(room >= left)
                s = int(fit[np.argmin(cost[fit])]) if len(fit) else -1
                break
        else:
            s = -1
        if s >= 0:
            took = [(s, left)]
        else:  # cut over the cheapest that have room
            took = []
            for s2 in np.argsort(np.where(room > 0, cost, np.inf), kind="stable"):
                n = int(min(left, room[s2]))
                took.append((int(s2), n))
                left -= n
                if not left:
                    break
        changed = {s for s, _ in took}
        for e in aside:
            if e[1] not in changed:
                heapq.heappush(heap, e)
        for s, n in took:
            pieces.append((i, at, n, s))
            at += n
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            if room[s]:
                heapq.heappush(heap, (cost[s], s))
    return pieces


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    ranks_path: str | None = None,
    window_tokens: int = 1 << 22,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece, with its place in a sequence; ``cost`` is the sequence's whole cost.

    ``window_tokens`` bounds the tokens that a task holds at once. With ``keep_ids`` the ids of each
    piece come along as an array.
    """
    schema = PIECES.format(id=f"`{id_col}`") + (", ids array<int>" if keep_ids else "")

    def flush(held: list, state: dict, last: bool) -> pd.DataFrame:
        out = []
        place: dict[int, tuple[int, list]] = {}

        def emit(doc, start, ids, n_doc, seq, offset, cost):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n_doc, seq, offset, cost) + ((ids.astype("int32"),) if keep_ids else ()))

        rests = []
        for doc, ids in held:
            n = len(ids)
            whole = n - n % capacity
            for start in range(0, whole, capacity):
                emit(doc, start, ids[start : start + capacity], n, state["next"], 0, cost_of([capacity], linear, quadratic))
                state["next"] += 1
            if n > whole:
                rests.append((doc, whole, ids[whole:], n))
        got = assign([len(r[2]) for r in rests], capacity, linear, quadratic)
        for i, at, n, s in got:
            place.setdefault(s, (0, []))[1].append((i, at, n))
        for s in sorted(place):
            items, offset = place[s][1], 0
            cost = cost_of([n for _, _, n in items], linear, quadratic)
            for i, at, n in items:
                doc, base, ids, n_doc = rests[i]
                emit(doc, base + at, ids[at : at + n], n_doc, state["next"], offset, cost)
                offset += n
            state["next"] += 1
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", *(["ids"] if keep_ids else [])]
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path)
        #: Tasks number their sequences from places of their own.
        state = {"next": TaskContext.get().partitionId() << 36}
        held, n = [], 0
        for b in batches:
            for doc, text in zip(b["i"], b["t"]):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                held.append((doc, ids))
                n += len(ids)
                if n >= window_tokens:
                    yield flush(held, state, False)
                    held, n = [], 0
        if held:
            yield flush(held, state, True)

    #: Ids go as strings: pandas would round whole numbers beside a null.
    out = docs.selectExpr(f"CAST(`{id_col}` AS STRING) AS i", f"`{text_col}` AS t").mapInPandas(tidy(run), schema)
    return out.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
