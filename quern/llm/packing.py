"""Packing of token sequences into windows by non-negative least squares.

Documents longer than the window fill whole windows first. The histogram of what remains of each document is
held against combinations of two or three lengths that fill a window exactly: all pairs, and triples with two of
the ``TOP`` most frequent lengths. Least squares with counts of at least 0 tell how often to use each; they are
rounded down to what the histogram has. Residuals are packed greedily: the longest, then each time the longest that still
fits, as often as the counts allow, where windows come out full. Documents of a length take the places of that length in
turn. What then fills no window is laid end to end, shortest first, and cut at windows; the last window is cut at powers
of two, which need no padding.

The plan's size depends on the window and ``SALTS`` alone. A document finds its place from its turn among those of
its length, counted in ``SALTS`` parts so that a frequent length is never in one task. Null or empty texts have the
end id alone. Repeated rows are packed each. An empty table gives no pieces. All order comes from a row number
written with the tokens, so ties don't matter. Very long texts fill whole windows; their ids are held by one task. Columns
not in ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.token_files import token_table
from quern.llm.tokens import crc32
from quern.sources.scratch import written

TOP = 64
SWEEPS = 200
#: Least and most parts of each length; between them, one for so many documents.
SALTS, SALT_ROWS = (16, 1024), 250_000


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Tuples of two or three present lengths that fill the window (the histogram's length) exactly."""
    window = len(histogram)
    present = histogram > 0
    found = [(a, window - a) for a in range(1, window // 2 + 1) if present[a] and present[window - a]]
    top = sorted(int(a) for a in np.argsort(-histogram, kind="stable")[:TOP] if a and present[a])
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c >= 1 and present[c] and not (c in top and c < b):
                found.append((a, b, c))
    return found


def least_squares(combos: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Counts of at least 0 whose lengths come closest to the histogram, by coordinate descent."""
    x = np.zeros(len(combos))
    rest = histogram.astype(float)
    for _ in range(SWEEPS):
        moved = 0.0
        for k, combo in enumerate(combos):
            parts = {a: combo.count(a) for a in combo}
            step = sum(n * rest[a] for a, n in parts.items()) / sum(n * n for n in parts.values())
            step = max(step, -x[k])
            if step:
                x[k] += step
                for a, n in parts.items():
                    rest[a] -= n * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def repeats(combos: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """The least-squares counts as integers that the histogram allows."""
    x = least_squares(combos, histogram)
    left = histogram.copy()
    counts = np.zeros(len(combos), np.int64)
    for room in (np.floor(x + 1e-9), np.full(len(combos), np.inf)):  # the rounded counts, then what still fits
        for k in np.argsort(-x, kind="stable"):
            combo = combos[k]
            n = int(min(room[k], *(left[a] // combo.count(a) for a in combo)))
            if n > 0:
                counts[k] += n
                for a in combo:
                    left[a] -= n
    return counts


def greedy(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Windows that come out full, longest lengths first, and how often each is filled; takes them off ``left``.

    Every round uses up a length of its window or puts its longest aside, so there are few rounds.
    """
    window, found = len(left), []
    aside = np.zeros(window, bool)
    while len(open_ := np.flatnonzero((left > 0) & ~aside)):
        combo, room, free = [int(open_[-1])], window - int(open_[-1]), left.copy()
        free[combo[0]] -= 1
        while room and len(fits := np.flatnonzero(free[: room + 1] > 0)):
            a = int(fits[-1])
            many = min(int(free[a]), room // a)
            combo += [a] * many
            free[a] -= many
            room -= a * many
        if room:
            aside[combo[0]] = True
            continue
        n = int(min(left[a] // combo.count(a) for a in set(combo)))
        found.append((tuple(combo), n))
        for a in combo:
            left[a] -= n
    return found


@dataclass
class Plan:
    """Where the n-th document of a remaining length goes."""

    window: int
    planned: np.ndarray  # by length: how many go into combinations
    lows: list[np.ndarray]  # by length: first turn of each run of places
    sequences: list[np.ndarray]  # its first sequence
    offsets: list[np.ndarray]
    left_base: np.ndarray  # by length: tokens before the left ones of that length
    left_first: int  # first sequence of what is left
    tail: np.ndarray  # starts of the last sequences, beyond whole windows
    whole: int  # tokens of whole windows among what is left

    def places(self, length: int, turn: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of one remainder."""
        if turn < self.planned[length]:
            k = int(np.searchsorted(self.lows[length], turn, side="right")) - 1
            return [(int(self.sequences[length][k]) + turn - int(self.lows[length][k]), int(self.offsets[length][k]), length)]
        at = int(self.left_base[length]) + (turn - int(self.planned[length])) * length
        end, pieces = at + length, []
        while at < end:
            if at < self.whole:
                number, offset = divmod(at, self.window)
                size = min(end - at, self.window - offset)
            else:
                k = int(np.searchsorted(self.tail, at - self.whole, side="right")) - 1
                number, offset = self.whole // self.window + k, at - self.whole - int(self.tail[k])
                size = min(end - at, int(self.tail[k + 1]) - (at - self.whole)) if k + 1 < len(self.tail) else end - at
            pieces.append((self.left_first + number, offset, size))
            at += size
        return pieces


def plan(histogram: np.ndarray, first: int) -> Plan:
    """``histogram``: documents by remaining length, 0 to window - 1. ``first``: the first free sequence."""
    window = len(histogram)
    combos = combinations(histogram)
    counts = repeats(combos, histogram)
    left = histogram.copy()
    for combo, n in zip(combos, counts.tolist(), strict=True):
        for a in combo:
            left[a] -= n
    rest = greedy(left)
    combos, counts = combos + [c for c, _ in rest], np.append(counts, [n for _, n in rest]).astype(np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
    planned = np.zeros(window, np.int64)
    for combo, n in zip(combos, counts.tolist(), strict=True):
        offset = 0
        for a in combo if n else ():
            runs[a].append((int(planned[a]), first, offset))
            planned[a] += n
            offset += a
        first += n
    left = (histogram - planned) * np.arange(window)
    total = int(left.sum())
    rest, tail = total % window, [0]
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    column = lambda k: [np.array([r[k] for r in rs], np.int64) for rs in runs]
    return Plan(window, planned, column(0), column(1), column(2), np.cumsum(left) - left, first, np.array(tail[:-1] or [0]), total - total % window)


def pack(tokens: DataFrame, window: int, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """A row for each piece of the rows of ``tokens`` (from token_table, with a column row).

    Returns the ``keep`` columns, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids
    (little-endian, 4 bytes each).
    """
    spark = tokens.sparkSession
    rows = tokens.count()
    salts = int(min(max(rows // SALT_ROWS, SALTS[0]), SALTS[1]))
    placed = tokens.select(
        F.struct(*keep).alias("kept"), "row", "ids", "n_tokens", (F.col("n_tokens") % window).cast("int").alias("rest"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt")
    )
    cells = placed.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"n_tokens div {window}")).alias("full")).toArrow()
    n, full = (np.zeros((window, salts), np.int64) for _ in range(2))
    at = cells["rest"].to_numpy(), cells["salt"].to_numpy()
    n[at], full[at] = cells["n"].to_numpy(), cells["full"].to_numpy()
    turns = np.cumsum(n, axis=1) - n
    fulls = (np.cumsum(full.ravel()) - full.ravel()).reshape(window, salts)
    histogram = n.sum(axis=1)
    histogram[0] = 0
    shared = spark.sparkContext.broadcast((plan(histogram, int(full.sum())), turns, fulls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, turns, fulls = shared.value
        last, turn, done = None, 0, 0
        for batch in batches:
            kept = batch.column(0)
            sizes, rests, parts = (batch.column(k).to_pylist() for k in (2, 3, 4))
            width = 0
            out: list[tuple[int, ...]] = []
            raw: list[bytes] = []
            for i, (size, rest, salt) in enumerate(zip(sizes, rests, parts, strict=True)):
                buffer = batch.column(1)[i].as_buffer()
                width = len(buffer) // size
                ids = np.frombuffer(buffer, f"<u{width}").astype("<u4")
                if (rest, salt) != last:
                    last, turn, done = (rest, salt), int(turns[rest, salt]), int(fulls[rest, salt])
                whole = size // made.window
                pieces = [(done + k, 0, made.window) for k in range(whole)]
                done += whole
                if rest:
                    pieces += made.places(rest, turn)
                turn += 1
                start = 0
                for sequence, offset, length in pieces:
                    piece = ids[start : start + length]
                    out.append((i, start, length, crc32(piece), size, sequence, offset))
                    if with_ids:
                        raw.append(piece.tobytes())
                    start += length
            columns = list(zip(*out, strict=True)) or [()] * 7
            arrays = [kept.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(raw, pa.binary())] if with_ids else []), names=["kept", *PIECE, *(["ids"] if with_ids else [])])

    kept = placed.schema["kept"].dataType.simpleString()
    schema = f"kept {kept}, " + ", ".join(f"{c} long" for c in PIECE) + (", ids binary" if with_ids else "")
    dealt = placed.select("kept", "ids", "n_tokens", "rest", "salt", "row").repartition("rest", "salt").sortWithinPartitions("rest", "salt", "row")
    return dealt.mapInArrow(run, schema).select("kept.*", *PIECE, *(["ids"] if with_ids else []))


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = 2048, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Tokenizes ``docs`` and packs them."""
    tokens = written(token_table(docs, path, end_id, keep).withColumn("row", F.monotonically_increasing_id()), "tokens")
    return pack(tokens, window, keep, with_ids)
