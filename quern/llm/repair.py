"""Conversation structure repaired by the cheapest edits: keep, rerole, delete, insert.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. A row is kept (0), given
the role user or assistant (2) or deleted (3); an empty turn of either role is inserted for 2; a truncated row that stays
costs 1 more, blank and repeated rows must go. The edits follow a dynamic program over the rows that stay: for each such row
and its role, the best price is the least, over the role before it, of that role's running minimum (its price less the
prefix sum of deletions up to it) plus the prefix sum up to the row, so that a gap costs nothing to price, plus the inserts
that the pair of roles asks for. Of equal prices the ASCII-least audit wins: deletions, then inserts, stand before a row
that stays, which is the least order they can have. The audit fixes every role.

Conversations are cut in pieces of bounded rows and bytes, so one may be spread over any number of tasks. A piece gives the
price and audit for each role before it and each last role in it; those of a conversation's pieces are joined in order, with
ranks in place of the audits so far, and each piece then repairs its rows under the roles chosen for it. Within a piece all
audits hold as many rows and end with a row, so none is the start of another and ranks decide as whole audits would.

Rows are ordered by turn (null first), then role, then the SHA-256 of the text; rows that are equal are counted before they
are sorted, and every one but the first is a repetition. A null text, role or id in a key counts as one space; null
conversations are one conversation. A role that starts with none of s, u and a, or is empty, can't be kept. Very long texts
are held whole, each in one piece. Empty tables give no rows. Further columns are not read, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.sources.scratch import written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Distinct rows and characters of text in a piece; a longer row is a piece of its own.
PIECE_ROWS, PIECE_CHARS = 512, 1 << 20
#: Pieces in one broadcast of the roles chosen for them, some 60 bytes each; more are joined by a shuffle.
BROADCAST_PIECES = 200_000
SPACE = " \t\n\x0b\x0c\r"
#: Inserts between a role (empty: nothing yet) and the next; other pairs can't follow each other.
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Inserts after the last role.
TAIL = {"": 0, "s": 2, "u": 1, "a": 0}
LEGAL = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) damaged by a checksum of their place; n is how often the row stands there, 0: dropped."""
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("_kind") == 0, " ").otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").when(F.col("_kind") == 0, " ").otherwise(F.col("role"))
    turn = F.when(F.col("_kind") != 0, F.col("turn"))
    count = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), count.alias("n"))


@dataclass
class Turn:
    """A row and how often it stands there; ``fault`` is that of the first."""

    role: str
    text: str
    n: int
    fault: str


def fault_of(text: str, first: bool) -> str:
    body = text.rstrip(SPACE)
    return "blank" if not body else "duplicate" if not first else "" if body[-1] in ".!?" else "truncated"


def moves(turns: Iterable[Turn], before: str) -> dict[str, tuple[int, str]]:
    """The least price and audit of a piece by its last role, where ``before`` is the last role before it."""
    best, at = {before: (0, "", 0)}, 0  # by last role: price less the deletions so far, audit, rows it covers
    for turn in turns:
        if turn.n and turn.fault in ("", "truncated"):
            kept = turn.role[:1]
            ways = [("u", REROLE, "R"), ("a", REROLE, "R")] + ([(kept, 0, "K")] if kept in ("s", "u", "a") else [])
            new: dict[str, tuple[int, str]] = {}
            for role, price, letter in ways:
                price += DELETE * at + TRUNCATED * (turn.fault == "truncated")
                for last, (net, audit, upto) in best.items():
                    inserts = INSERTS.get((last, role))
                    if inserts is not None:
                        way = (net + price + INSERT * inserts, audit + "D" * (at - upto) + "I" * inserts + letter)
                        new[role] = min(new.get(role, way), way)
            for role, (price, audit) in new.items():
                net = price - DELETE * (at + 1)
                if role in best:
                    old, before_it, upto = best[role]
                    if (old, before_it + "D" * (at + 1 - upto)) <= (net, audit):
                        continue
                best[role] = (net, audit, at + 1)
        at += turn.n
    return {role: (net + DELETE * at, audit + "D" * (at - upto)) for role, (net, audit, upto) in best.items()}


def ended(ways: dict[str, tuple[int, str]]) -> str:
    """The last role of the cheapest whole conversation."""
    return min(ways, key=lambda role: (ways[role][0] + INSERT * TAIL[role], ways[role][1] + "I" * TAIL[role]))


def repaired(turns: Iterable[Turn], audit: str, before: str) -> list[dict]:
    """The turns that an audit leaves or makes."""
    rows = iter(turn for turn in turns for _ in range(turn.n))
    made, last = [], before
    for letter in audit:
        turn = None if letter == "I" else next(rows)
        if letter == "D":
            continue
        role = turn.role if letter == "K" else "assistant" if last == "u" else "user"
        made.append({"role": role, "text": "" if turn is None else turn.text})
        last = role[:1]
    return made


@dataclass
class Piece:
    """Consecutive rows of one conversation in one task."""

    conv: object
    opens: bool  # whether the conversation certainly starts here
    turns: list[Turn] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    n_turns: int = 0
    low: int | None = None
    high: int | None = None
    first_role: str | None = None
    last_role: str | None = None

    def add(self, turn: int | None, row: Turn) -> None:
        if not row.n:
            return
        self.turns.append(row)
        self.chars += len(row.text)
        if row.fault == "blank":
            self.blank += row.n
        else:
            self.duplicate += row.n - (row.fault != "duplicate")
            self.truncated += row.fault == "truncated"
        initial = row.role[:1]
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in LEGAL
        else:
            self.first_role = initial
        self.illegal += row.n - 1
        self.last_role = initial
        if turn is not None:
            self.n_turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self, row: Turn, most: int) -> bool:
        return bool(self.turns) and (len(self.turns) >= most or self.chars + len(row.text) > PIECE_CHARS)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high")
_TURN = "struct<role string, text string, n long, fault string>"
_PIECE = (
    "_part int, _piece int, alone boolean, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, "
    f"first_role string, last_role string, ways array<struct<before string, last string, cost long, audit string>>, turns array<{_TURN}>"
)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Piece, bool]]:
    """Pieces of sorted rows, and whether each is a whole conversation. Markers tell which of equal texts is the first."""
    none = object()
    conv: object = none
    piece: Piece | None = None
    marked, runs, whole = None, 0, True
    for batch in batches:
        for of, turn, role, digest, text, n, kind in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if conv is none or of != conv:
                if piece is not None:
                    yield piece, whole and runs > 1
                conv, runs, whole = of, runs + 1, True
                piece = Piece(of, runs > 1)
            if not kind:
                marked = (turn, role, digest)
                continue
            row = Turn(role, text, n, fault_of(text, marked == (turn, role, digest)))
            if piece.full(row, most):
                yield piece, False
                piece, whole = Piece(of, False), False
            piece.add(turn, row)
    if piece is not None:
        yield piece, False


def _batches(rows: Iterator[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows some at a time: 256, or as many as pass the size of a piece."""
    held: list[dict] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += row.pop("_chars", 0)
        if len(held) == 256 or chars > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=kind)
            held, chars = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=kind)


def pieces_of(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) as pieces in order, with their prices and audits for all roles before and after."""
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    digest = F.unhex(F.sha2("text", 256))
    marks = rows.where("n > 0").select("conv_id", "turn", "role", digest.alias("digest")).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    marks = marks.select("conv_id", F.col("_first.turn").alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
    both = held.select("conv_id", "turn", "role", digest.alias("digest"), "text", "n", F.lit(1).alias("kind")).unionByName(marks)
    order = ["conv_id", "turn", "role", "digest"]
    ranges = both.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    made = StructType([rows.schema["conv_id"], *StructType.fromDDL(_PIECE).fields])
    kind = to_arrow_schema(made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        for k, (piece, alone) in enumerate(_cut(batches, piece_rows)):
            ways = [
                {"before": before, "last": last, "cost": cost, "audit": audit}
                for before in ([""] if piece.opens else TAIL)
                for last, (cost, audit) in moves(piece.turns, before).items()
            ]
            row = {"conv_id": piece.conv, "_part": part, "_piece": k, "alone": alone, **{c: getattr(piece, c) for c in COUNTS}}
            row |= {"first_role": piece.first_role, "last_role": piece.last_role, "ways": ways, "turns": [vars(t) for t in piece.turns], "_chars": piece.chars}
            yield row

    return written(ranges.mapInArrow(lambda batches: _batches(cut(batches), kind), made), "pieces")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The roles chosen before and at the end of each piece of conversations whose pieces come in order."""
    none = object()
    conv: object = none
    best: dict = {}
    places: list[tuple] = []
    last_role = last_turn = None

    def told() -> Iterator[dict]:
        if not places:
            return
        role = min(best, key=lambda r: (best[r][0] + INSERT * TAIL[r], best[r][1], TAIL[r]))
        chosen, trail = [role], best[role][2]
        while trail is not None:
            trail, before = trail
            chosen.append(before)
        chosen.reverse()
        for k, (part, piece, illegal, again) in enumerate(places):
            yield {"_p": part, "_k": piece, "piece": k, "before": chosen[k], "last": chosen[k + 1], "ends": k + 1 == len(places), "more_illegal": illegal, "again": again}

    for batch in batches:
        for row in batch.to_pylist():
            if conv is none or row["conv_id"] != conv:
                yield from told()
                conv, places, last_role, last_turn = row["conv_id"], [], None, None
                best = {"": (0, 0, None)}
            ways: dict = {}
            for way in row["ways"]:
                if way["before"] in best:
                    cost, rank, trail = best[way["before"]]
                    found = (cost + way["cost"], rank, way["audit"])
                    if way["last"] not in ways or found < ways[way["last"]][0]:
                        ways[way["last"]] = (found, (trail, way["before"]))
            ranks = {audits: k for k, audits in enumerate(sorted({found[1:] for found, _ in ways.values()}))}
            best = {role: (found[0], ranks[found[1:]], trail) for role, (found, trail) in ways.items()}
            illegal = last_role is not None and row["first_role"] is not None and last_role + row["first_role"] not in LEGAL
            again = last_turn is not None and row["low"] == last_turn
            places.append((row["_part"], row["_piece"], int(illegal), int(again)))
            last_role = last_role if row["last_role"] is None else row["last_role"]
            last_turn = last_turn if row["high"] is None else row["high"]
    yield from told()


_CHOICE = "_p int, _k int, piece int, before string, last string, ends boolean, more_illegal long, again long"
_DONE = "piece int, ends boolean, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, cost long, audit string, repaired array<struct<role string, text string>>"


def repaired_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) repaired, as pieces of their conversations.

    Returns conv_id, piece (from 0), ends (the last), alone (the only one, by itself in a task), counts of faults and of
    illegal neighbours, n_turns (distinct turns not counted by the piece before), low, high (turns), cost, audit and
    repaired (role and text of the turns that the piece leaves, in order). Rows of n = 0 only tell that there is a
    conversation.
    """
    cut = pieces_of(rows, piece_rows)
    narrow = cut.where(~F.col("alone")).select("conv_id", "_part", "_piece", "ways", "first_role", "last_role", "low", "high")
    choice_kind = to_arrow_schema(StructType.fromDDL(_CHOICE))


    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_joined(batches), choice_kind)

    choices = written(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_piece").mapInArrow(join, _CHOICE), "choices")
    few = choices.count() <= BROADCAST_PIECES
    met = cut.where(~F.col("alone")).join(F.broadcast(choices) if few else choices, (F.col("_part") == F.col("_p")) & (F.col("_piece") == F.col("_k"))).drop("_p", "_k")
    alone = cut.where("alone")
    for column, kind in (("piece", "int"), ("before", "string"), ("last", "string"), ("ends", "boolean"), ("more_illegal", "long"), ("again", "long")):
        alone = alone.withColumn(column, F.lit(None).cast(kind))
    made = StructType([rows.schema["conv_id"], *StructType.fromDDL(f"alone boolean, {_DONE}").fields])
    kind = to_arrow_schema(made)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = [Turn(**t) for t in row["turns"]]
                before, ends = row["before"] or "", row["alone"] or row["ends"]
                ways = {w["last"]: (w["cost"], w["audit"]) for w in row["ways"] if w["before"] == before}
                last = ended(ways) if row["alone"] else row["last"]
                cost, audit = ways[last]
                if ends:
                    cost, audit = cost + INSERT * TAIL[last], audit + "I" * TAIL[last]
                done = {c: row[c] for c in ("conv_id", "alone", *COUNTS)} | {"piece": row["piece"] or 0, "ends": ends, "cost": cost, "audit": audit, "repaired": repaired(turns, audit, before)}
                done["illegal"] += row["more_illegal"] or 0
                done["n_turns"] -= row["again"] or 0
                yield done | {"_chars": sum(len(t.text) for t in turns)}

    return written(met.select(*alone.columns).unionByName(alone).mapInArrow(lambda batches: _batches(finish(batches), kind), made), "repaired")


def body(turns: Column) -> Column:
    """``role:text`` of turns, a line each."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def summaries(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation of several pieces is joined by a task that reads them in order and keeps no text but the audit.
    """
    conv = pieces.schema["conv_id"]
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = lambda low, high, n: F.when(low.isNull(), F.lit(0)).otherwise(high - low + 1 - n).cast("long").alias("gaps")
    whole = pieces.where("alone").select("conv_id", gaps(F.col("low"), F.col("high"), F.col("n_turns")), *sums, "audit", F.sha2(body(F.col("repaired")), 256).alias("repaired_sha256"))
    parts = pieces.where("NOT alone").select("conv_id", "piece", "ends", *sums, "low", "high", "n_turns", "audit", body(F.col("repaired")).alias("body"), (F.size("repaired") > 0).alias("any"))
    made = StructType([conv, *StructType.fromDDL("low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    kind = to_arrow_schema(made)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, audits, sha, any_turn = None, [], None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    total, audits, sha, any_turn = {"low": None, "high": None, "n_turns": 0, **dict.fromkeys(sums, 0)}, [], hashlib.sha256(), False
                for c in ("n_turns", *sums):
                    total[c] += row[c]
                if row["low"] is not None:
                    total["low"], total["high"] = row["low"] if total["low"] is None else total["low"], row["high"]
                audits.append(row["audit"])
                if row["any"]:
                    sha.update((b"\n" if any_turn else b"") + row["body"].encode("utf-8", "surrogatepass"))
                    any_turn = True
                if row["ends"]:
                    yield total | {"conv_id": row["conv_id"], "audit": "".join(audits), "repaired_sha256": sha.hexdigest(), "_chars": total["cost"]}

    met = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(lambda batches: _batches(stream(batches), kind), made)
    return whole.unionByName(met.select("conv_id", gaps(F.col("low"), F.col("high"), F.col("n_turns")), *sums, "audit", "repaired_sha256"))
