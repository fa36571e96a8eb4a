import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quern.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def by_force(rows):
    """Every edit script of small rows, with at most one insert before each row and two at the end."""
    best = None

    def go(k, cost, audit, made):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            for tail in ("", "I", "II"):
                for filled in ([[]] if not tail else [["assistant"]] if tail == "I" else [["user", "assistant"]]):
                    done = made + [(r, "") for r in filled]
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in done)) and all(r for r, _ in done):
                        found = (cost + 2 * len(filled), audit + tail, done)
                        best = min(best, found) if best else found
            return
        role, text, must, extra = rows[k]
        go(k + 1, cost + 3, audit + "D", made)
        for inserted in ([], ["user"], ["assistant"]):
            before = made + [(r, "") for r in inserted]
            start = (cost + 2 * len(inserted), audit + "I" * len(inserted))
            if not must:
                go(k + 1, start[0] + extra, start[1] + "K", before + [(role, text)])
                for r in ("user", "assistant"):
                    go(k + 1, start[0] + 2 + extra, start[1] + "R", before + [(r, text)])
            elif inserted:
                go(k + 1, start[0] + 3, start[1] + "D", before)

    go(0, 0, "", [])
    return best


def expected(rows):
    """What the contract asks for of (conv_id, turn, role, text) rows, by plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        spaced = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, counts, edited = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in kept:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            edited.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for t, _, _ in kept if t is not None}
        roles = [r[:1] for _, r, _ in kept]
        cost, audit, made = by_force(edited)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


def got(spark, rows, partitions=3, piece_rows=512):
    turns = spark.createDataFrame([(*r, 0, "", 1) for r in rows], "conv_id long, turn long, role string, text string, n int, _part string, kind int").repartition(partitions)
    found = repair.summaries(repair.repaired_pieces(repair.damaged(turns), piece_rows)).collect()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r[c] for c in columns) for r in found}


def planted(seed, convs=60):
    pick = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for t in range(pick.randint(1, 6)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "üser"])
            rows.append((c, pick.choice([t, t, t, 2 * t, None]), role, pick.choice(["yes.", "no", "why?", "", " \t", None, "é!", "x" * 9])))
    return rows


@pytest.mark.parametrize("rows_in_piece", [1, 2, 512])
def test_brute_force_of_small_conversations(spark, rows_in_piece):
    rows = planted(rows_in_piece)
    assert got(spark, rows, piece_rows=rows_in_piece) == expected(rows)


@pytest.mark.parametrize("before", ["", "s", "u", "a"])
def test_prices_join_over_any_cut(before):
    pick = random.Random(before)
    for _ in range(300):
        turns = [repair.Turn(pick.choice(["user", "assistant", "system", "x"]), "t", pick.choice([1, 1, 3]), pick.choice(["", "", "blank", "truncated"])) for _ in range(6)]
        whole = repair.moves(turns, before)
        cut = pick.randint(0, 6)
        left = repair.moves(turns[:cut], before)
        joined = {}
        for middle, (cost, audit) in left.items():
            for last, (more, rest) in repair.moves(turns[cut:], middle).items():
                joined[last] = min(joined.get(last, (cost + more, audit + rest)), (cost + more, audit + rest))
        assert joined == whole


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BROADCAST_PIECES", 0)
    pick = random.Random(5)
    rows = [(7, t, pick.choice(["user", "assistant", "system"]), pick.choice(["ok.", "same", f"text {t}.", f"text {t}"])) for t in range(400)]
    rows += [(7, 5, "user", "again.")] * 300 + [(c, t, r, "Hi.") for c in range(8, 28) for t, r in ((0, "user"), (1, "assistant"))]
    mine = got(spark, rows, 9, 4)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert mine == sql_rows(con)
    assert len(mine) == 21 and len(mine[7][6]) >= 600


def sql_rows(con):
    result = con.execute(queries.ORACLE_SQL["op12_structure_repair"])
    assert [c[0] for c in result.description] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: r[1:] for r in result.fetchall()}


def test_sql_agrees_with_brute_force_and_the_query_with_sql(spark):
    rows = planted(9)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sql_rows(con) == expected(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    query = queries.QUERIES["op12_structure_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r[1:]) for r in query} == sql_rows(con)


def test_long_texts_dropped_conversations_and_empty_tables(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (2000, 0, "user", "é" * 2_000_000 + "."), (2000, 1, "assistant", "b" * 2_000_000 + ".")]
    found = got(spark, rows)
    assert found == expected(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.summaries(repair.repaired_pieces(repair.damaged(empty))).collect() == []


def test_repaired_turns_are_returned(spark):
    turns = spark.createDataFrame([("c", 0, "user", "Hi.", 1), ("c", 1, "user", "Well?", 1), ("c", 2, "tool", "x.", 1)], "conv_id string, turn long, role string, text string, n long")
    [piece] = repair.repaired_pieces(turns.coalesce(1)).collect()
    assert (piece.conv_id, piece.cost, piece.audit) == ("c", 4, "KIKR")
    assert [tuple(t) for t in piece.repaired] == [("user", "Hi."), ("assistant", ""), ("user", "Well?"), ("assistant", "x.")]
