"""Conversation repair against a plain search over whole edit scripts."""

import hashlib
import random
import re
import zlib

import pytest

from lectern.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """Of each conversation, by the cheapest and ASCII-least edits from every row and every text of initials so far."""
    left = damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in left if r[0] == conv]
        key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
        mine.sort(key=key)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in mine:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        # states by the initials that the grammar sees: nothing, s, ...u, ...ua
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        best = {"": (0, "", ())}  # before a row: state -> cost, audit, rows left

        def closed(best):
            for _ in range(3):
                for q, (cost, audit, kept) in [*best.items()]:
                    for role in ("user", "assistant"):
                        if (p := step[q].get(role[0])) is not None:
                            best[p] = min(best.get(p, (10**9, "", ())), (cost + 3, audit + "I", (*kept, (role, ""))))
            return best

        for (_, _, role, text), fault in zip(mine, faults):
            after = {}

            def offer(q, *new):
                after[q] = min(after.get(q, (10**9, "", ())), new)

            for q, (cost, audit, kept) in closed(best).items():
                offer(q, cost + 4, audit + "D", kept)
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if role[:1] in step[q]:
                        offer(step[q][role[:1]], cost + more, audit + "K", (*kept, (role, text)))
                    for new in ("user", "assistant"):
                        if new[0] in step[q]:
                            offer(step[q][new[0]], cost + more + 3, audit + "R", (*kept, (new, text)))
            best = after
        cost, audit, kept = min(closed(best)[q] for q in ("", "a") if q in closed(best))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def made(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sys", "umpire"]
    texts = ["Yes.", "no", "What? ", "So be it!\n", "", " \t", None, "cut off", "Größe.", "。"]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 1, 2, 4, 8, 30])):
            rows.append((conv, rng.choice([turn] * 6 + [turn + 3, None, 0]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."))
    rows += [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ha."), (7, 1, "user", "x" * 30_000 + "?"), *[(n + 1, 0, "user", "same.")] * 4]
    return rows


@pytest.mark.parametrize("most", [3, conversations.PIECE])
def test_cheapest_edits(spark, most):
    """With pieces of three rows too, so that pieces meet in all states."""
    rows = made(1, 300)
    data = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA + ", conv string, cost int, piece string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(data, most).collect()}
    want = plain(rows)
    assert len(got) == len(want)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, list(wrong.items())[:2]


def test_sql_says_the_same():
    """The query's SQL against the plain search, on odd rows."""
    import duckdb
    import pyarrow as pa

    from lectern.llm import queries

    rows = made(2, 150)
    con = duckdb.connect()
    con.register("conversations", pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))))
    got = {r[0]: r[1:] for r in con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.OP11_SQL})").fetchall()}
    want = plain(rows)
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert len(got) == len(want) and not wrong, list(wrong.items())[:2]


def test_ties_and_inserts():
    """Inserting both of a pair before a lone assistant row costs as much as other ways; the least initials win."""
    rows = [(1, t, r, "A.") for t, r in enumerate(["assistant", "assistant"])]
    automaton = conversations.Automaton()
    automaton.turn_to(conversations.FINAL, "aa")
    assert automaton.audit(conversations.START, True)[:2] == ("RK", 3) and plain(rows)
    automaton.turn_to(conversations.FINAL, "xaa")
    assert automaton.made == 3  # the suffix is there already


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = conversations.repair(spark.createDataFrame([(5, dropped, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_given_table(spark, small):
    data = spark.read.parquet(f"{small}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(data).collect()}
    assert got == plain([tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()])
