"""The greedy budget against a plain greedy choice that keeps whole texts, on random rows of several days."""

import random

from pyspark.sql import functions as F

from palimpsest.operators.checkpoint import budgeted

SMALL = {"total": 120, "smart_add": 60, "conversation": 90, "session": 50, "tool": 25}
COLUMNS = "day string, priority int, at bigint, position bigint, part int, kind string, tool boolean, session string, text string"


def greedy(rows, b):
    """day -> place -> what is taken, by the rule: all limits are looked at anew for each entry, over all that is chosen so far."""
    out = {}
    for day in {r[0] for r in rows}:
        chosen = []
        for r in sorted((r for r in rows if r[0] == day), key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3], r[4])):
            _, _, _, position, part, kind, tool, session, text = r
            cost = lambda keep: sum(c for c, x in chosen if keep(x))  # noqa: E731, B023
            rooms = [b["total"] - len("\n---\n".join(x[8].strip() for _, x in chosen)), b[kind] - cost(lambda x, k=kind: x[5] == k)]
            if tool:
                rooms.append(b["tool"] - cost(lambda x: x[6]))
            if session:
                rooms.append(b["session"] - cost(lambda x, s=session: x[7] == s))
            limit = min(rooms) - (5 if chosen else 0)
            text, got = text or "", ""
            if limit > 0:
                got = text if len(text) <= limit else "" if limit <= 1 else text[:limit] if limit <= 3 else text[: limit - 1].rstrip() + "…"
            out[day, position, part] = got
            if got:
                chosen.append((len(got) + (5 if chosen else 0), (*r[:8], got)))
    return out


def rows_of(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 12)))
        tool = rng.random() < 0.3
        rows.append((f"d{rng.randrange(6)}", rng.choice([500, 400, 300, 200, 100]), rng.choice([None, *range(9)]), k, rng.randrange(2), "smart_add" if not tool and rng.random() < 0.4 else "conversation", tool, rng.choice(["s1", "s2", "", None]), text if rng.random() < 0.95 else None))
    return rows


def test_against_a_plain_greedy_choice(spark):
    for seed in range(4):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, COLUMNS).repartition(3)
        got = {(r.day, r.position, r.part): r.taken for r in budgeted(df, SMALL).collect()}
        wanted = greedy(rows, SMALL)
        assert got == wanted
        texts = {(r[0], r[3], r[4]): r[8] or "" for r in rows}
        assert any(0 < len(t) < len(texts[k]) for k, t in wanted.items()) and any(t == "" and texts[k] for k, t in wanted.items())


def test_later_entries_fit_where_an_earlier_one_is_passed_over(spark):
    rows = [("d", 400, 1, 1, 0, "conversation", False, "s1", "a" * 50), ("d", 300, 2, 2, 0, "conversation", False, "s1", "b" * 9), ("d", 200, 3, 3, 0, "conversation", False, "s2", "c" * 20)]
    got = {r.position: r.taken for r in budgeted(spark.createDataFrame(rows, COLUMNS), SMALL).collect()}
    assert got == {1: "a" * 50, 2: "", 3: "c" * 20}


def test_no_rows_other_columns_and_texts_beyond_all_limits(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert budgeted(empty, SMALL).count() == 0
    wide = spark.createDataFrame([("d", 1, 1, 1, 0, "smart_add", False, None, "y" * 100_000)], COLUMNS).withColumn("mine", F.lit(7))
    row = budgeted(wide, SMALL).first()
    assert row.taken == "y" * 59 + "…" and row.mine == 7 and len(row.text) == 121
