import datetime as dt
import random

from caselens.llm.conversations import calibrated_gap, clean_messages, conversations, ordered, session_faults

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "message_id string, session_id string, role string, content string, created_at timestamp_ntz, loaded_at timestamp_ntz, block string, pos int, gap_s double"
U = "aaaaaaaa-0000-0000-0000-00000000000{}"


def frame(spark, rows):
    return spark.createDataFrame([(m, s, r, c, None if t is None else T0 + dt.timedelta(seconds=t), T0, "b", 1, 2.0) for m, s, r, c, t in rows], SCHEMA)


def faults(spark, rows, sessions=()):
    s = spark.createDataFrame([(x,) for x in sessions], "session_id string")
    return {r.session_id: r.fault for r in session_faults(frame(spark, rows), s).collect()}


def test_faults_and_dirty_keys(spark):
    rows = [
        ("1", U.format(1), "user", "q", 0), ("2", U.format(1).upper(), " AI ", "a", 5), ("2", U.format(1).upper(), " AI ", "a", 5), ("3", "{" + U.format(1) + "}", "bot", "b", 5),
        ("4", U.format(2), "assistant", "a", 0), ("5", U.format(3), "user", "q", 0), ("6", U.format(3), "?", "x", 1), ("7", U.format(4), "user", "q", 0),
        ("8", U.format(5), "user", "q", 0), ("9", U.format(5), "human", "q", 1), ("10", U.format(5), "bot", "a", 2), ("11", U.format(6), "user", " ​﻿", 0), ("12", U.format(6), None, None, 0),
        ("13", U.format(7), "user", "-", 0), ("14", U.format(7), "model", "...", 3), ("15", None, "user", "q", 0), ("16", U.format(9), None, "x", 0),
    ]
    assert faults(spark, rows, [U.format(8), U.format(1), None]) == {
        U.format(2): "broken", U.format(3): "broken", U.format(4): "missing_reply", U.format(5): "missing_reply", U.format(6): "empty", U.format(8): "empty", U.format(9): "broken",
    }
    assert faults(spark, []) == {}


def test_against_brute_force_over_block_borders(spark):
    r = random.Random(4)
    rows = []
    for s in range(8):
        t = 0
        for k in range(r.randint(0, 40)):
            t += r.choice([0, 20, 1800, 3600, 90_000])
            rows.append((f"{s}-{k:03}", U.format(s), r.choice(["user", "assistant", "assistant", "user", "ai"]), "x", t))
    want = {}
    for s in range(8):
        m = sorted((t, i, "assistant" if role in ("ai", "assistant") else "user") for i, x, role, _, t in rows if x == U.format(s))
        roles = [x[2] for x in m]
        if not roles:
            continue
        if roles[0] == "assistant":
            want[U.format(s)] = "broken"
        elif any(a == "user" and b != "assistant" for a, b in zip(roles, [*roles[1:], None])):
            want[U.format(s)] = "missing_reply"
    assert faults(spark, rows) == want
    o = ordered(clean_messages(frame(spark, rows))).collect()
    for s in range(8):
        mine = sorted((x for x in o if x.session_id == U.format(s)), key=lambda x: x.pos)
        assert [x.pos for x in mine] == list(range(1, len(mine) + 1))
        assert [x.message_id for x in mine] == [i for _, i in sorted((t, i) for i, x, _, _, t in rows if x == U.format(s))]


def test_split_at_gaps_only_between_exchanges(spark):
    day = 86_400
    rows = [("1", U.format(1), "user", "q", 0), ("2", U.format(1), "ai", "a", 10), ("3", U.format(1), "user", "q", 10 + day), ("4", U.format(1), "ai", "late", 10 + 3 * day), ("5", U.format(1), "ai", "more", 20 + 3 * day), ("6", U.format(1), "user", "q", 30 + 3 * day), ("7", U.format(1), "ai", "a", 31 + 3 * day)]
    got = sorted((r.conversation_no, r.turn_no, r.message_id) for r in conversations(frame(spark, rows), gap_s=3600).collect())
    assert got == [(1, 1, "1"), (1, 2, "2"), (2, 1, "3"), (2, 2, "4"), (2, 3, "5"), (2, 4, "6"), (2, 5, "7")]


def test_calibrated_gap_parts_short_from_long(spark):
    rows, t = [], 0
    for k in range(200):
        t += 30 if k % 4 else 50_000
        rows.append((f"{k:03}", U.format(1), "user" if k % 2 == 0 else "ai", "x", t))
    gap = calibrated_gap(ordered(clean_messages(frame(spark, rows)))).first()[0]
    assert 30 < gap <= 50_000
    assert calibrated_gap(ordered(clean_messages(frame(spark, [])))).first()[0] is None
    assert conversations(frame(spark, [])).count() == 0
