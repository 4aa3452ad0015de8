import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from pactlake.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain(rows):
    """Each conversation's result, by a table of least (cost, edits) of all suffixes."""
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if k == 4:
            role = "user"
        own += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    return {conv: one(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, own in held.items()}


def one(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "ok" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]

    best = {}
    for i in range(len(rows), -1, -1):
        row = {}
        for state in range(4):
            ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
            if i < len(rows):
                at = best[i + 1]
                ways.append((3 + at[state][0], "D" + at[state][1]))
                if faults[i] in ("ok", "truncated"):
                    more, to = int(faults[i] == "truncated"), ASKED[state][1]
                    ways.append((2 + more + at[to][0], "R" + at[to][1]))
                    kept = NEXT.get((state, rows[i][1][:1]))
                    if kept is not None:
                        ways.append((more + at[kept][0], "K" + at[kept][1]))
            row[state] = min(ways, default=(10**9, ""))
        for _ in range(4):  # inserts, until nothing changes
            for state in range(4):
                cost, edits = row[ASKED[state][1]]
                row[state] = min(row[state], (cost + 2, "I" + edits))
        best[i] = row
    cost, audit = best[0][0]
    state, i, said = 0, 0, []
    for e in audit:
        role, to = ASKED[state]
        if e == "I":
            said.append(f"{role}:")
            state = to
            continue
        if e == "R":
            said.append(f"{role}:{rows[i][2]}")
            state = to
        elif e == "K":
            said.append(f"{rows[i][1]}:{rows[i][2]}")
            state = NEXT[state, rows[i][1][:1]]
        i += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def result(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"])
            text = rng.choice(["Yes.", "No!", "Well", "", " \n", None, "é?  ", f"Turn {t}.", f"Turn {t}"])
            rows.append((c, rng.choice([t, t, t, t + rng.randrange(3), None]), role, text))
    rng.shuffle(rows)
    return rows


def test_given_table(spark, tiny):
    table = spark.read.parquet(f"{tiny}/conversations.parquet")
    assert result(dialogue.structure(table)) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("piece", [2048, 3])
def test_against_plain_table(spark, monkeypatch, piece):
    """With nulls, ties, repeats and roles of any name; also with conversations cut into very small pieces on several levels."""
    monkeypatch.setattr(dialogue, "FAN", 2 if piece == 3 else 256)
    rows = made(piece, 150, 9) + [(c, t, r, x) for c in (997, None) for _, t, r, x in made(5, 9, 9)] + [(996, 1, "user", "Same."), (996, 1, "user", "Same.")]
    got = result(dialogue.structure(spark.createDataFrame(rows, SCHEMA), most=piece))
    want = plain(rows)
    assert got == want and any("I" in w[6] and "R" in w[6] for w in want.values())


def test_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Ok.", "Fine", f"Turn {t}.", "x" * 3000 + "."])) for t in range(1500)]
    assert result(dialogue.structure(spark.createDataFrame(rows, SCHEMA), most=64)) == plain(rows)


def test_crossings_need_no_whole_table():
    """Steps of a run compose to the same least cost and edits as the plain table gives."""
    rng = random.Random(1)
    for _ in range(300):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice([".", "a", f"{t}.", f"{t}"])) for t in range(rng.randrange(12))]
        p = dialogue.Piece(*map(list, zip(*rows, strict=True))) if rows else dialogue.Piece([], [], [])
        got = dialogue.whole(p)
        assert tuple(got[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == one(rows)


def test_empty_and_clashing_names(spark):
    assert dialogue.structure(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for k in range(40) for t in range(4)]
    df = spark.createDataFrame([(*r, 1, "x", [1]) for r in rows], SCHEMA + ", task int, col string, step array<int>")
    assert result(dialogue.structure(df)) == plain(rows)


@lru_cache
def _dropped():
    return next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)


def test_no_rows_after_damage(spark):
    got = result(dialogue.structure(spark.createDataFrame([(_dropped(), 0, "user", "Hello.")], SCHEMA)))
    assert got == {_dropped(): (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
