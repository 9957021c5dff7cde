import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from textprofile.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile("[^ \t-\r]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        m = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if m == 0:
            continue
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, then least audit, over all edits: Dijkstra over (row, what was
    read), without any of the module's tables."""
    goal = lambda roles: LEGAL.match(roles)
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and goal(roles):
            return cost, audit, kept
        state = (i, roles[-2:] if len(roles) > 1 else roles)
        if state in seen:
            continue
        seen.add(state)
        for role, name in (("u", "user"), ("a", "assistant")):
            if prefix(roles + role):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role, (*kept, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, kept))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role and prefix(roles + role[:1]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[:1], (*kept, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if prefix(roles + r):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + r, (*kept, f"{name}:{text}")))
    raise AssertionError


def prefix(roles):
    return any(LEGAL.match(roles + more) for more in ("", "a", "ua"))


def expected(turns, convs):
    out = {}
    for conv in convs:
        rows = sorted((r for r in turns if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, listed = set(), []
        for _, _, role, text in rows:
            kind = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else \
                "truncated" if WORD.findall(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            listed.append((role, text, kind))
        t = [r[1] for r in rows if r[1] is not None]
        roles = [r[2][:1] for r in rows]
        cost, audit, kept = cheapest(listed)
        kinds = [k for _, _, k in listed]
        out[conv] = (max(t) - min(t) + 1 - len(set(t)) if t else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def check(df, rows, bits=repair.CHUNK_BITS):
    got = {r.conv_id: tuple(r)[1:] for r in repair.damaged_and_repaired(df, chunk_bits=bits).collect()}
    assert got == expected(damaged(rows), {r[0] for r in rows})


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turns(seed, convs, longest):
    r = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(r.randint(1, longest)):
            out.append((conv, turn if r.random() > 0.05 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                        r.choice([f"text {r.randint(0, 9)}.", "no end", " ", "", None, "wow! \n", f"q {r.random()}?"])))
    return out


@pytest.mark.parametrize("bits", [0, 2, 7])
def test_equals_brute_force(spark, bits):
    """Chunks of 1, 4 and 128 rows."""
    rows = turns(bits, 25, 30)
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows, bits)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    check(df, [tuple(r) for r in df.collect()])


def test_chunks_that_never_converge(spark):
    """Only roles that must be changed: the last chunk decides all before it."""
    rows = [(1, i, "tool", f"text {i}.") for i in range(41)] + [(2, i, "tool", f"text {i}.") for i in range(44)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df, rows, 1)


def test_convergence():
    """A chunk that has converged starts alike from every vector; others are found."""
    code = lambda s: "".join(chr(65 + 3 * "uas?".index(c)) for c in s)
    assert repair.converged(repair.matrix(code("uauauaua"))) is not None
    assert repair.converged(repair.matrix(code("?"))) is None
    m = repair.matrix(code("uaus"))
    for end in ((0, 6, 3, 0), (-4, 0, -3, 0), (-1, 2, 1, 0)):
        closed = [min(end[t] + repair._UNITS[t][s] for t in range(4)) for s in range(4)]
        want = np.array(repair.backward(code("uaus"), closed)[0])
        assert (repair.applied(m, end)[0] == want - want[3]).all()


def test_awkward_tables(spark):
    rows = [(None, 0, "user", "a."), (None, 1, None, None), (3, None, None, None), (3, None, "user", "x."), (4, 1, "user", "long " * 20_000 + "."),
            (4, 2, "assistant", "ok."), (4, 2, "assistant", "ok."), (5, 7, "system", "only system.")]
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA + ", conv string, _pid string, audit string, m string")
    check(df, rows)
    assert repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_without_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.damaged_and_repaired(spark.createDataFrame([(dropped, 0, "user", "a.")], SCHEMA)).collect()
    assert [tuple(x) for x in r] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
