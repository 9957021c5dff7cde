"""Repair of conversation structure by a rank-convergence parallel Viterbi.

A conversation's rows get the cheapest edits (keep, change the role, delete,
insert an empty turn) after which its role initials read ``(s?(ua)+)?``.  Four
states say what has been read: nothing, the system turn, a user turn, an
assistant turn.  The Viterbi runs backwards: the cost vector of a place holds
for every state the least cost of all that follows.

A conversation of any length is cut into chunks of at most ``CHUNK`` rows, which
start at once, each from speculative cost vectors at its end.  Cost vectors of
two states differ by a few units at most, so all vectors that may stand there
are known up to a constant; if they lead to start vectors that differ only by
constants, the chunk has converged, whatever follows.  Fix-up passes rerun the
others from what is known of the chunks after them, joining spans that reach
twice as far in every pass, until all have converged or end with the
conversation.  The stitched vectors drive the forward trace: in every chunk, for
every state that may enter it, the letter that is least in ASCII among those
that keep the least cost; the entering states are joined by the same doubling.

Only codes of one character a row take part in this.  Texts are sorted once to
find the order and once to hash the repaired conversations as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import global_position, ranged
from .common import materialize, small_batches

#: Rows of a chunk: 2**CHUNK_BITS.
CHUNK_BITS = 7
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states
FINE, CUT, GONE = range(3)  # codes of faults: nothing, truncated, to be deleted
_FAR = 1 << 30
#: State after a kept row of class user, assistant, system, by state.
_KEPT = ({0: USER, 2: SYSTEM}, {0: USER}, {1: ASSISTANT}, {0: USER})
#: State after an inserted or changed row; its role follows from the state.
_NEXT = (USER, USER, ASSISTANT, USER)
#: Costs at the end of a conversation: what has to be inserted.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Vectors of which every cost vector is a combination: the cost of getting to
#: one state by inserting.
_UNITS = ((0, _FAR, _FAR, _FAR), (_FAR, 0, _FAR, _FAR), (INSERT, INSERT, 0, INSERT), (2 * INSERT, 2 * INSERT, INSERT, 0))
# All vectors that may stand at a chunk's end, less the cost of state assistant:
# a user turn is one insertion away; nothing read is no worse, and better by one
# deleted system turn at most; a lone system turn misses two turns at most.
_POSSIBLE = np.array([(n, s, u, 0) for n, s, u in product(range(-DELETE, 1), range(2 * INSERT + 1), range(-INSERT, INSERT + 1))])
_WHITE = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with seeded faults by crc32("conv:turn") mod 20:
    0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats the
    row, 4 makes it a user turn.  Null ids, roles and texts count as one space."""
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    m = F.crc32(F.concat(one(id_col), F.lit(":"), one(turn_col))) % 20
    d = turns.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), one(role_col).alias("role"),
                     one(text_col).alias("text"), m.alias("m")).filter("m <> 0")
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("m") == 3, 2).otherwise(1))).alias("_")).drop("_")


def backward(codes: str, end: Sequence[int]) -> list[tuple[int, ...]]:
    """The cost vectors before every row, and ``end``."""
    out = [tuple(end)]
    for ch in reversed(codes):
        role, fault = divmod(ord(ch) - 65, 3)
        after = out[-1]
        c = [DELETE + x for x in after]
        if fault != GONE:
            extra = TRUNCATED if fault == CUT else 0
            for s in range(4):
                c[s] = min(c[s], REROLE + extra + after[_NEXT[s]], extra + KEEP + after[_KEPT[s][role]] if role in _KEPT[s] else _FAR)
        c[USER], c[ASSISTANT] = min(c[USER], INSERT + c[ASSISTANT]), min(c[ASSISTANT], INSERT + c[USER])
        out.append((min(c[NONE], INSERT + c[USER]), min(c[SYSTEM], INSERT + c[USER]), c[USER], c[ASSISTANT]))
    return out[::-1]


def matrix(codes: str) -> np.ndarray:
    """Least cost from a state before the rows (line) to one after them (column)."""
    return np.array([backward(codes, u)[0] for u in _UNITS]).T


def applied(m: np.ndarray, end: Sequence[int] | np.ndarray) -> np.ndarray:
    """The start vector(s) for end vector(s), less the cost of state assistant."""
    v = (m[None] + np.atleast_2d(end)[:, None, :]).min(axis=2)
    return v - v[:, -1:]


def converged(m: np.ndarray) -> list[int] | None:
    """The start vector, if it is one up to a constant, whatever stands at the end."""
    v = applied(m, _POSSIBLE)
    return v[0].tolist() if (v == v[0]).all() else None


@lru_cache(100_000)
def trace(codes: str, end: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """(letters of the cheapest edits, least in ASCII; state after them) from a
    state before the rows.  What may be inserted after them is left to the next
    chunk, but not by the ``last`` one."""
    costs, i, out = backward(codes, end), 0, []
    while True:
        least = costs[i][state]
        if i == len(codes):
            if not last or not least:
                return "".join(out), state
            out.append("I")
            state = _NEXT[state]
            continue
        role, fault = divmod(ord(codes[i]) - 65, 3)
        after, extra = costs[i + 1], TRUNCATED if fault == CUT else 0
        if least == DELETE + after[state]:
            out.append("D")
            i += 1
        elif least == INSERT + costs[i][_NEXT[state]]:
            out.append("I")
            state = _NEXT[state]
        elif role in _KEPT[state] and least == KEEP + extra + after[_KEPT[state][role]]:
            out.append("K")
            state, i = _KEPT[state][role], i + 1
        else:
            out.append("R")
            state, i = _NEXT[state], i + 1


def _illegal(codes: str) -> int:
    r = [(ord(c) - 65) // 3 for c in codes]
    return sum((a, b) not in ((2, 0), (0, 1), (1, 0)) for a, b in zip(r, r[1:]))


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows in the order of conversation, turn (nulls first), role and text,
    spread by ranges: ``_pid`` is the range, ``_local`` the place in it."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return ranged(turns.select("conv", "turn", "role", "text"), order).drop("_w")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, _pid, _local, fault, code): of every row its first fault
    (blank, duplicate, truncated or null), and the code of role and fault."""
    place = F.struct("_pid", "_local")
    end = F.rtrim(F.col("text"), F.lit(_WHITE))
    slim = rows.select(
        "conv", "turn", "_pid", "_local", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.position(F.substring("role", 1, 1), F.lit("uas")).alias("role"), (F.col("role") == "").alias("bare"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("k"))
    seen = slim.groupBy(F.col("conv").alias("_conv"), F.col("k").alias("_k")).agg(F.min(place).alias("_first"), F.count("*").alias("n"))
    seen = materialize(seen.filter("n > 1").drop("n"), "seen")
    j = slim.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k")), "left")
    fault = F.when(F.col("blank"), "blank").when(place > F.col("_first"), "duplicate").when(F.col("cut"), "truncated")
    role = F.when(F.col("bare") | (F.col("role") == 0), 3).otherwise(F.col("role") - 1)
    j = j.withColumn("fault", fault).withColumn("role", role)
    code = F.col("role") * 3 + F.when(F.col("fault").isNull(), FINE).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    return j.select("conv", "turn", "_pid", "_local", "fault", F.char(code + 65).alias("code"))


def chunks(rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """(conv, pid, first, codes, at, head, last, following): at most 2**bits
    neighbouring rows of a conversation, numbered in order by ``at``;
    ``following``: the code after the last one."""
    c = rows.groupBy("conv", F.col("_pid").alias("pid"), F.shiftright("_local", bits).alias("grid")).agg(
        F.sort_array(F.collect_list(F.struct("_local", "code"))).alias("r"))
    c = c.select("conv", "pid", F.col("r")[0]["_local"].alias("first"), F.array_join(F.col("r.code"), "").alias("codes"))
    c = global_position(c, ["pid", "first"], "at")
    after = c.select((F.col("at") - 1).alias("_a"), F.col("conv").alias("_conv"), F.substring("codes", 1, 1).alias("_code"))
    before = c.select((F.col("at") + 1).alias("_b"), F.col("conv").alias("_before"))
    c = c.join(after, F.col("at") == F.col("_a"), "left").join(before, F.col("at") == F.col("_b"), "left")
    same = F.col("_a").isNotNull() & F.col("conv").eqNullSafe(F.col("_conv"))
    head = ~(F.col("_b").isNotNull() & F.col("conv").eqNullSafe(F.col("_before")))
    return materialize(c.select("conv", "pid", "first", "codes", "at", head.alias("head"), (~same).alias("last"),
                                F.when(same, F.col("_code")).alias("following")), "chunks")


_SPAN = "at bigint, span bigint, m array<bigint>, v array<bigint>"


def _span(at: int, span: int, m: np.ndarray, v: list[int] | None) -> dict:
    return {"at": at, "span": span, "m": m.reshape(-1).tolist(), "v": v}


def _spans(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("at", pa.int64()), ("span", pa.int64()), ("m", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))]))


def start_vectors(parts: DataFrame) -> DataFrame:
    """(at, v): the cost vector before each chunk of a conversation with
    several, up to a constant."""
    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for r in b.to_pylist():
                m = matrix(r["codes"])
                out.append(_span(r["at"], 1, m, applied(m, FINAL)[0].tolist() if r["last"] else converged(m)))
            yield _spans(out)

    def fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for r in b.to_pylist():
                m = np.array(r["m"]).reshape(4, 4)
                if r["_v"] is not None:
                    out.append(_span(r["at"], r["span"], m, applied(m, r["_v"])[0].tolist()))
                else:
                    m = np.minimum((m[:, :, None] + np.array(r["_m"]).reshape(4, 4)[None]).min(axis=1), _FAR)
                    out.append(_span(r["at"], r["span"] + r["_span"], m, converged(m)))
            yield _spans(out)

    several = parts.filter("not (head and last)").select("at", "last", "codes")
    v = materialize(several.mapInArrow(speculate, _SPAN), "spans")
    while not v.filter("v is null").isEmpty():
        after = v.select(F.col("at").alias("_at"), F.col("span").alias("_span"), F.col("m").alias("_m"), F.col("v").alias("_v"))
        open_ = v.filter("v is null").join(after, F.col("at") + F.col("span") == F.col("_at"))
        v = materialize(v.filter("v is not null").unionByName(open_.mapInArrow(fix_up, _SPAN)), "spans")
    return v.select("at", "v")


def _traced(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``parts`` plus audits and exits (by the state that enters the chunk) and
    illegal, the number of illegal neighbours."""
    ends = vectors.select((F.col("at") - 1).alias("_at"), F.col("v").alias("end"))
    p = parts.join(ends, F.col("at") == F.col("_at"), "left").drop("_at")
    schema = T.StructType([*p.drop("end").schema, T.StructField("audits", T.ArrayType(T.StringType())),
                           T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("illegal", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1024):
            col = dict(zip(b.schema.names, b.columns))
            audits, exits, illegal = [], [], []
            for codes, head, last, following, end in zip(*[col[c].to_pylist() for c in ("codes", "head", "last", "following", "end")]):
                found = [trace(codes, FINAL if last else tuple(end), s, last) for s in range(1 if head else 4)]
                audits.append([a for a, _ in found])
                exits.append([s for _, s in found])
                illegal.append(_illegal(codes + (following or "")))
            yield pa.RecordBatch.from_arrays(
                [*[col[c] for c in schema.names[:-3]], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())),
                 pa.array(illegal, pa.int64())], names=schema.names)

    return materialize(p.mapInArrow(run, schema), "traced")


def _entries(traced: DataFrame) -> DataFrame:
    """(at, state) that enters each chunk but the conversations' first."""
    step = traced.select((F.col("at") + 1).alias("at"), F.col("exits").alias("map"), F.col("head").alias("from_head"), "last")
    e = step.filter("not last").select(
        "at", F.lit(1).cast("bigint").alias("span"), "map",
        F.when(F.col("from_head") | (F.size(F.array_distinct("map")) == 1), F.col("map")[0]).alias("state"))
    e = materialize(e, "entries")
    while not e.filter("state is null").isEmpty():
        before = e.select(F.col("at").alias("_at"), F.col("span").alias("_span"), F.col("map").alias("_map"), F.col("state").alias("_state"))
        j = e.filter("state is null").join(before, F.col("at") - F.col("span") == F.col("_at"))
        both = F.transform("_map", lambda s: F.element_at("map", s + 1))
        j = j.select("at", (F.col("span") + F.col("_span")).alias("span"), both.alias("map"),
                     F.when(F.col("_state").isNotNull(), F.element_at("map", F.col("_state") + 1)).alias("state"))
        j = j.withColumn("state", F.coalesce("state", F.when(F.size(F.array_distinct("map")) == 1, F.col("map")[0])))
        e = materialize(e.filter("state is not null").unionByName(j), "entries")
    return e.select(F.col("at").alias("_at"), "state")


def _steps(chosen: DataFrame) -> DataFrame:
    """One row for each row of the chunks: conv, _pid, _local, kind 0, the
    edit as role and text: what is inserted before, the edit itself with the
    changed role's initial, and what is inserted after."""
    conv = chosen.schema["conv"]
    names = ["conv", "_pid", "_local", "kind", "role", "text", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            at, pid, local, edit, cost = [], [], [], [], []
            for i, r in enumerate(b.select(["pid", "first", "codes", "audit", "state"]).to_pylist()):
                s, j, before, price = r["state"], 0, "", 0
                for ch in r["audit"]:
                    role, fault = divmod(ord(r["codes"][j]) - 65, 3) if j < len(r["codes"]) else (0, 0)
                    if ch == "I":
                        s = _NEXT[s]
                        if j == len(r["codes"]):
                            edit[-1] += "u" if s == USER else "a"
                            cost[-1] += INSERT
                            continue
                        before, price = before + ("u" if s == USER else "a"), price + INSERT
                        continue
                    if ch != "D":
                        s = _KEPT[s][role] if ch == "K" else _NEXT[s]
                        price += (TRUNCATED if fault == CUT else 0) + (REROLE if ch == "R" else 0)
                    else:
                        price += DELETE
                    at.append(i)
                    pid.append(r["pid"])
                    local.append(r["first"] + j)
                    edit.append(f"{before}{ch}{('u' if s == USER else 'a') if ch == 'R' else ''}|")
                    cost.append(price)
                    j, before, price = j + 1, "", 0
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("conv")).take(pa.array(at, pa.int64())), pa.array(pid, pa.int32()),
                 pa.array(local, pa.int64()), pa.array([0] * len(at), pa.int32()), pa.array(edit, pa.string()),
                 pa.nulls(len(at), pa.string()), pa.array(cost, pa.int64())], names=names)

    return chosen.mapInArrow(run, f"conv {conv.dataType.simpleString()}, _pid int, _local bigint, kind int, role string, "
                                  "text string, cost bigint")


_ROLES = {"u": "user", "a": "assistant"}


def _hashed(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv, audit, cost, repaired_sha256): every conversation's edits and texts
    pass a running hash in order; none is held as a whole."""
    conv = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "audit", "cost", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, cost, sha, lines, edit = None, [], 0, None, 0, ""

        def line(role: str, text: str) -> None:
            nonlocal lines
            sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key[1], pa.array(["".join(audit)]), pa.array([cost], pa.int64()),
                                               pa.array([sha.hexdigest()])], names=names)

        for b in small_batches(batches):
            for i, r in enumerate(b.to_pylist()):
                if key is None or key[0] != r["conv"]:
                    if key is not None:
                        yield done()
                    key, audit, cost, sha, lines = (r["conv"], b.column(0).slice(i, 1)), [], 0, hashlib.sha256(), 0
                if not r["kind"]:
                    edit, cost = r["role"], cost + r["cost"]
                    continue
                pre, post = edit.split("|")
                own = next(k for k, ch in enumerate(pre) if ch in "KRD")
                for ch in pre[:own]:
                    line(_ROLES[ch], "")
                if pre[own] != "D":
                    line(_ROLES[pre[own + 1]] if pre[own] == "R" else r["role"], r["text"])
                for ch in post:
                    line(_ROLES[ch], "")
                audit.append("I" * own + pre[own] + "I" * len(post))
        if key is not None:
            yield done()

    both = rows.select("conv", "_pid", "_local", F.lit(1).alias("kind"), "role", "text", F.lit(0).cast("bigint").alias("cost")).unionByName(steps)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, "conv").sortWithinPartitions("conv", "_pid", "_local", "kind")
    return both.mapInArrow(run, f"conv {conv}, audit string, cost bigint, repaired_sha256 string")


def repair(turns: DataFrame, originals: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row for every id in ``originals`` (column conv): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256, for rows
    ``turns`` (conv, turn, role, text).

    Rows stand in the order of turn (nulls first); of equal turns by role, then
    text, so that repeated rows are neighbours.  Null roles and texts count as
    one space; a role whose first letter is not u, a or s (an empty one too) is
    never kept.  Whole texts are read.  Rows with a null id are one conversation.
    Ids without rows: zeros, an empty audit and the hash of nothing; an empty
    table of ids gives an empty result."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = _ordered(turns.select("conv", "turn", one("role"), one("text")))
    marked = materialize(faults(rows), "faults")
    parts = chunks(marked, chunk_bits)
    traced = _traced(parts, start_vectors(parts))
    chosen = traced.join(_entries(traced), F.col("at") == F.col("_at"), "left").withColumn("state", F.coalesce("state", F.lit(NONE)))
    chosen = chosen.withColumn("audit", F.element_at("audits", F.col("state") + 1))
    edits = _hashed(rows, _steps(chosen.select("conv", "pid", "first", "codes", "audit", "state")))
    kinds = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    counts = marked.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), *kinds)
    illegal = traced.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    out = originals.select(F.col("conv").alias("conv_id")).distinct()
    for part, name in ((counts, "_c"), (illegal, "_i"), (edits, "_e")):
        part = part.withColumnRenamed("conv", name)
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged_and_repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``repair`` of the rows that ``damage`` leaves, for every original id."""
    ids: Column = F.col(f"`{id_col}`").alias("conv")
    return repair(damage(turns, id_col, turn_col, role_col, text_col), turns.select(ids), chunk_bits)
