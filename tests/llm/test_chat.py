import hashlib
import re

from pyspark.sql import functions as F

from textprofile.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, seq string, tokens string, win string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


NASTY = ["\\### Assistant: </turn> ok", "<turn>user\nx</turn>\n", "\\b\\l\\n", "\\", "<", "", None, "a\\nb\n\nc", "\x02é\U0001f600"]


def digest(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), hashlib.md5((r[3] or "").encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY * 2)]
    rows += [(2, 0, "system", "be short"), *[(2, i, ("assistant", "user")[i % 2], "word " * (30 + 17 * (i % 9))) for i in range(1, 80)]]
    rows += [(3, 0, None, "x"), (3, 0, "ro<le\n\\n", "y"), (3, None, "assistant", "z"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    rows += [(None, 1, "assistant", "lost"), (None, 0, "user", "and found"), (4, 0, "assistant", "huge " * 3000), (4, 1, "user", "hm")]
    rows += [(5, 0, "user", "before"), (5, 1, "system", "late"), (5, 2, "system", "second"), (5, 3, "assistant", "w " * 900), (5, 4, "assistant", "e")]
    out = C.digest(C.format_windows(frame(spark, rows), budget=200, history=60)).collect()
    assert {r["conv_id"]: tuple(r[1:5]) for r in out} == digest(rows)
    assert C.format_windows(frame(spark, []).limit(0)).count() == 0


def test_windows(spark):
    rows = [(1, 0, "system", "sys " * 8), *[(1, i, ("assistant", "user")[i % 2], f"t{i} " * (5 + i * 7 % 31)) for i in range(1, 60)],
            (1, 60, "assistant", "long " * 400)]
    wins = C.format_windows(frame(spark, rows), budget=120, history=40, max_history_turns=2).orderBy("window").collect()
    assert len(wins) > 5
    said = [re.findall(r"<turn>(.*?)\n(.*?)</turn>\n", w["formatted"], re.S) for w in wins]
    n = 0
    for w, turns in zip(wins, said):
        assert w["over_budget"] == (w["tokens"] > 120)
        new = turns[w["n_context"]:]
        assert w["tokens"] <= 120 or len(new) == 1  # only a single turn may exceed it
        if n:
            assert turns[0][0] == "system" and w["n_context"] >= 1
            context = turns[1:w["n_context"]]
            assert len(context) <= 2 and context == [(r, t) for _, _, r, t in rows[n - len(context):n]]
            assert sum(len(t.split()) + C.OVERHEAD for _, t in context) <= 40
        assert new == [(r, t) for _, _, r, t in rows[n:n + len(new)]]
        n += len(new)
        spans = [w["formatted"][s["start"]:s["end"]] for s in w["loss"]]
        assert spans == [t for r, t in new if r == "assistant"]
    assert n == len(rows)


def test_one_long_conversation_is_dealt_out(spark):
    df = spark.range(4000).selectExpr("cast(9 as bigint) conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') role",
                                      "concat('t', id) as text")
    t = C.numbered(df, "conv_id", "turn", "role", "text")
    got = t.agg(F.count("*"), F.max("seq"), F.countDistinct("seq"), F.max("start")).first()
    assert tuple(got) == (4000, 3999, 4000, 3 * 3999)
    assert t.filter(F.col("text") != F.concat(F.lit("t"), F.col("seq"))).count() == 0
