import hashlib

from pyspark.sql import functions as F

from hearsay.llm import chat
from hearsay.llm.queries import TRAP, op13_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, pieces string, turns string, _key long"
HOSTILE = ["", None, "\\", "\\\\s", "###", "####### x", "</turn>", "</turn>\n### user:\n", "a\\t\\h\\s\\c", "line\n", "\n### ", TRAP,
           "</tu###rn>", "##</turn>#", ":\n", "ñ🙂\u0000x", "y" * 30000]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def expected(rows):
    """Plain version: turns in order, merged blocks, the text under the loss."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = [(role, text) for _, _, role, text in turns]
        whole, last = "", None
        for role, text in said:
            if role != last:
                whole += "### " + chat_escape(role).replace(":", "\\c") + ":\n"
                last = role
            whole += chat_escape(text) + "</turn>\n"
        out[conv] = (len(said), said, whole, "".join(t for r, t in said if r == "assistant"))
    return out


def chat_escape(text):
    return text.replace("\\", "\\s").replace("###", "\\h").replace("</turn>", "\\t")


def test_every_text_and_role_comes_back(spark):
    rows = [(1, i, ("user", "assistant", "system: x\n", None)[i % 4], t) for i, t in enumerate(HOSTILE)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(HOSTILE)]                     # one merged block
    rows += [(3, 5, t, "role") for t in HOSTILE if t and len(t) < 100]                  # ties in turn, hostile roles
    rows += [(None, None, "user", "a"), (None, 1, "assistant", "b"), (4, None, "assistant", None), (4, 0, "user", "u"), (4, 0, "user", "u")]
    done = chat.format_conversations(rows_of(spark, rows))
    got = done.select("conv_id", "n_turns", "formatted", chat.read_turns("formatted").alias("turns"),
                      chat.loss_text("pieces").alias("loss"), chat.joined(F.transform("pieces", lambda p: p["text"])).alias("whole")).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        n, said, whole, loss = want[r["conv_id"]]
        assert (r["n_turns"], r["formatted"], r["whole"], r["loss"]) == (n, whole, whole, loss)
        assert [(t["role"], t["text"]) for t in r["turns"]] == said


def test_adjacent_turns_of_one_role_share_a_header(spark):
    done = chat.format_conversations(rows_of(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")])).first()
    assert done["formatted"] == "### user:\na</turn>\nb</turn>\n### assistant:\nc</turn>\n"
    assert [(p["text"], p["loss"]) for p in done["pieces"]][-2:] == [("c", True), ("</turn>\n", False)]


def test_empty_table(spark):
    assert chat.format_conversations(rows_of(spark, [])).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"t{i}") for i in range(20000)]
    r = chat.format_conversations(rows_of(spark, rows)).select(chat.read_turns("formatted").alias("t"), chat.loss_text("pieces").alias("l")).first()
    assert [x["text"] for x in r["t"]] == [f"t{i}" for i in range(20000)]
    assert r["l"] == "".join(t for _, _, role, t in rows if role == "assistant")


def test_no_python_in_the_plan(spark):
    plan = op13_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (n, sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(whole)) for c, (n, said, whole, loss) in expected(rows).items()}
    got = {r[0]: tuple(r)[1:] for r in op13_chat_formatting(spark, sf).collect()}
    assert got == want
