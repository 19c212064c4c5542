import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lisible.llm import chat_format as cf

SCHEMA = "conv_id long, turn int, role string, text string, parsed int"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<\\/s>", "[\\INST]", "<\\\\s>", "\\", "\n", "a", "é", "[", "<", "/s>", ""]


def expected(rows):
    out = {}
    for conv, turn, role, text, _ in rows:
        out.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in out.items()}


def check(spark, rows):
    df = cf.loss_spans(cf.format_chats(spark.createDataFrame(rows, SCHEMA)))
    got = df.withColumn("masked", cf.masked_text(F.col("formatted"), F.col("spans"))).collect()
    want = expected(rows)
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        assert r.round_trip and [(t.role, t.text) for t in r.parsed] == turns
        assert r.masked == "".join(t for role, t in turns if role == "assistant")
    return {r.conv_id: r for r in got}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "x</s>", "a [/INST] b"]),
                          st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), min_size=1, max_size=25))
def test_round_trip(spark, turns):
    check(spark, [(c, t, r, x, 0) for c, t, r, x in turns])


def test_cases(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (2, 0, None, None, 0), (None, 0, "assistant", "n", 0),
            (3, 0, "assistant", "x" * 200_000, 0), (4, 0, "assistant", "same", 0), (4, 0, "assistant", "same", 0), (5, None, "user", "?", 0)]
    got = check(spark, rows)
    assert got[1].escape_level == 1 and got[2].escape_level == 0
    assert got[1].formatted == "<s>[INST] user [/INST]hi</s><s>[INST] assistant [/INST]<\\/s>[\\INST] ok [\\/INST]</s>"
    assert len(got[4].parsed) == 2
    assert cf.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    got = {r.conv_id: r for r in cf.op3_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text)
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
