"""Chat layout, preference-pair formatting and token sequences."""
import pytest
from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.chat import render_chat, render_prompt
from chatsieve.operators import preference as P
from chatsieve.operators import tokens as TK

MSG_T = "array<struct<role:string,content:string>>"


def py_render(messages, gen=False, thinking=True):
    """Independent statement of the chat layout (system/user/assistant/tool)."""
    def is_query(m):
        c = m["content"] or ""
        return m["role"] == "user" and not (c.startswith("<tool_response>") and c.endswith("</tool_response>"))

    queries = [i for i, m in enumerate(messages) if is_query(m)]
    last_query = queries[-1] if queries else len(messages) - 1
    parts = []
    for i, m in enumerate(messages):
        role, c = m["role"], m["content"] or ""
        prev_tool = i > 0 and messages[i - 1]["role"] == "tool"
        next_tool = i + 1 < len(messages) and messages[i + 1]["role"] == "tool"
        if role in ("user", "system"):
            parts.append("<|im_start|>" + role + "\n" + c + "<|im_end|>\n")
        elif role == "assistant":
            thought = ""
            if "</think>" in c:
                before_first_close = c.partition("</think>")[0]
                thought = before_first_close.rstrip("\n").rpartition("<think>")[2].lstrip("\n")
                c = c.rpartition("</think>")[2].lstrip("\n")
            think = i > last_query and (i == len(messages) - 1 or thought != "")
            body = ("<think>\n" + thought.strip("\n") + "\n</think>\n\n" + c.lstrip("\n")) if think else c
            parts.append("<|im_start|>assistant\n" + body + "<|im_end|>\n")
        elif role == "tool":
            parts.append(("" if prev_tool else "<|im_start|>user") + "\n<tool_response>\n" + c
                         + "\n</tool_response>" + ("" if next_tool else "<|im_end|>\n"))
    if gen:
        parts.append("<|im_start|>assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n"))
    return "".join(parts)


def M(role, content):
    return {"role": role, "content": content}


CASES = [
    [M("system", "sys"), M("user", "q"), M("assistant", "a")],
    [M("system", "sys"), M("user", "q"), M("assistant", "a"), M("user", "q2")],
    [M("user", "q"), M("assistant", "\n\na"), M("assistant", "b")],
    [M("user", "q"), M("assistant", "<think>\nplan\n</think>\n\nanswer")],
    [M("user", "q"), M("assistant", "x"), M("tool", "r1"), M("tool", "r2"), M("assistant", "y")],
    [M("assistant", "only")],
    [M("user", "q"), M("system", "late system"), M("assistant", None)],
    [M("user", "<tool_response>t</tool_response>"), M("assistant", "z")],
]


@pytest.mark.parametrize("gen,thinking", [(False, True), (True, False), (True, True)])
def test_render_chat_matches_python(spark, gen, thinking):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], f"i int, m {MSG_T}")
    got = df.select("i", render_chat(F.col("m"), gen, thinking).alias("t")).orderBy("i").collect()
    for r, c in zip(got, CASES):
        assert r.t == py_render(c, gen, thinking), c


def test_render_prompt_equals_two_message_render(spark):
    df = spark.createDataFrame([("问题",)], "q string")
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit(D.SYSTEM_PROMPT).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("q").alias("content")))
    r = df.select(render_prompt(F.col("q")).alias("a"), render_chat(m, True, False).alias("b")).collect()[0]
    assert r.a == r.b


def test_chat_fragments_concatenate_to_render(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
             (1, 4, "assistant", "a2"), (2, 0, "user", "x"), (2, 1, "tool", "t"), (2, 2, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    frags = TK.chat_fragments(df, with_tools=True).collect()
    by_conv = {}
    for f in sorted(frags, key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(f.conv_id, []).append(f.fragment)
    for cid in (1, 2):
        msgs = [M(r, t) for c, _, r, t in turns if c == cid]
        assert "".join(by_conv[cid]) == py_render(msgs)


# ---------------------------------------------------------------- preference pairs
def test_resolve_prompt_truthiness(spark):
    rows = [("", "  ", "q1", "c", "r"),          # empty prompt falls through; whitespace user_prompt is truthy
            (None, None, "q2", "c", "r"),
            ("<|im_start|>raw ", None, None, "c", "r"),
            ("用户问题：已带标签", None, None, "c", "r"),
            (None, None, None, "c", "r"),
            ("p", None, None, " ", "r"),
            ("p", None, None, "c", None)]
    df = spark.createDataFrame(rows, "prompt string, user_prompt string, question string, chosen string, rejected string")
    valid, quarantine = P.format_pairs(df, categories=["甲", "乙"])
    v = valid.collect()
    pre = D.CHOOSE_CATEGORY_PREAMBLE + "甲、乙\n" + D.USER_QUESTION_LABEL
    prompts = sorted(r.prompt for r in v)
    expected = sorted([render_expected(pre + ""), render_expected(pre + "q2"), "<|im_start|>raw",
                       render_expected("用户问题：已带标签")])
    assert prompts == expected
    probs = sorted(r.problem for r in quarantine.collect())
    assert probs == ["blank_prompt", "empty_chosen", "empty_rejected", "no_prompt"]
    with pytest.raises(Exception):
        P.format_pairs(df, categories=["甲"], strict=True)[0].collect()


def render_expected(user):
    return (f"<|im_start|>system\n{D.SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n"
            f"<|im_start|>assistant\n<think>\n\n</think>\n\n")


def test_check_pairs_and_stats(spark):
    rows = [("p", "场景分类：a 客服回复：b 理解", "r", "c1", "infer", "high"),
            ("p", "场景分类：a 客服回复：b 理解", "r", "c1", "infer", "high"),
            ("p2", "没有", "r", "c2", "given", "low")]
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string, category string, "
                                     "prompt_type string, risk_level string")
    groups = P.must_include_groups(["场景分类", "客服回复", "安抚/理解"])
    c = P.check_pairs(df, groups).collect()[0]
    assert (c.num_pairs, c.violations, c.duplicate_triplets) == (3, 1, 1)
    st = {(r.dimension, r.value): r.n for r in P.pair_stats(df).collect()}
    assert st[("num_pairs", None)] == 3
    for dim in ("category", "prompt_type", "risk_level"):
        assert sum(n for (d, _), n in st.items() if d == dim) == 3


# ---------------------------------------------------------------- token sequences
def test_last_assistant_and_masking(spark):
    cases = [[M("system", "s"), M("user", "q"), M("assistant", "ab")],
             [M("user", "q"), M("assistant", "a1"), M("user", "q2"), M("assistant", "a2"), M("user", "q3")],
             [M("user", "q")]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, messages {MSG_T}")
    idx = [r.k for r in df.select("i", TK.last_assistant_index("messages").alias("k")).orderBy("i").collect()]
    assert idx == [2, 3, None]
    ex = TK.masked_examples(df, max_length=10_000, keep=("i",)).orderBy("i").collect()
    assert [r.i for r in ex] == [0, 1]
    for r, c in zip(ex, cases):
        k = max(j for j, m in enumerate(c) if m["role"] == "assistant")
        prompt = py_render(c[:k], gen=True, thinking=False)
        answer = c[k]["content"] + D.IM_END
        assert r.input_ids == [ord(ch) for ch in prompt + answer]
        assert r.labels == [-100] * len(prompt) + [ord(ch) for ch in answer]
        assert r.attention_mask == [1] * len(r.input_ids)
    short = TK.masked_examples(df, max_length=5, keep=("i",)).collect()
    assert all(len(r.input_ids) == 5 and len(r.labels) == 5 for r in short)


def test_pad_batches(spark):
    rows = [(i, list(range(i % 7 + 1)), [1] * (i % 7 + 1), [-100] + list(range(i % 7))) for i in range(21)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, attention_mask array<int>, labels array<int>")
    out = TK.pad_batches(df, 4, "k", pad_id=0).orderBy("k").collect()
    assert [r.batch for r in out] == [i // 4 for i in range(21)]
    for b in range(6):
        members = [r for r in out if r.batch == b]
        longest = max(i % 7 + 1 for i in range(21) if i // 4 == b)
        target = -(-longest // 8) * 8
        for r in members:
            n = r.k % 7 + 1
            assert len(r.input_ids) == target
            assert r.input_ids[n:] == [0] * (target - n)
            assert r.attention_mask == [1] * n + [0] * (target - n)
            assert r.labels[n:] == [-100] * (target - n)


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],), ([5.0],)], "v array<double>")
    assert [r.a for r in df.select(TK.argmax("v").alias("a")).collect()] == [1, 0]


def test_check_pairs_against_brute_force(spark):
    import random
    rnd = random.Random(4)
    vocab = ["场景分类：x 客服回复：y 理解", "场景分类：x", "a", "", None]
    rows = [(rnd.choice(["p1", "p2", None]), rnd.choice(vocab), rnd.choice(["r1", "r2"])) for _ in range(300)]
    rows += [("p1", "a", "r1")] * 5 + [("ab", "c", "r"), ("a", "bc", "r")]   # duplicates and near-duplicates
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string")
    groups = P.must_include_groups(["场景分类", "客服回复", "安抚/理解"])
    c = P.check_pairs(df, groups).collect()[0]

    def violates(ch):
        text = ch or ""
        return any(not any(t in text for t in g) for g in groups)

    assert c.num_pairs == len(rows)
    assert c.violations == sum(1 for _, ch, _ in rows if violates(ch))
    assert c.duplicate_triplets == len(rows) - len(set(rows))
