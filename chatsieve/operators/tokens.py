"""Prompts, chat rendering and masked token sequences (P1-P8, D6).

Token ids default to Unicode code points (``ascii`` of each character, a
JVM-side expression).  A real subword tokenizer is a caller-supplied hook
wrapped as an Arrow-batched pandas UDF (``tokenizer_udf``); it is the only
Python on the path and runs once per text batch, never per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsieve import defaults as D
from chatsieve.functions.chat import fragment, is_query, render_chat, render_prompt
from chatsieve.functions.text import chars
from chatsieve.operators.preference import given_category_prompt
from chatsieve.operators.ranking import exact_row_number, null_safe_join


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- P1
def eval_user_content(question, category, use_gold_category: bool, categories=None) -> Column:
    """User turn of an evaluation prompt: the known scene, or the scene list to choose from."""
    categories = categories or D.CATEGORIES
    if use_gold_category:
        return given_category_prompt(category, question)
    preamble = D.CHOOSE_CATEGORY_PREAMBLE + D.CATEGORY_JOINER.join(categories) + "\n" + D.USER_QUESTION_LABEL
    return F.concat(F.lit(preamble), _col(question))


def build_eval_prompt(question, category, use_gold_category: bool, categories=None,
                      system_prompt: str = D.SYSTEM_PROMPT) -> Column:
    return render_prompt(eval_user_content(question, category, use_gold_category, categories), system_prompt)


# ---------------------------------------------------------------- D6 on turn rows
def chat_fragments(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text",
                   with_tools: bool = False) -> DataFrame:
    """Rendered chat text of every turn of role-labelled conversations.

    The per-conversation facts the layout needs (message count, last query
    position) come from a partially aggregated ``groupBy``; neighbour roles
    (only needed for tool turns) from equi-joins on ``(conversation, turn±1)``.
    No conversation is ever gathered into one row: concatenating the
    fragments in turn order gives the conversation's text.
    ``turn`` must be a dense position 0, 1, 2, ...
    """
    stats = turns.groupBy(conv).agg(
        (F.max(turn) + 1).alias("__n"),
        F.max(F.when(is_query(F.col(role), F.col(text)), F.col(turn))).alias("__lq"))
    t = turns.join(stats, on=conv, how="inner")
    if with_tools:
        prev = turns.select(conv, (F.col(turn) + 1).alias(turn), F.col(role).alias("__prev"))
        nxt = turns.select(conv, (F.col(turn) - 1).alias(turn), F.col(role).alias("__next"))
        t = t.join(prev, on=[conv, turn], how="left").join(nxt, on=[conv, turn], how="left")
        prev_role, next_role = F.col("__prev"), F.col("__next")
    else:
        prev_role = next_role = F.lit(None).cast("string")
    lqi = F.coalesce(F.col("__lq"), F.col("__n") - 1)
    frag = fragment(F.col(role), F.col(text), F.col(turn), F.col("__n"), lqi, prev_role, next_role)
    return t.select(conv, turn, role, frag.alias("fragment"))


# ---------------------------------------------------------------- P2 / P3
def last_assistant_index(messages) -> Column:
    """0-based index of the last assistant message; null when there is none."""
    m = _col(messages)
    pos = F.array_position(F.reverse(F.transform(m, lambda x: x["role"])), F.lit("assistant"))
    return F.when(pos > 0, (F.size(m) - pos).cast("int"))


def prompt_and_answer(messages, eos: str = D.IM_END) -> tuple[Column, Column]:
    """(messages before the last assistant turn, its content + end marker).

    Messages after the last assistant turn are dropped.  Null when there is
    no assistant message (the original raises; see ``masked_examples``).
    """
    m = _col(messages)
    idx = last_assistant_index(m)
    prompt_msgs = F.when(idx.isNotNull(), F.slice(m, 1, idx))
    answer = F.when(idx.isNotNull(), F.concat(F.coalesce(F.element_at(m, idx + 1)["content"], F.lit("")),
                                               F.lit(eos)))
    return prompt_msgs, answer


# ---------------------------------------------------------------- P4
def codepoint_ids(text) -> Column:
    """Default token ids: the code point of every character."""
    return F.transform(chars(_col(text)), lambda c: F.ascii(c))


def tokenizer_udf(encode: Callable[[str], list[int]]):
    """Wrap ``encode(text) -> ids`` as an Arrow-batched pandas UDF."""
    import pandas as pd

    def _tok(s):
        return s.map(lambda x: None if x is None else list(encode(x)))

    # real classes, not postponed strings, so Spark can infer the UDF kind
    _tok.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(_tok, T.ArrayType(T.IntegerType()))


def masked_sequence(prompt_ids: Column, answer_ids: Column, max_length: int | None) -> dict[str, Column]:
    """input_ids = prompt ++ answer, labels = -100 x prompt ++ answer, mask = 1s;
    all right-truncated to ``max_length`` (None: whole)."""
    ids = F.concat(prompt_ids, answer_ids)
    labels = F.concat(F.transform(prompt_ids, lambda _x: F.lit(D.IGNORE_INDEX)), answer_ids)
    mask = F.transform(ids, lambda _x: F.lit(1))
    if max_length is None:
        return {"input_ids": ids, "attention_mask": mask, "labels": labels}
    return {
        "input_ids": F.slice(ids, 1, max_length),
        "attention_mask": F.slice(mask, 1, max_length),
        "labels": F.slice(labels, 1, max_length),
    }


def masked_examples(df: DataFrame, max_length: int | None, messages="messages",
                    encode: Callable[[Column], Column] = codepoint_ids, eos: str = D.IM_END,
                    keep=("category", "source")) -> DataFrame:
    """Training sequences from chat rows; rows without an assistant turn are dropped
    (count them with ``last_assistant_index(...).isNull()``)."""
    prompt_msgs, answer = prompt_and_answer(messages, eos)
    prompt_text = render_chat(prompt_msgs, add_generation_prompt=True, enable_thinking=False)
    staged = df.select(*[F.col(k) for k in keep if k in df.columns],
                       encode(prompt_text).alias("__p"), encode(answer).alias("__a")) \
        .where(F.col("__a").isNotNull())
    seq = masked_sequence(F.col("__p"), F.col("__a"), max_length)
    return staged.select(*[k for k in keep if k in df.columns], *[v.alias(k) for k, v in seq.items()])


# ---------------------------------------------------------------- P5
def pad_batches(df: DataFrame, batch_size: int, order_col, pad_id: int = 0,
                multiple: int = D.PAD_MULTIPLE) -> DataFrame:
    """Pad each batch of ``batch_size`` consecutive rows (in ``order_col``
    order, a unique column or a list that is unique together) to the batch's
    longest sequence rounded up to ``multiple``: ids with ``pad_id``, mask
    with 0, labels with -100.

    The global order comes from ``exact_row_number`` (range partitioning +
    offsets) over a narrow table of keys and lengths, so only that is
    sorted and checkpointed; the token arrays meet it in one join on the key.
    """
    keys = [order_col] if isinstance(order_col, str) else list(order_col)
    narrow = df.select(*keys, F.size("input_ids").alias("__len"))
    numbered = exact_row_number(narrow, [], keys, "__rn")
    numbered = numbered.withColumn("batch", F.floor((F.col("__rn") - 1) / batch_size).cast("long"))
    longest = numbered.groupBy("batch").agg(F.max("__len").alias("__max"))
    target = (F.ceil(F.col("__max") / multiple) * multiple).cast("int") if multiple else F.col("__max")
    plan = numbered.join(longest, "batch").select(*keys, "batch", (target - F.col("__len")).alias("__pad"))
    j = null_safe_join(df, plan, keys)
    pad = lambda v: F.array_repeat(F.lit(v), F.col("__pad"))
    return j.select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")], "batch",
        F.concat("input_ids", pad(pad_id)).alias("input_ids"),
        F.concat("attention_mask", pad(0)).alias("attention_mask"),
        F.concat("labels", pad(D.IGNORE_INDEX)).alias("labels"))


# ---------------------------------------------------------------- P8
def argmax(v) -> Column:
    """0-based index of the first maximum of a numeric array (null for empty)."""
    a = _col(v)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def token_predictions(logits) -> Column:
    """argmax over the vocabulary axis of a [position][vocab] score array."""
    return F.transform(_col(logits), lambda v: argmax(v))


def chunked_predictions(scores: DataFrame, by: list[str], first: str = "first", values: str = "scores",
                        out: str = "pred") -> DataFrame:
    """``by`` and the first token of the highest score, from scores in chunks of the vocabulary.

    A row holds the scores of the tokens from ``first`` on.  Each chunk gives its
    own maximum (row-local), and the maxima of a position meet in one partially
    aggregated ``max``, so no row holds a whole vocabulary and none is shuffled.
    """
    best = F.struct(F.array_max(values).alias("score"), (-(F.col(first) + argmax(values))).alias("back"))
    return scores.where(F.size(values) > 0).groupBy(*by).agg(F.max(best).alias("__best")).select(
        *by, (-F.col("__best.back")).cast("int").alias(out))
