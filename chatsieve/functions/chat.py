"""Chat-format rendering of ``messages`` arrays (row-local column expressions).

Renders the role-tagged layout used for training and prompting:

    <|im_start|>{role}\\n{content}<|im_end|>\\n   for system / user turns
    <|im_start|>assistant\\n{content}<|im_end|>\\n for assistant turns

An assistant turn after the last user turn that is the final message (or
carries reasoning) gets a think block; a generation prompt with thinking
disabled appends an empty think block.  Tool turns are wrapped as
``tool_response`` blocks inside a user turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsieve import defaults as D
from chatsieve.functions.text import lstrip_newlines, rstrip_newlines, strip_newlines

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
TOOL_OPEN = "<tool_response>"
TOOL_CLOSE = "</tool_response>"


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def last_query_index(messages: Column) -> Column:
    """0-based index of the last user message that is not a tool response;
    ``size - 1`` when there is none."""
    idx = F.transform(messages, lambda m, i: F.when(is_query(m["role"], m["content"]), i)
                      .otherwise(F.lit(-1)))
    best = F.array_max(idx)
    return F.when(F.coalesce(best, F.lit(-1)) >= 0, best).otherwise(F.size(messages) - 1)


def _assistant(content: Column, i: Column, n: Column, lqi: Column) -> Column:
    has_think = F.contains(content, F.lit(THINK_CLOSE))
    before = F.substring_index(content, THINK_CLOSE, 1)
    reasoning = F.when(has_think, lstrip_newlines(F.substring_index(rstrip_newlines(before), THINK_OPEN, -1))) \
        .otherwise(F.lit(""))
    body = F.when(has_think, lstrip_newlines(F.substring_index(content, THINK_CLOSE, -1))).otherwise(content)
    head = F.lit(D.IM_START + "assistant\n")
    with_think = F.concat(head, F.lit(THINK_OPEN + "\n"), strip_newlines(reasoning),
                          F.lit("\n" + THINK_CLOSE + "\n\n"), lstrip_newlines(body))
    plain = F.concat(head, body)
    after_query = i > lqi
    use_think = after_query & ((i == n - 1) | (reasoning != F.lit("")))
    return F.concat(F.when(use_think, with_think).otherwise(plain), F.lit(D.IM_END + "\n"))


def fragment(role: Column, content: Column, i: Column, n: Column, lqi: Column,
             prev_role: Column, next_role: Column) -> Column:
    """Rendered text of message ``i`` (0-based) of ``n``.

    ``lqi`` is the conversation's last-query index; ``prev_role`` /
    ``next_role`` are the neighbours' roles (null at the ends) and only
    matter for tool turns.
    """
    content = F.coalesce(content, F.lit(""))
    tool = F.concat(
        F.when((i == 0) | ~F.coalesce(prev_role == "tool", F.lit(False)), F.lit(D.IM_START + "user"))
        .otherwise(F.lit("")),
        F.lit("\n" + TOOL_OPEN + "\n"), content, F.lit("\n" + TOOL_CLOSE),
        F.when((i == n - 1) | ~F.coalesce(next_role == "tool", F.lit(False)), F.lit(D.IM_END + "\n"))
        .otherwise(F.lit("")))
    return (F.when(role.isin("user", "system"),
                   F.concat(F.lit(D.IM_START), role, F.lit("\n"), content, F.lit(D.IM_END + "\n")))
            .when(role == "assistant", _assistant(content, i, n, lqi))
            .when(role == "tool", tool)
            .otherwise(F.lit("")))


def is_query(role: Column, content: Column) -> Column:
    """A user message that is not a wrapped tool response."""
    c = F.coalesce(content, F.lit(""))
    return (role == "user") & ~(F.startswith(c, F.lit(TOOL_OPEN)) & F.endswith(c, F.lit(TOOL_CLOSE)))


def message_fragments(messages: Column) -> Column:
    """Rendered text of every message, as an array aligned with ``messages``."""
    n = F.size(messages)
    lqi = last_query_index(messages)

    def frag(m, i):
        prev_role = F.when(i > 0, F.element_at(messages, i)["role"])
        next_role = F.when(i < n - 1, F.element_at(messages, i + 2)["role"])
        return fragment(m["role"], m["content"], i, n, lqi, prev_role, next_role)

    return F.transform(messages, frag)


def render_chat(messages: Column, add_generation_prompt: bool = False,
                enable_thinking: bool = True) -> Column:
    text = F.array_join(message_fragments(messages), "")
    if add_generation_prompt:
        tail = D.IM_START + "assistant\n" + ("" if enable_thinking else D.EMPTY_THINK_BLOCK)
        text = F.concat(text, F.lit(tail))
    return text


def system_user_messages(user_content: Column, system_prompt: str = D.SYSTEM_PROMPT) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user_content.alias("content")),
    )


def render_prompt(user_content: Column, system_prompt: str = D.SYSTEM_PROMPT) -> Column:
    """System + user prompt with a generation prompt and thinking disabled.

    Same result as ``render_chat`` on the two messages, written as one
    ``concat`` so the hot path carries no array.
    """
    return F.concat(
        F.lit(D.IM_START + "system\n" + system_prompt + D.IM_END + "\n" + D.IM_START + "user\n"),
        user_content,
        F.lit(D.IM_END + "\n" + D.IM_START + "assistant\n" + D.EMPTY_THINK_BLOCK))
