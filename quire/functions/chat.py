"""Chat shaping and rendering as column expressions (P-2, P-4, P-5, P-6, R-1..R-5).

Messages are ``array<struct<role:string, content:string>>``; raw turns are
``array<struct<from:string, value:string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col_of

# Fixed values that must equal the reference's contract.
BOS = "<|im_start|>"
EOS = "<|im_end|>"
DEFAULT_SYSTEM = "你是一个AI助手"
CHATML_ROLES = ("system", "user", "assistant")
ASSISTANT_HEADER = "<|im_start|>assistant\n"

MESSAGE_TYPE = "array<struct<role:string,content:string>>"
TURN_TYPE = "array<struct<from:string,value:string>>"


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(role.alias("role"), content.alias("content"))


def rename_role(sender) -> Column:
    """P-4: ``human`` -> ``user``, ``assistant`` -> ``assistant``, other senders -> null."""
    s = col_of(sender)
    return F.when(s == "human", F.lit("user")).when(s == "assistant", F.lit("assistant"))


def known_turns(turns) -> Column:
    """P-5: keep turns from ``human`` / ``assistant`` only, in order."""
    return F.filter(col_of(turns), lambda t: t.getField("from").isin("human", "assistant"))


def dropped_turns(turns) -> Column:
    """P-5 companion: how many turns the filter drops."""
    t = col_of(turns)
    return F.coalesce(F.size(t) - F.size(known_turns(t)), F.lit(0))


def to_messages(turns, system: str = DEFAULT_SYSTEM) -> Column:
    """P-2: system turn first, then the known turns with roles renamed.

    A null or empty turn list still gives the system message.
    """
    kept = F.transform(known_turns(F.coalesce(col_of(turns), F.array().cast(TURN_TYPE))),
                       lambda t: message(rename_role(t.getField("from")), t.getField("value")))
    return F.concat(F.array(message("system", system)), kept)


def build_prompt(question, system=None) -> Column:
    """P-6: optional system message (skipped when empty or null), then one user message."""
    q = message("user", col_of(question))
    if system is None:
        return F.array(q)
    if isinstance(system, str):
        return F.array(message("system", system), q) if system else F.array(q)
    sys_msg = F.when(F.length(system) > 0, message("system", system))
    return F.filter(F.array(sys_msg, q), lambda m: m.isNotNull())


def first_of_role(messages, role: str) -> Column:
    """P-10 / P-9: content of the first message with ``role`` (null when none)."""
    return F.get(F.filter(col_of(messages), lambda m: m.getField("role") == role), 0).getField("content")


def render_chatml(messages, add_generation_prompt: bool = False) -> Column:
    """R-1: ``<|im_start|>{role}\\n{content}<|im_end|>\\n`` per system/user/assistant message."""
    parts = F.transform(
        F.filter(col_of(messages), lambda m: m.getField("role").isin(*CHATML_ROLES)),
        lambda m: F.concat(F.lit(BOS), m.getField("role"), F.lit("\n"),
                           F.coalesce(m.getField("content"), F.lit("")), F.lit(EOS + "\n")))
    out = F.array_join(parts, "")
    if add_generation_prompt:
        out = F.concat(out, F.lit(ASSISTANT_HEADER))
    return out


_PLAIN_HEAD = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}


def render_plain(messages, eos: str = EOS, add_generation_prompt: bool = False) -> Column:
    """R-2: ``System: c\\n`` / ``User: c\\n`` / ``Assistant: c{eos}\\n``."""
    def one(m):
        role, content = m.getField("role"), F.coalesce(m.getField("content"), F.lit(""))
        return (F.when(role == "system", F.concat(F.lit("System: "), content, F.lit("\n")))
                 .when(role == "user", F.concat(F.lit("User: "), content, F.lit("\n")))
                 .when(role == "assistant", F.concat(F.lit("Assistant: "), content, F.lit(eos + "\n"))))
    out = F.array_join(F.transform(F.filter(col_of(messages), lambda m: m.getField("role").isin(*CHATML_ROLES)), one), "")
    if add_generation_prompt:
        out = F.concat(out, F.lit("Assistant: "))
    return out


def render_pretrain(text, bos: str = BOS) -> Column:
    """R-3: bos + text, no eos."""
    return F.concat(F.lit(bos), col_of(text))


def render_bracketed(text, bos: str = BOS, eos: str = EOS) -> Column:
    """R-4: bos + text + eos."""
    return F.concat(F.lit(bos), col_of(text), F.lit(eos))


SEGMENT_TYPE = "array<struct<text:string,trainable:boolean>>"


def render_segments(messages, eos: str = EOS) -> Column:
    """R-5: R-2's rendering as segments; assistant content and eos are trainable."""
    def seg(text, flag: bool):
        return F.struct(text.alias("text"), F.lit(flag).alias("trainable"))

    def one(m):
        role, content = m.getField("role"), F.coalesce(m.getField("content"), F.lit(""))
        return (F.when(role == "system", F.array(seg(F.concat(F.lit("System: "), content, F.lit("\n")), False)))
                 .when(role == "user", F.array(seg(F.concat(F.lit("User: "), content, F.lit("\n")), False)))
                 .otherwise(F.array(seg(F.lit("Assistant: "), False),
                                    seg(F.concat(content, F.lit(eos)), True),
                                    seg(F.lit("\n"), False))))
    kept = F.filter(col_of(messages), lambda m: m.getField("role").isin(*CHATML_ROLES))
    return F.flatten(F.transform(kept, one))


def spells_special(text, specials=(BOS, EOS, "<unk>", "<s>", "</s>")) -> Column:
    """Q-4 flag: raw text that spells a special token (it will encode as that token)."""
    c = col_of(text)
    cond = F.lit(False)
    for s in specials:
        cond = cond | F.coalesce(c.contains(s), F.lit(False))
    return cond
