"""Prompts, conversations and their rendering, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed texts that models are asked with.
INSTRUCTION = (
    "Translate the following text from {src} to {tgt}.\n"
    "Return your response in JSON format with a single key 'translation'. The value should be the translated text."
)
EXAMPLES = "\n\nHere are some examples:\n\n"
SFT = "Translate the following text from {src} to {tgt}:\n\n"


def few_shot_prompt(text: Column, examples: Column | None, src: str, tgt: str) -> Column:
    """``examples`` are structs (source, target), best first; none or empty is zero-shot."""
    head = F.lit(INSTRUCTION.format(src=src, tgt=tgt))
    tail = F.concat(F.lit(f"\n\n{src}: "), text, F.lit(f"\n{tgt}:"))
    if examples is None:
        return F.concat(head, tail)
    lines = F.transform(examples, lambda e: F.concat(F.lit(f"{src}: "), e["source"], F.lit(f"\n{tgt}: "), e["target"]))
    block = F.when(F.size(examples) > 0, F.concat(F.lit(EXAMPLES), F.array_join(lines, "\n\n"))).otherwise(F.lit(""))
    return F.concat(head, F.coalesce(block, F.lit("")), tail)


def sft_prompt(text: Column, src: str, tgt: str) -> Column:
    return F.concat(F.lit(SFT.format(src=src, tgt=tgt)), text)


def conversation(prompt: Column, answer: Column | None = None) -> Column:
    """Messages: the user's, and the assistant's if an answer is given."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    parts = [message("user", prompt)] + ([message("assistant", answer)] if answer is not None else [])
    return F.array(*parts)


def render_chat(messages: Column, generation_prompt: bool = False) -> Column:
    """A neutral rendering; a model's own template takes its place where there is one."""
    lines = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("<|assistant|>\n" if generation_prompt else ""))
