"""Chat formatting with compiled templates, and reading the formatted text back.

Control strings are those between ``<|`` and ``|>``. Inside roles and texts ``<`` with
any number of backslashes and ``|`` gets one backslash more, so no ``<|`` of theirs is
left and the step can be undone exactly. A role is also kept on one line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.template import compile_template

TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' ~ (m.role | line) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{% endfor %}"
)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_LINE = {"\\": "\\\\", "\n": "\\n"}


def guard(text: str | None) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text or "")


def unguard(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def line(role: str | None) -> str:
    return guard(re.sub(r"[\\\n]", lambda m: _LINE[m[0]], role or ""))


def unline(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(role))


FILTERS = {"guard": guard, "line": line}


def _format(template: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template, FILTERS)
        for batch in batches:
            done = [render({"messages": [{"role": t["role"], "text": t["text"]} for t in turns]}) for turns in batch["turns"]]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "formatted": [t for t, _ in done], "generation": spans})

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE, by: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, formatted, generation (spans of code points to train on): one row per conversation.

    ``rows``: conv_id, turn, role, text; other columns are ignored. Turns are put in
    order of turn (null first), then role, then text; a null role or text is empty; rows
    that repeat are turns like any other. Rows without conv_id form one conversation.
    ``by`` names columns that tell conversations of one id apart. An empty table gives
    an empty result. A conversation becomes one text, so it is built as one row.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id", *by).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, generation array<struct<start: int, end: int>>"
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInPandas(_format(template), schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unline(m[1]), unguard(m[2])) for m in _TURN.finditer(formatted)]


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for conv_id, text, spans in zip(batch["conv_id"], batch["formatted"], batch["generation"], strict=True):
            turns = read_back(text)
            trained = "".join(unguard(text[s["start"] : s["end"]]) for s in spans)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from formatted text and spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
