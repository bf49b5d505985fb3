"""Chat formatting by grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic parser reads the rendered turn back; while what
it recovers differs from the source, the conflicting part (role or text) is escaped and the turn is rendered anew. Escapes
are reversible: in a text, a control string gets one backslash more after its ``<`` than it has; in a role, control
characters become %XX.

Turns are rendered and checked one by one, on any partition. Reading back runs over each conversation in turn order; it
streams, holding a pending tail and two hash states, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_CODED = re.compile(r"%([0-9A-F]{2})")


def escape_text(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<\\{m[1]}|{m[2]}|>", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|{m[2]}|>", text)


def escape_role(role: str) -> str:
    return re.sub(r"[%<>\n]", lambda m: f"%{ord(m[0]):02X}", role)


def unescape_role(role: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered string, or None if it isn't whole turns throughout."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or any(mark in part for mark in (START, END) for part in m.groups()):
            return None
        turns.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and where the text starts and ends in it; it parses back to exactly this role and text."""
    shown = [role, text]
    for fix in (None, escape_text, escape_role):
        if fix is escape_text:
            shown[1] = escape_text(text)
        elif fix is escape_role:
            shown[0] = escape_role(role)
        out = f"{START}{shown[0]}\n{shown[1]}{END}\n"
        if parse(out) == [(role, text)]:
            at = len(START) + len(shown[0]) + 1
            return out, at, at + len(shown[1])
    raise ValueError(f"a turn of role {role!r} doesn't survive the round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered, loss_start, loss_end) for each row.

    The loss span is that of the text within ``rendered`` for assistant turns and empty (0, 0) otherwise. Null roles and
    texts are empty strings; repeated turns stay; null conv_ids form one conversation; an empty table gives no rows.
    Texts may be of any length; other columns, of any name, are not read.
    """

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [render_turn(r, t) for r, t in zip(b["role"], b["text"], strict=True)]
            trained = (b["role"] == "assistant").tolist()
            b["rendered"] = [m[0] for m in made]
            b["loss_start"] = [m[1] if x else 0 for m, x in zip(made, trained, strict=True)]
            b["loss_end"] = [m[2] if x else 0 for m, x in zip(made, trained, strict=True)]
            yield b.drop(columns="text")

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.mapInPandas(render, "conv_id long, turn long, role string, rendered string, loss_start long, loss_end long")


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the rendered turns in order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, done = None, []

        def finish():
            done.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        for b in batches:
            ids = b["conv_id"].astype("Int64")
            for conv, rendered, start, end in zip(ids, b["rendered"], b["loss_start"], b["loss_end"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if state is None or state["id"] != conv:
                    if state is not None:
                        finish()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in parse(rendered):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                masked = unescape_text(rendered[start:end])
                state["loss"].update(masked.encode())
                state["loss_chars"] += len(masked)
                state["chars"] += len(rendered)
            yield _rows(done)
            done = []
        if state is not None:
            finish()
        yield _rows(done)

    # one conversation's digests follow its turns in order, so they meet in one task, which streams
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_end").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format and read back every conversation: ``read_back(format_turns(conversations))``."""
    return read_back(format_turns(conversations))
