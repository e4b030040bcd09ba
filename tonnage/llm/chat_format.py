"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant texts are intersected
with the sorted token spans by binary search: a token's share of the loss is the part of it that lies inside an
assistant text, so tokens that straddle a border neither lose text nor pull marks into the loss.

The template writes `### <role>: <text></turn>` and a line end per turn. A backslash, `###` and `</turn>` inside a role or
text, and `:` inside a role, get a backslash before them, so the rendered conversation can be read back exactly.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound

#: Vocabulary file of a public byte-level tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LEARNED = "assistant"
_HEAD, _TAIL = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): ((?:[^\\]|\\(?:\\|###|</turn>|:))*?)</turn>\n", re.DOTALL)
SCHEMA = "conv_id bigint, formatted string, input_ids array<int>, token_spans array<int>, loss_spans array<int>"


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that the model is to learn, in code points."""
    parts, at, learned = [], 0, []
    for role, text in turns:
        head, body = f"{_HEAD}{escape(role, True)}: ", escape(text)
        parts += [head, body, f"{_TAIL}\n"]
        if role == LEARNED:
            learned.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(_TAIL) + 1
    return "".join(parts), learned


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def masked(token_spans: list[tuple[int, int]], learned: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Per token the part of it inside a learned span (start = end, if none). Spans and tokens ascend; the pieces of a
    character that several tokens share carry the same offsets, and the loss then holds the character with each of them."""
    starts = [s for s, _ in learned]
    out = []
    for s, e in token_spans:
        k = bisect.bisect_right(starts, s) - 1
        if k >= 0 and s < learned[k][1]:
            out.append((s, min(e, learned[k][1])))
        elif k + 1 < len(learned) and e > starts[k + 1]:
            out.append((starts[k + 1], min(e, learned[k + 1][1])))
        else:
            out.append((s, s))
    return out


def loss_text(formatted: str, loss_spans: list[tuple[int, int]]) -> str:
    """All text under the mask, each character once, still escaped."""
    parts, at = [], 0
    for s, e in loss_spans:
        if e > max(s, at):
            parts.append(formatted[max(s, at) : e])
            at = e
    return "".join(parts)


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, token_spans and loss_spans (flattened start, end per token).

    Turns are ordered by turn, then role and text; null turn first, null role and text are empty. Rows that repeat are turns
    of their own. Rows with a null conv_id form one conversation. A conversation is a unit of work and is held by one task;
    its rows are gathered by a shuffle on conv_id, and conversations are encoded in batches.
    """
    rows = bound(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    turns = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turns)).alias("turns"))
    held: list = []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(tokenizer)
            made.encode_special_tokens = True  # their strings in a text are ordinary text
            held.append(made)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in part["turns"].to_pylist()]
                texts = [text for text, _ in done]
                tokens = held[0].encode_batch(texts, add_special_tokens=False)
                spans = [np.array(t.offsets, np.int32).ravel() for t in tokens]
                loss = [np.array(masked(t.offsets, learned), np.int32).ravel() for t, (_, learned) in zip(tokens, done, strict=True)]
                lists = [pa.array(x, pa.list_(pa.int32())) for x in ([t.ids for t in tokens], spans, loss)]
                yield pa.RecordBatch.from_arrays([part["conv_id"], pa.array(texts, pa.string()), *lists], ["conv_id", "formatted", "input_ids", "token_spans", "loss_spans"])

    return whole.mapInArrow(encode, SCHEMA)


def read_back(done: DataFrame) -> DataFrame:
    """What a formatted conversation says about itself: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_tokens. Digests are of the turns (role, line end, text, line end) and of the unescaped loss text."""

    @F.arrow_udf("struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string>")
    def check(texts: pa.Array, loss: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), loss, strict=True):
            turns = parse(text)
            flat = spans.values.to_numpy()
            learned = unescape(loss_text(text, list(zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True))))
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append({"n_turns": len(turns), "turns_sha256": _sha(said), "loss_chars": len(learned), "loss_sha256": _sha(learned)})
        return pa.array(out, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))

    checked = done.select("conv_id", check("formatted", "loss_spans").alias("r"), F.length("formatted").cast("bigint").alias("formatted_chars"), F.size("input_ids").cast("bigint").alias("n_tokens"))
    return checked.select("conv_id", "r.*", "formatted_chars", "n_tokens")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
