"""Chat formatting with loss masks from token offsets.

A conversation is rendered whole by a template whose control strings are special tokens; control strings inside roles and texts are
escaped so that they can be restored. The rendered text is encoded once with offsets; the spans of turns and the spans of
tokens are both sorted, and binary search finds each trained turn's tokens and cuts their offsets to the turn. What is
under the mask is exactly the assistants' texts, even where a token reaches over a turn's edge.

Turns are ordered by turn, then role, then text, nulls first. Null roles and texts count as empty. Turns that are repeated are
kept. A row without conv_id belongs to no conversation: it is one of its own, of one turn. An empty table gives no rows; a conversation without assistant has an empty mask. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: The template: START role, line break, text, END.
START, END = "<|turn|>", "<|end|>"
#: Strings that may control this or another template or tokenizer: never left as they are inside a text.
CONTROLS = (START, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

# Each control string begins with a sign that none holds again, but for <<SYS>>, whose second sign is where it begins.
_HEADS = sorted({c.lstrip("<[") for c in CONTROLS}, key=len, reverse=True)
_BARE = re.compile(r"([<\[])(\\*)(" + "|".join(map(re.escape, _HEADS)) + ")")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(" + "|".join(map(re.escape, _HEADS)) + ")")


def escape(text: str) -> str:
    """One backslash more behind the first sign of every control string, and of those that have some already."""
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


@dataclass
class Rendered:
    """A conversation as one text, with the span of each turn's escaped text."""

    text: str
    roles: list[str]
    spans: np.ndarray


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return Rendered("".join(parts), [r for r, _ in turns], np.asarray(spans, np.int64).reshape(-1, 2))


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition("\n")
        out.append((unescape(role.replace("%0A", "\n").replace("%25", "%")), unescape(body)))
    return out


def loss_spans(rendered: Rendered, offsets: np.ndarray, trained: str = "assistant") -> tuple[np.ndarray, np.ndarray]:
    """The loss mask by token, and the character spans under it: of each trained turn the union of its tokens' offsets, cut to
    the turn. offsets: [tokens, 2], sorted; tokens of one character may share an offset."""
    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1]) if len(offsets) else offsets[:, 1]
    mask, spans = np.zeros(len(offsets), bool), []
    for role, (a, b) in zip(rendered.roles, rendered.spans.tolist(), strict=True):
        if role != trained or a == b:
            continue
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        mask[first:last] = True
        at = a
        for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True):
            s, e = max(s, at), min(e, b)
            if s < e:
                if spans and spans[-1][1] == s and s > a:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
                at = e
    return mask, np.asarray(spans, np.int64).reshape(-1, 2)


@cache
def tokenizer(file: str):
    """The public tokenizer with the template's control strings as special tokens: no other token reaches into one."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(file))
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in (START, END)])
    return tok


def conversations_with_probe(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and conversation -7, whose texts hold another template's control strings."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(probe)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations one after the other from rows that are sorted by conversation and turn."""
    now, turns = None, []
    for b in batches:
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if turns and (conv != now or conv is None):
                yield now, turns
                turns = []
            now = conv
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def _in_order(conversations: DataFrame) -> DataFrame:
    """Conversations whole in one partition each; rows without conv_id, however many, spread by their contents."""
    columns = ["conv_id", "turn", "role", "text"]
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return conversations.select(columns).repartition("conv_id", alone).sortWithinPartitions(*columns)


def format_conversations(conversations: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """A training row for each conversation: conv_id, formatted, ids, mask (by token), spans (characters under the mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(file)
        kinds = {"conv_id": pa.int64(), "formatted": pa.string(), "ids": pa.list_(pa.int32()), "mask": pa.list_(pa.bool_()), "spans": pa.list_(pa.list_(pa.int64()))}
        rows, size = [], 0
        for conv, turns in _grouped(batches):
            r = render(turns)
            e = tok.encode(r.text, add_special_tokens=False)
            mask, spans = loss_spans(r, np.asarray(e.offsets, np.int64).reshape(-1, 2))
            rows.append((conv, r.text, e.ids, mask, spans.tolist()))
            size += len(r.text)
            if size > 1 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return map_arrow(_in_order(conversations), run, "conv_id long, formatted string, ids array<int>, mask array<boolean>, spans array<array<bigint>>")


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of op9, read back from formatted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse(text)
                lost = "".join(_unescaped_runs(text, spans))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names)

    return map_arrow(formatted.select("conv_id", "formatted", "spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _unescaped_runs(text: str, spans: list[list[int]]) -> Iterator[str]:
    """The text under the mask, each turn unescaped on its own; spans that meet belong to one turn."""
    for a, b in spans:
        yield unescape(text[a:b])
