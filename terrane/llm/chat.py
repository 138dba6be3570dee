"""Chat formatting with loss masks that are aligned by character offsets.

Rows arrive by conversation and turn. A conversation is written with turn marks, and the text between two marks is
escaped so that no control string is left in it, reversibly. The text is encoded once, with offsets;
the marks are single tokens, so no token crosses a turn. Sorted turn spans and sorted token spans are
intersected by binary search, which gives the tokens that count in the loss.

The marks also cut the encoding: what is encoded in one call is a run of whole turns of bounded size, and the ids
are those of the whole conversation. So memory follows the longest turn, not the longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import table
from terrane.session import Stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
#: What must not be left inside a text: own marks, and control strings that other templates use.
_CONTROL = r"(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])"
_RAW = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_FORMATTED = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
PART = 1 << 18  # characters that are encoded in one call
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """One backslash more after the first character of every control string, escaped or not."""
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the texts that count in the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _FORMATTED.findall(formatted)]


def loss_mask(tokens: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (start, end) lie in one of the sorted spans."""
    if not len(tokens) or not spans:
        return np.zeros(len(tokens), bool)
    s = np.asarray(spans, np.int64)
    k = np.searchsorted(s[:, 0], tokens[:, 0], side="right") - 1
    return (k >= 0) & (tokens[:, 1] <= s[np.maximum(k, 0), 1]) & (tokens[:, 1] > tokens[:, 0])


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.post_processor = None
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return t


def _formatted(vocabulary: str, kind: str):
    """Formats sorted rows; a row for each part: the text, ids, loss mask, and which part of its conversation it is."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        names = ["conv_id", "part", "formatted", "ids", "loss"]
        current, part, held, size, started = None, 0, [], 0, False
        out: list[list] = [[] for _ in names]

        def flush():
            nonlocal held, size, part
            text, spans = render(held)
            e = tok.encode(text, add_special_tokens=False)
            mask = loss_mask(np.asarray(e.offsets, np.int64).reshape(-1, 2), spans)
            for column, x in zip(out, (current, part, text, np.asarray(e.ids, np.int32), mask)):
                column.append(x)
            held, size, part = [], 0, part + 1

        def full():
            nonlocal out
            done = pa.RecordBatch.from_arrays([
                pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                pa.array(out[3], pa.list_(pa.int32())), pa.array([m.tolist() for m in out[4]], pa.list_(pa.bool_()))], names=names)
            out = [[] for _ in names]
            return done

        for b in rows:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if started and conv != current:
                    flush()
                    part = 0
                elif size > PART:
                    flush()
                current, started = conv, True
                held.append((role or "", text or ""))
                size += len(text or "")
            if sum(map(len, out[2])) > 4 << 20:
                yield full()
        if started:
            flush()
        yield full()
    return batches


def format_conversations(turns: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, part, formatted, ids, loss): whole turns in order, with a loss flag for each token.

    Turns are ordered by turn, then role and text; rows without a turn come first. Null roles and texts are empty,
    null conversations are one conversation, repeated rows stay. A conversation over PART characters
    has several parts, which follow each other. Other columns are not read.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    return rows.select("conv_id", "role", "text").mapInArrow(
        _formatted(vocabulary, arrow), f"conv_id {kind.simpleString()}, part long, formatted string, ids array<int>, loss array<boolean>")


def _read_back(vocabulary: str):
    """Digests of sorted parts, from the written text, ids and mask alone."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        tok = tokenizer(vocabulary)
        current, state = None, None

        def row():
            return [current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]]

        for b in rows:
            done = []
            for conv, text, ids, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "ids", "loss"))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for body in masked_texts(tok, ids, loss):
                    plain = unescape(body)
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
                state[5] += len(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field("conv_id").type if i == 0 else None) for i, c in enumerate(zip(*done))], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], b.schema.field("conv_id").type if i == 0 else None) for i, c in enumerate(row())], names=names)
    return batches


def masked_texts(tok, ids: list[int], loss: list[bool]) -> list[str]:
    """The texts under the loss mask, one for each run of masked tokens; only ids and mask are used."""
    out, run = [], []
    for i, m in zip(ids, loss):
        if m:
            run.append(i)
        elif run:
            out.append(tok.decode(run, skip_special_tokens=False))
            run = []
    if run:
        out.append(tok.decode(run, skip_special_tokens=False))
    return out


def conversation_digests(formatted: DataFrame, vocabulary: str) -> DataFrame:
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "formatted", "ids", "loss").mapInArrow(
        _read_back(vocabulary), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def op3_chat_loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations")
    # the conversation that tests the escapes, as SQL values
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{own}'), (-1L, 1L, 'assistant', '{own}') AS t(conv_id, turn, role, text)")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    formatted = Stored(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(extra), vocabulary)).table
    return conversation_digests(formatted, vocabulary)
