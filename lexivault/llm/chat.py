"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template, encoded once, and every token's byte offsets come from the running sum
of token lengths (a byte-level vocabulary covers each byte once). The sorted spans of the turns that are trained on are
intersected with the sorted token spans by binary search; a token on a span's edge is clipped to it, so the spans under
the mask hold exactly those turns' texts.

Control strings inside texts are escaped reversibly: a backslash goes after the first character of a control string,
and one more where backslashes already stand there; nothing else changes.

Rows of a conversation come together in one task in the order of their turns, one conversation after another; a
rendered conversation is one value, so the longest conversation must fit a worker.

Defined cases: null role or text is empty; turns with equal numbers go by role, then text; a null turn comes first; a
null conversation id is one conversation; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts

START, HEAD, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that never stand unescaped in a text: our own marks and those of common chat models.
CONTROLS = (START, HEAD, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

OUT = "conv_id long, formatted string, ids array<int>, loss array<struct<token:int,start:int,end:int>>"
_any = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
_escape = re.compile(_any)
_unescape = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]], train_on: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the code-point spans of the texts to train on."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{HEAD}", escape(text)
        if role == train_on:
            spans.append((n + len(head), n + len(head) + len(body)))
        out += [head, body, END + "\n"]
        n += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition(HEAD)
        turns.append((unescape(role), unescape(body[: body.rindex(END)])))
    return turns


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    vocab = t.get_vocab(with_added_tokens=False)
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        size[i] = len(token)  # a byte-level token has one character for each byte
    return t, size


def mask(formatted: str, spans: list[tuple[int, int]], token_path: str):
    """Token ids, and (token, start, end) in bytes of the formatted text for each token part under the mask."""
    tokenizer, size = _tokenizer(token_path)
    ids = np.array(tokenizer.encode(formatted, add_special_tokens=False).ids, np.int64)
    ends = np.cumsum(size[ids]) if len(ids) else np.zeros(0, np.int64)
    begins = ends - size[ids] if len(ids) else ends
    raw = np.frombuffer(formatted.encode(), np.uint8)
    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
    loss = []
    for a, b in spans:
        a, b = int(first[a]), int(first[b])
        if a == b:
            continue
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
        loss += [(int(t), max(a, int(begins[t])), min(b, int(ends[t]))) for t in range(lo, hi)]
    return ids, loss


def format_conversations(rows: DataFrame, token_path: str, train_on: str = "assistant") -> DataFrame:
    """One row for each conversation: the formatted text, its token ids and the loss mask."""
    parts.small_batches(rows.sparkSession)
    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        open_id, turns, done, held = None, [], [], 0

        def close():
            text, spans = render(turns, train_on)
            ids, loss = mask(text, spans, token_path)
            done.append({"conv_id": open_id, "formatted": text, "ids": ids, "loss": [{"token": t, "start": a, "end": b} for t, a, b in loss]})
            return len(text)

        for b in batches:
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if turns and conv != open_id:
                    held += close()
                    turns = []
                    if held > 1 << 17:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done, held = [], 0
                open_id = conv
                turns.append((role, text))
        if turns:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return dealt.mapInArrow(parts.lean(run), OUT)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: turns, and the texts under the loss mask, unescaped and joined."""
    schema = "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            convs, texts, masks = b.column("conv_id"), b.column("formatted").to_pylist(), b.column("loss")
            at, start, end = masks.offsets.to_numpy(), masks.values.field("start").to_numpy(), masks.values.field("end").to_numpy()
            turns, loss = [], []
            for text, i, j in zip(texts, at[:-1], at[1:]):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                raw, s, e = text.encode(), start[i:j], end[i:j]
                # Neighbouring tokens of one text join, so an escape over their edge reads whole.
                cut = np.flatnonzero(s[1:] != e[:-1])
                first, last = s[np.append(0, cut + 1)] if j > i else s, e[np.append(cut, -1)] if j > i else e
                loss.append("".join(unescape(raw[a:z].decode()) for a, z in zip(first.tolist(), last.tolist())))
            yield pa.RecordBatch.from_arrays([convs, pa.array(turns, pa.list_(turn)), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["conv_id", "turns", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(parts.lean(run), schema)
