"""Chat formatting by token-level assembly.

Each segment (a role's name, a text) is escaped and encoded by itself; control
tokens are reserved ids above the vocabulary that are spliced in between, so no
content can produce one. The loss mask marks the contents of assistant turns:
+1 where such a content starts, -1 where it ends, then a prefix sum.

In the text form a control string that occurs in content is told from a real one
by an escape: backslashes are doubled and a backslash is put behind the first
character of the control string; ``unescape`` undoes both.

A row holds one turn, so no row grows with its conversation:
(conv_id, seq, ids, mask), where seq counts from 0 in each conversation. The
ids of a conversation are its rows' ids in the order of seq.

Turns are ordered by (turn, role, text), nulls first, so repeated rows and tied
turns have a defined order. Null role and text count as empty; null conv_id is a
conversation of its own. One conversation is read by one task, as a stream: its
digests are over one string. Encoding and decoding don't depend on that order
and run before and after, spread over all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[END]")
BOS, EOS, SYS, SYS_END, INST, INST_END, ANS, ROLE, ROLE_END, END = range(len(CONTROLS))
#: What opens and what closes a turn of a role; others carry the role's name.
TEMPLATE = {"system": (SYS, SYS_END), "user": (INST, INST_END), "assistant": (ANS, EOS)}
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows (conv_id, seq, ids array<int>, mask array<boolean>) from rows (conv_id, turn, role, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer)
        for batch in batches:
            conv, turn, role, text = (c.to_pylist() for c in batch.columns)
            role, text = [r or "" for r in role], [t or "" for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(role), pa.array(text), pa.array([bpe.packed(escape(t)) for t in text], pa.binary())], names=["conv_id", "turn", "role", "text", "content"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer)
        last, seq = object(), 0
        for batch in batches:
            convs, seqs, ids, masks = [], [], [], []
            for conv, role, content in zip(*(c.to_pylist() for c in batch.columns)):
                seq = seq + 1 if conv == last else 0
                last = conv
                body = np.frombuffer(content, bpe.wide).astype(np.int32)
                if role in TEMPLATE:
                    front, back = [TEMPLATE[role][0]], TEMPLATE[role][1]
                    head = np.array([bpe.size + front[0]], np.int32)
                else:
                    back = END
                    head = np.concatenate([[bpe.size + ROLE], bpe.ids(escape(role)), [bpe.size + ROLE_END]]).astype(np.int32)
                if seq == 0:
                    head = np.concatenate([[bpe.size + BOS], head]).astype(np.int32)
                whole = np.concatenate([head, body, [bpe.size + back]]).astype(np.int32)
                change = np.zeros(len(whole) + 1, np.int8)
                if role == "assistant":
                    change[len(head)] += 1
                    change[len(head) + len(body)] -= 1
                convs.append(conv)
                seqs.append(seq)
                ids.append(whole)
                masks.append(np.cumsum(change[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=["conv_id", "seq", "ids", "mask"])

    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    encoded = turns.mapInArrow(encode, "conv_id long, turn long, role string, text string, content binary")
    in_order = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "content")
    return in_order.mapInArrow(assemble, "conv_id long, seq long, ids array<int>, mask array<boolean>")


def read_turn(ids: np.ndarray, mask: np.ndarray, bpe: tokens.ByteBpe) -> tuple[str, str, str, str]:
    """Role, text, text under the mask and the text form of one row's ids."""
    at = np.flatnonzero(ids >= bpe.size)
    marks = [int(ids[k]) - bpe.size for k in at]
    spans, shown, before = [], [], 0
    for k, m in zip(at.tolist(), marks):
        spans.append(bpe.text(ids[before:k]))
        shown += [spans[-1], CONTROLS[m]]
        before = k + 1
    if marks[0] == BOS:
        marks, spans = marks[1:], spans[1:]
    if marks[0] == ROLE:
        role, text = unescape(spans[1]), unescape(spans[2])
    else:
        role, text = next(r for r, (first, _) in TEMPLATE.items() if first == marks[0]), unescape(spans[1])
    return role, text, unescape(bpe.text(ids[mask])) if mask.any() else "", "".join(shown)


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row: conv_id, seq, role, text, loss_text and the length of the text form, from the ids alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer)
        for batch in batches:
            rows = [read_turn(np.array(i, np.int64), np.array(m, bool), bpe) for i, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            role, text, loss, shown = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(loss, pa.string()), pa.array([len(s) for s in shown], pa.int64())], names=["conv_id", "seq", "role", "text", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "seq", "ids", "mask").mapInArrow(decode, "conv_id long, seq long, role string, text string, loss_text string, formatted_chars long")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests of each conversation over the rows of ``read_back``, streamed in the order of seq."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []

        def row():
            return last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            for conv, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != last:
                    if state is not None:
                        done.append(row())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield out(done)
                done = []
        if state is not None:
            yield out([row()])

    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "role", "text", "loss_text", "formatted_chars")
    return in_order.mapInArrow(digest, DIGEST)
