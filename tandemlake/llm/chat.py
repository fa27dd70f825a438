"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn. A batch of turns becomes one buffer: segment lengths (header, text, footer)
are arrays, their running sums are the segments' places, and headers, texts and footers are copied there by index
arithmetic in numpy. The buffer then is the data of an Arrow column; no string is built per turn.

A turn is  <|im_start|>ROLE\\nTEXT<|im_end|>\\n . Inside roles and texts control strings are broken up by ESCAPE after
their first character, and each ESCAPE of the text's own is doubled; both are undone by dropping one ESCAPE of each
(ESCAPE, character) pair. A line end in a role is ESCAPE n. So no text can close a turn, open one, or pass for one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

# The template's marks, and control strings of public chat templates.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\x1a"
NEEDED = "|".join(map(re.escape, (ESCAPE, *CONTROLS)))
_needed = re.compile(NEEDED)


def escape(s: str) -> str:
    return _needed.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], s)


def unescape(s: str) -> str:
    return re.sub(f"{ESCAPE}(.)", r"\1", s, flags=re.DOTALL) if ESCAPE in s else s


def escape_role(s: str) -> str:
    return escape(s).replace("\n", ESCAPE + "n")


def unescape_role(s: str) -> str:
    return re.sub(f"{ESCAPE}(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.DOTALL)


def escaped(column: pa.Array) -> pa.Array:
    """A text column with its control strings escaped; rows that hold none, nearly all, aren't touched."""
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    hit = pc.match_substring_regex(column, NEEDED)
    if not pc.any(hit).as_py():
        return column
    return pc.replace_with_mask(column, hit, pa.array([escape(s) for s in column.filter(hit).to_pylist()], pa.large_string()))


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    """Copies data's segments (limits at) to the places `to` of out."""
    size = np.diff(at)
    out[np.repeat(to - at[:-1], size) + np.arange(at[-1])] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of a batch of turns, the turns' limits, and where each turn's text starts and ends."""
    coded = roles.cast(pa.string()).fill_null("").dictionary_encode()
    heads, head_at = utf8(pa.array([f"{OPEN}{escape_role(r)}\n" for r in coded.dictionary.to_pylist()], pa.large_string()))
    code = np.asarray(coded.indices).astype(np.int64)
    text, text_at = utf8(escaped(texts))
    foot = np.frombuffer(f"{CLOSE}\n".encode(), np.uint8)
    head_size, text_size = np.diff(head_at)[code], np.diff(text_at)
    limits = np.concatenate([[0], np.cumsum(head_size + text_size + len(foot))])
    text_from = limits[:-1] + head_size
    text_to = text_from + text_size
    out = np.empty(limits[-1], np.uint8)
    scatter(out, limits[:-1], heads[np.repeat(head_at[code] - (np.cumsum(head_size) - head_size), head_size) + np.arange(head_size.sum())], np.concatenate([[0], np.cumsum(head_size)]))
    scatter(out, text_from, text, text_at)
    out[text_to[:, None] + np.arange(len(foot))] = foot
    return out, limits, text_from, text_to


PIECE = 8 << 10
SCHEMA = "conv_id bigint, chunk bigint, n_turns int, formatted string, loss array<struct<start:int,end:int>>"


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, chunk, n_turns, formatted, loss: the conversations, in pieces that ascend by chunk.

    A piece holds a run of whole turns of one conversation of about PIECE bytes, or one longer turn; a conversation of any
    length is spread over pieces and tasks, and readers, which take thousands of rows at once, need little memory. loss has the byte ranges of the `trained` role's texts in the piece, marks excluded.
    Null texts and roles are empty; a null conv_id is a conversation of its own; equal turns are ordered by role and
    text; null turns come first. Other columns are ignored. No rows give no rows.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*[F.col(k).cast(t).alias(k) for k, t in zip(keys, ("bigint", "bigint", "string", "string"), strict=True)]).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys[:3]]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])

    def formatted(batches):
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            out, limits, text_from, text_to = assemble(b.column("role"), b.column("text"))
            conv = b.column("conv_id")
            number = np.asarray(conv.fill_null(0)).astype(np.int64)
            null, block = np.asarray(conv.is_null()), limits[:-1] // PIECE
            cut = np.concatenate([[0], np.nonzero((number[1:] != number[:-1]) | (null[1:] != null[:-1]) | (block[1:] != block[:-1]))[0] + 1, [b.num_rows]])
            first, last = cut[:-1], cut[1:]
            at = np.concatenate([limits[first], limits[-1:]])
            pieces = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(out)]).cast(pa.string())
            learn = np.asarray(pc.equal(b.column("role").fill_null(""), trained))
            base = np.repeat(limits[first], last - first)
            spans = pa.StructArray.from_arrays([pa.array((text_from - base)[learn].astype(np.int32)), pa.array((text_to - base)[learn].astype(np.int32))], ["start", "end"])
            loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(learn)])[cut].astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(chunk + np.arange(len(first))), pa.array((last - first).astype(np.int32)), pieces, loss], ["conv_id", "chunk", "n_turns", "formatted", "loss"])
            chunk += len(first)

    return map_batches(rows, formatted, SCHEMA)


_turn = re.compile(f"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted piece."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(chats: DataFrame) -> DataFrame:
    """Of format_chats' output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations stream through their task piece by piece: a digest in progress is all that is held.
    """
    import hashlib

    rows = chats.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk")

    def run(batches):
        state, now = None, object()

        def done():
            conv, n, turns, chars, loss, size = state
            return {"conv_id": [conv], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [size]}

        def batch(found):
            types = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[k]], types.get(k, pa.int64())) for k in found[0]], list(found[0]))

        for b in batches:
            found = []
            for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        found.append(done())
                    state, now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for s in spans:
                    said = unescape(raw[s["start"] : s["end"]].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if found:
                yield batch(found)
        if state is not None:
            yield batch([done()])

    return map_batches(rows, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
