r"""Conversations as chat text with token ids and offset-aligned loss masks.

A turn is written as "### role:", a line feed, its text, a line feed, "</turn>" and a line feed.  A backslash makes the
next character plain: backslashes are doubled, and inside "### " and "</turn>" one stands after the first
character, so neither control string occurs in a text; in a role a line feed has one before it too.  Dropping each backslash and
keeping what follows it gives the text back.

The turns of a conversation come to one task in order, as a stream.  The conversation is rendered whole and encoded once
with offsets; sorted spans of the turns that are learned are intersected with the sorted token spans by binary search.  A
conversation beyond PART characters is rendered as several rows, cut where a turn begins, and a longer turn is encoded in pieces
that begin where a token does, so memory follows the longest turn.  The output table is

  conv_id long, part int, last boolean    a conversation's rows in order
  text string                             what was rendered
  ids array<int>, loss array<boolean>     its tokens and whether they hold a character that is learned
  starts, ends array<int>                 what those tokens hold of learned turns, as spans of text, merged
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches
from .huffman import parts_of

#: Fixed strings of the template.
HEAD, SEP, END = "### ", ":\n", "\n</turn>\n"
#: Characters of one row, about, and bytes that are encoded at once.
PART, SLICE = 1 << 18, 1 << 20
_TABLE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
)
TABLE_DDL = "conv_id long, part int, last boolean, text string, ids array<int>, loss array<boolean>, starts array<int>, ends array<int>"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_tokenizers: dict[int, object] = {}


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\\n")


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends in it."""
    head, body = HEAD + escaped_role(role) + SEP, escaped(text)
    return head + body + END, len(head), len(head) + len(body)


def masked(start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of the tokens that meet a span, starts, ends of what they hold of the spans).

    Tokens start[i]:stop[i] and spans low[k]:high[k] are sorted; tokens may share a character (a letter of several
    bytes), spans may not.  A character that no token holds is in no span of the result.
    """
    some = high > low
    low, high = low[some], high[some]
    first, after = np.searchsorted(stop, low, "right"), np.searchsorted(start, high, "left")
    size = np.maximum(after - first, 0)
    mask = np.zeros(len(start), bool)
    of = np.repeat(np.arange(len(low)), size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(of))
    mask[at] = True
    a, b = np.maximum(start[at], low[of]), np.minimum(stop[at], high[of])
    reach = np.maximum.accumulate(b) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = (of[1:] != of[:-1]) | (a[1:] > reach[:-1])
    edge = np.flatnonzero(new)
    return mask, a[edge], reach[np.append(edge[1:], len(a)) - 1] if len(a) else b


def _library(model: bytes):
    key = hash(model)
    if key not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(model.decode())
        made.encode_special_tokens = True
        _tokenizers[key] = made
    return _tokenizers[key]


def encoded(library, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, ends in characters) of each text; a long text in pieces that begin where a token does."""
    pieces = [[t] if len(t) <= SLICE // 4 else [p.decode() for p in parts_of(t.encode(), SLICE)] for t in texts]
    out = []
    for some in pieces:
        ids, spans, at = [], [], 0
        for p in some:
            e = library.encode(p, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            spans.append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)
            at += len(p)
        spans = np.concatenate(spans)
        out.append((np.concatenate(ids), spans[:, 0], spans[:, 1]))
    return out


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind))


def _format(model, learned: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(model.value)
        ready, size = [], 0  # rows that wait for their tokens
        now, part, texts, spans, n = None, 0, [], [], 0  # the conversation that is being rendered

        def flush(last):
            nonlocal part, texts, spans, n, size
            ready.append((now[0], part, last, "".join(texts), np.array(spans, np.int64).reshape(-1, 2)))
            part, size, texts, spans, n = part + 1, size + n, [], [], 0

        def batch():
            nonlocal ready, size
            got = encoded(library, [r[3] for r in ready])
            masks = [masked(a, b, r[4][:, 0], r[4][:, 1]) for r, (_, a, b) in zip(ready, got)]
            ids, parts, lasts, said, _ = zip(*ready)
            ready, size = [], 0
            lists = [_lists([g[0] for g in got], pa.int32()), _lists([m[0] for m in masks], pa.bool_()), _lists([m[1] for m in masks], pa.int32()), _lists([m[2] for m in masks], pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(lasts), pa.array(said, pa.string()), *lists], schema=_TABLE)

        for rows in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in rows.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        flush(True)
                    now, part = (conv,), 0
                elif n > PART:
                    flush(False)
                if size > PART:
                    yield batch()
                said, low, high = rendered(role, text)
                if role in learned:
                    spans.append((n + low, n + high))
                texts.append(said)
                n += len(said)
        if now is not None:
            flush(True)
            yield batch()

    return run


def formatted(conversations: DataFrame, model_path: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The output table of all conversations, texts of the learned roles under the loss mask.

    Turns are ordered by `turn`, null first; ties by the digest of role and text; repeated rows stay.  Null
    roles and texts are empty.  Rows without a conv_id make one conversation without an id.  Other columns are
    not read; an empty table gives no row.  The tokenizer must be byte-level with the usual pre-tokenizer, whose
    tokens a row's and a piece's start never cuts; strings of its special tokens are ordinary text.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.md5(F.concat(F.md5(role), F.md5(text))).alias("tie"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "tie")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(model, frozenset(learned)), TABLE_DDL)


def _loss_and_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of each conversation, from the text and the masked spans of its rows in order."""
    out = []
    for rows in batches:
        for conv, part, last, text, starts, ends in zip(*(c.to_pylist() for c in rows.columns)):
            if part == 0:
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
            chars += len(text)
            for a, b in zip(starts, ends):
                said = plain(text[a:b])
                loss.update(said.encode())
                loss_chars += len(said)
            low = 0
            while (high := text.find(END, low)) >= 0:
                role, _, said = text[low + len(HEAD) : high].partition(SEP)
                turns.update(f"{plain(role)}\n{plain(said)}\n".encode())
                n_turns, low = n_turns + 1, high + len(END)
            if last:
                out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _READ)], schema=_READ)
            out = []


def read_back(table: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of an output table.

    The rows of a conversation that has several are brought together in order, others are read where they stand.
    """
    needed = table.select("conv_id", "part", "last", "text", "starts", "ends")
    whole = needed.where("part = 0 and last").mapInArrow(_loss_and_turns, _READ_DDL)
    several = needed.where("not (part = 0 and last)").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(several.mapInArrow(_loss_and_turns, _READ_DDL))


def round_trip(conversations: DataFrame, model_path: str) -> DataFrame:
    """Write the output table below the shared folder, then read it back."""
    return read_back(save(formatted(conversations, model_path), "chats"))


#: The conversation that op13 adds: the template's control strings in a user's and an assistant's text.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"

SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {ADDED_ID}, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT {ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS i,
             length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), chr(10), '\' || chr(10))) + length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')) + 15 AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""
