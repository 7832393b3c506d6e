"""Chat formatting: one render, one encoding with offsets, and a loss mask cut from turn spans."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.packing import tokenizer_path
from corpusloom.llm.shared import table

#: The template: OPEN role NEWLINE text CLOSE for every turn.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
VOCABULARY = "byte_bpe_50k.json"
#: Control strings inside texts lose their first character to an entity; so does an & before one.
CONTROL = re.compile(r"<(?=\|[a-z_]+\|>|/?s>)|\[(?=/?INST\])|&(?=(?:amp|lt|lsqb);)")
ESCAPES = {"<": "&lt;", "[": "&lsqb;", "&": "&amp;"}
BACK = {v: k for k, v in ESCAPES.items()}
ENTITY = re.compile("|".join(BACK))
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)

FORMATTED = "conv_id string, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<begin:int,end:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return ENTITY.sub(lambda m: BACK[m[0]], text)


def escape_role(role: str) -> str:
    """A role lies on one line: its line feeds and backslashes are written as escapes."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of render."""
    return [(unescape_role(role), unescape(body)) for role, body in TURN.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and what they cover of the spans; both inputs are sorted.

    For every token a binary search finds the first span that ends after the token begins. A token
    that reaches over a turn's edge counts, and only its part inside the turn is covered.
    """
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool), []
    begin, end = offsets[:, 0], offsets[:, 1]
    k = np.searchsorted(spans[:, 1], begin, side="right")
    near = spans[np.minimum(k, len(spans) - 1)]
    low, high = np.maximum(begin, near[:, 0]), np.minimum(end, near[:, 1])
    mask = (k < len(spans)) & (low < high)
    low, high, k = low[mask], np.maximum.accumulate(high[mask]), k[mask]
    if not len(low):
        return mask, []
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (low[1:] > high[:-1])]))
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    return mask, list(zip(low[first].tolist(), high[last].tolist(), strict=True))


_TOKENIZERS: dict = {}


def tokenizer(where: str):
    if where not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _TOKENIZERS[where] = Tokenizer.from_file(where)
        _TOKENIZERS[where].encode_special_tokens = True
    return _TOKENIZERS[where]


def format_chats(chats: list[list[tuple[str, str]]], where: str) -> list[tuple[str, list[int], np.ndarray, list[tuple[int, int]]]]:
    """Of each chat: its text, rendered once, its ids, encoded once, their loss mask and the spans under it."""
    rendered = [render(turns) for turns in chats]
    encoded = tokenizer(where).encode_batch([text for text, _ in rendered], add_special_tokens=False)
    out = []
    for (text, spans), e in zip(rendered, encoded, strict=True):
        offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)
        out.append((text, e.ids, *token_mask(offsets, np.array(spans, dtype=np.int64).reshape(-1, 2))))
    return out


def _formatted(keys: list, chats: list, where: str) -> pa.RecordBatch:
    rows = format_chats(chats, where)
    ends = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32))
    ids = pa.array(np.fromiter(chain.from_iterable(r[1] for r in rows), np.int32))
    masks = pa.array(np.concatenate([r[2] for r in rows]))
    spans = np.array([x for r in rows for x in r[3]], np.int32).reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["begin", "end"])
    cuts = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32))
    cols = [pa.array(keys, pa.string()), pa.array([r[0] for r in rows]), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, masks), pa.ListArray.from_arrays(cuts, pairs)]
    return pa.RecordBatch.from_arrays(cols, names=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"])


def _conversations(batches, folder: str | None, most: int = 500_000):
    """Formats conversations from rows sorted by conversation and turn, some `most` characters at a time."""
    where, keys, chats, n = tokenizer_path(VOCABULARY, folder), [], [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not keys or conv != keys[-1]:
                if n > most:
                    yield _formatted(keys, chats, where)
                    keys, chats, n = [], [], 0
                keys.append(conv)
                chats.append([])
            chats[-1].append((role, text))
            n += len(text)
    if keys:
        yield _formatted(keys, chats, where)


def format_conversations(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per conv_id: formatted text, ids, token loss mask and the character spans under it.

    Rows are conv_id, turn, role, text; turns go in order (null first), ties by role, then text.
    Null roles and texts are empty; a null conv_id is a conversation of its own. No rows give no
    rows; further columns are not read. A conversation is one training example, so it is held by
    one task; what else that task formats is streamed.
    """
    own = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(lambda batches: _conversations(batches, folder), FORMATTED).withColumn("conv_id", F.col("conv_id").cast("long"))


def read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Counts and digests from what was formatted, nothing else."""
    out = []
    for text, under in zip(formatted, spans, strict=True):
        turns, digest = parse(text), hashlib.sha256()
        for role, body in turns:
            digest.update(f"{role}\n{body}\n".encode())
        loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in under)
        out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    digest = F.pandas_udf(read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    return (
        format_conversations(rows.unionByName(extra))
        .select("conv_id", digest("formatted", "loss_spans").alias("x"), F.char_length("formatted").cast("long").alias("formatted_chars"))
        .select("conv_id", "x.*", "formatted_chars")
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
           '&(amp|lt|lsqb);', '&amp;\1;', 'g'), '<(\|[a-z_]+\|>)', '&lt;\1', 'g'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lsqb;\1', 'g') AS escaped
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
