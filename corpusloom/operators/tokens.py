"""Token ids of texts and chats: counts, training rows, loss labels and packed blocks. Vocabularies are plugged in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blocks import pack_blocks

#: The label of tokens without loss, and the segment number of padding.
NO_LOSS, NO_SEGMENT = -100, -1


@dataclass(frozen=True)
class Vocabulary:
    """Where ids come from: a file of a fast tokenizer, or without one the bytes of the text."""

    path: str | None = None
    bos: int = 256
    eos: int = 257
    pad: int = 258


BYTES = Vocabulary()


@lru_cache(maxsize=8)
def _from_file(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_ids(texts: pa.Array) -> pa.ListArray:
    flat = pa.array(texts, pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    bounds = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = flat.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].astype(np.int32) if data else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(ids))


def encode(texts: list[str], vocabulary: Vocabulary = BYTES) -> pa.ListArray:
    """The ids of each text, without special tokens."""
    if vocabulary.path is None:
        return _byte_ids(pa.array([t.encode() for t in texts], pa.large_binary()))
    return pa.array([e.ids for e in _from_file(vocabulary.path).encode_batch_fast(texts, add_special_tokens=False)], pa.list_(pa.int32()))


def token_ids(text: Column, vocabulary: Vocabulary = BYTES) -> Column:
    """The ids of a text as an array; a null text has none. A vocabulary is loaded once in each worker."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield encode(batch.to_pylist(), vocabulary)

    return ids(F.coalesce(text, F.lit("")))


def token_count(text: Column, vocabulary: Vocabulary = BYTES) -> Column:
    """Tokens of a text with its begin and end marks."""
    return F.size(token_ids(text, vocabulary)) + 2


def text_rows(rows: DataFrame, text: str, most: int, vocabulary: Vocabulary = BYTES) -> DataFrame:
    """Adds input_ids (begin mark, at most most - 2 ids, end mark) and length, for training on plain text."""
    body = F.slice("__ids", 1, most - 2)
    out = rows.withColumn("__ids", token_ids(F.col(text), vocabulary)).withColumn("input_ids", F.concat(F.array(F.lit(vocabulary.bos)), body, F.array(F.lit(vocabulary.eos))))
    return out.drop("__ids").withColumn("length", F.size("input_ids"))


@dataclass(frozen=True)
class Template:
    """A chat template as data: what stands before and after a message, {role} for its role, and what asks for an answer."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    answer: str = "<|im_start|>assistant\n"
    first: str = ""


CHATML = Template()


def render(messages: Column, template: Template = CHATML, ask: bool = False) -> Column:
    """The text of a chat under a template; with `ask`, the opening of the next answer after it."""
    pieces = template.before.split("{role}")

    def one(m: Column) -> Column:
        head = [F.lit(pieces[0])]
        for piece in pieces[1:]:
            head += [m["role"], F.lit(piece)]
        return F.concat(*head, F.coalesce(m["content"], F.lit("")), F.lit(template.after))

    return F.concat(F.lit(template.first), F.array_join(F.transform(messages, one), ""), F.lit(template.answer if ask else ""))


def _found(ids: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Where a run of ids begins, ascending."""
    if len(ids) < len(pattern) or not len(pattern):
        return np.zeros(0, np.int64)
    return np.flatnonzero((np.lib.stride_tricks.sliding_window_view(ids, len(pattern)) == pattern).all(axis=1))


def answer_spans(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) of every answer with its end mark: from a begin mark on, up to the next end mark or the end."""
    starts, ends, spans, at = _found(ids, begin), _found(ids, end), [], 0
    while (k := np.searchsorted(starts, at)) < len(starts):
        first = int(starts[k]) + len(begin)
        j = np.searchsorted(ends, first)
        at = int(ends[j]) + len(end) if j < len(ends) else len(ids)
        spans.append((first, at))
    return spans


def answer_labels(ids: Column, begin: list[int], end: list[int]) -> Column:
    """The ids under the answers, end marks included, and NO_LOSS elsewhere."""
    one, two = np.array(begin, np.int32), np.array(end, np.int32)

    @F.arrow_udf("array<int>")
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, bounds = batch.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.value_lengths().fill_null(0).to_numpy())])
            out = np.full(len(flat), NO_LOSS, np.int32)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for first, past in answer_spans(flat[a:b], one, two):
                    out[a + first : a + past] = flat[a + first : a + past]
            yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))

    return labels(ids)


def chat_rows(rows: DataFrame, messages: str, most: int, vocabulary: Vocabulary = BYTES, template: Template = CHATML) -> DataFrame:
    """Adds input_ids, labels and length of each chat; chats of more than `most` tokens are left out whole."""
    begin, end = (encode([mark], vocabulary)[0].as_py() for mark in (template.before.replace("{role}", "assistant"), template.after))
    own = rows.withColumn("input_ids", token_ids(render(F.col(messages), template), vocabulary)).withColumn("length", F.size("input_ids"))
    return own.where(F.col("length") <= most).withColumn("labels", answer_labels(F.col("input_ids"), begin, end))


def pack_rows(rows: DataFrame, key: str, order: str, capacity: int, pad: int = BYTES.pad, group_rows: int = 2048) -> DataFrame:
    """Blocks of `capacity` ids from whole examples (key, input_ids, labels): the places come from lengths
    alone, and ids are joined back to them.

    Of every example but a block's first the first label is NO_LOSS, so that no token is predicted from
    another example; padding is a segment of its own. Empty and longer examples are left out.
    """
    sized = rows.withColumn("length", F.size("input_ids"))
    places = pack_blocks(sized.select(key, "length", *{order} - {key}), key, "length", order, capacity, group_rows)
    joined = places.join(rows.select(key, "input_ids", "labels"), key)
    cut = F.when(F.col("segment") > 0, F.concat(F.array(F.lit(NO_LOSS)), F.slice("labels", 2, F.size("labels")))).otherwise(F.col("labels"))
    part = F.struct("segment", "input_ids", cut.alias("labels"))
    blocks = joined.groupBy("pack_group", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a block holds `capacity` ids
    of = lambda name: F.flatten(F.transform("parts", lambda p: p[name]))
    numbers = F.flatten(F.transform("parts", lambda p: F.array_repeat(p["segment"], F.size(p["input_ids"]))))
    filled = blocks.select("pack_group", "block", of("input_ids").alias("i"), of("labels").alias("l"), numbers.alias("s")).withColumn("left", F.lit(capacity) - F.size("i"))
    fill = lambda column, value: F.concat(column, F.array_repeat(F.lit(value), F.col("left")))
    return filled.select(
        "pack_group", "block", fill("i", pad).alias("input_ids"), fill("l", NO_LOSS).alias("labels"), fill("s", NO_SEGMENT).alias("segment_ids"),
        F.size("i").alias("valid_tokens"), F.size(F.filter("l", lambda x: x != NO_LOSS)).alias("train_tokens"),
    )
