"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm.common import slices, table
from lodestone.llm.tokens import word_ids

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
    ]
)


class Pool:
    """Examples that wait for a sequence. Each has a demand (tokens, one segment, loss-bearing tokens)."""

    def __init__(self, tokens: int, segments: int, loss: int, min_piece: int):
        self.limits = (tokens, segments, loss)
        self.min_piece = min_piece
        #: (doc, ids, start, doc_tokens, first id that bears loss); where ids that do and don't alternate, the last is an array
        #: of how many of the document's ids before each place bear loss
        self.items: list[tuple] = []
        self.held = 0

    def add(self, item: tuple) -> None:
        self.items.append(item)
        self.held += len(item[1])

    @staticmethod
    def cut_at(item: tuple, tokens: int, loss: int) -> int:
        """Most ids of the item's beginning within both limits: what bears no loss is free, and so is a piece's first id."""
        _, ids, start, _, first = item
        if isinstance(first, int):
            return min(tokens, len(ids), max(first, start + 1) - start + loss)
        return min(tokens, len(ids), int(np.searchsorted(first, first[start + 1] + loss, "right")) - 1 - start)

    def bins(self, until: int) -> Iterator[list[tuple]]:
        """Fill sequences until at most ``until`` tokens wait.

        The next example is the one that fits with the largest dot product of its demand with what is left of the
        sequence, both as shares of the limits. When none fits whole, the longest is cut to the free tokens.
        """
        cap_t, cap_s, cap_l = self.limits
        size = np.array([len(x[1]) for x in self.items], dtype=np.int64)
        loss = np.array([loss_of(x) for x in self.items], dtype=np.int64)
        while self.held > until and self.held:
            left_t, left_s, left_l = cap_t, cap_s, cap_l
            chosen: list[tuple] = []
            while left_t and left_s and self.held:
                fits = (size > 0) & (size <= left_t) & (loss <= left_l)
                if fits.any():
                    dot = size * (left_t / cap_t**2) + left_s / cap_s**2 + loss * (left_l / cap_l**2)
                    k = int(np.where(fits, dot, -1.0).argmax())
                    taken, rest = self.items[k], None
                else:
                    k = int(size.argmax())
                    taken, rest = cut(self.items[k], self.cut_at(self.items[k], left_t, left_l))
                    # An empty sequence takes any piece, so that each makes progress whatever the limits.
                    if len(taken[1]) < (min(self.min_piece, left_t) if chosen else 1):
                        break
                self.items[k] = rest
                size[k], loss[k] = (len(rest[1]), loss_of(rest)) if rest else (0, 0)
                chosen.append(taken)
                self.held -= len(taken[1])
                left_t, left_s, left_l = left_t - len(taken[1]), left_s - 1, left_l - loss_of(taken)
            yield chosen
        self.items = [x for x in self.items if x is not None]


def loss_of(item: tuple) -> int:
    """Ids of a piece that bear loss: those of the answer, but for the first id of a piece, which nothing predicts."""
    _, ids, start, _, first = item
    end = start + len(ids)
    return max(0, end - max(first, start + 1)) if isinstance(first, int) else max(0, int(first[end] - first[min(start + 1, end)]))


def cut(item: tuple, at: int) -> tuple[tuple, tuple]:
    doc, ids, start, total, first = item
    return (doc, ids[:at], start, total, first), (doc, ids[at:], start + at, total, first)


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cut an unfilled sequence into sequences whose lengths are powers of two, the longest first."""
    queue, left = list(pieces), sum(len(p[1]) for p in pieces)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            piece = queue.pop(0)
            if len(piece[1]) > want:
                piece, rest = cut(piece, want)
                queue.insert(0, rest)
            out.append(piece)
            want -= len(piece[1])
        yield out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss_tokens: int = 4096,
    min_piece: int = 16,
    pool_tokens: int = 1 << 20,
) -> DataFrame:
    """Pack every text into sequences under limits on tokens, segments and loss-bearing tokens.

    Each task packs the rows of its own partition: no shuffle, and memory bounded by ``pool_tokens``. A document longer
    than a sequence fills whole sequences first. What a task has left at its end, and a sequence that reaches a limit
    other than tokens, is cut into power-of-two lengths, which need no padding.

    A null text counts as empty and an empty one has the end id alone. With ``prompt_col`` its ids come before the
    text's and bear no loss (instruction data). Repeated rows are packed as often as they occur; an empty table gives
    no rows; columns besides those named are not read.
    """
    if min(max_tokens, max_segments, max_loss_tokens, pool_tokens) < 1:
        raise ValueError("limits must be positive")

    def items(batches):
        words = word_ids(tokenizer_path)
        for part in slices(batches, text_col):
            prompts = part[prompt_col] if prompt_col else [None] * len(part[id_col])
            for doc, prompt, text in zip(part[id_col], prompts, part[text_col], strict=True):
                before = words.ids(prompt) if prompt else np.empty(0, "<u4")
                ids = np.concatenate([before, words.ids(text or ""), np.array([end_id], "<u4")])
                yield doc, ids, 0, len(ids), len(before)

    columns = [c for c in (id_col, prompt_col, text_col) if c]
    limits = (max_tokens, max_segments, max_loss_tokens, min_piece, pool_tokens)
    return packed(docs.select(*dict.fromkeys(columns)), items, docs.schema[id_col].dataType, *limits).withColumnRenamed("doc_id", id_col)


def packed(rows: DataFrame, items: Callable, id_type: T.DataType, max_tokens: int, max_segments: int, max_loss_tokens: int, min_piece: int, pool_tokens: int) -> DataFrame:
    """Pack what ``items`` makes of each task's batches, in the order in which it comes."""
    schema = T.StructType([T.StructField("doc_id", id_type), *SCHEMA.fields[1:]])

    def run(batches):
        arrow = to_arrow_schema(schema)
        pool = Pool(max_tokens, max_segments, max_loss_tokens, min_piece)
        sequence = (TaskContext.get().partitionId() << 36) - 1
        rows: list[tuple] = []

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            whole = sum(len(p[1]) for p in pieces) == max_tokens
            for seq in [pieces] if whole else powers(pieces):
                sequence += 1
                offset = 0
                for p in seq:
                    doc, ids, start, total, _ = p
                    crc = zlib.crc32(ids.tobytes())
                    rows.append((doc, start, len(ids), crc, total, sequence, offset, loss_of(p)))
                    offset += len(ids)

        def flush(least: int):
            if len(rows) > least:
                out = pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
                )
                rows.clear()
                yield out

        for item in items(batches):
            while len(item[1]) >= max_tokens:
                piece, rest = cut(item, max_tokens)
                if loss_of(piece) > max_loss_tokens:
                    break
                place([piece])
                item = rest
            if len(item[1]):
                pool.add(item)
            if pool.held > pool_tokens or len(pool.items) > 8192:
                for pieces in pool.bins(pool.held // 2):
                    place(pieces)
                yield from flush(20_000)
        for pieces in pool.bins(0):
            place(pieces)
        yield from flush(0)

    return rows.mapInArrow(run, schema)


def pack_conversations(
    conversations: DataFrame, tokenizer_path: str, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", answers: str = "assistant",
    end_id: int = 2, max_tokens: int = 4096, max_segments: int = 64, max_loss_tokens: int = 1536, min_piece: int = 16, pool_tokens: int = 1 << 20, part_tokens: int = 1 << 16,
) -> DataFrame:
    """Pack whole conversations: each turn's ids and an end id once, in order; those of answering turns bear loss.

    So an answer has all earlier turns of its conversation before it as far as a sequence goes. Turns go by number, then role
    and text, null numbers first; gaps and repeated turns are no matter, conversations of one turn and those without an answer
    are packed too. A null role answers nothing, a null text has its end id alone, and turns without a conversation's id are
    one conversation. After ``part_tokens`` ids a conversation goes on as another example, so that a task holds a bounded part
    of it; ``example_id`` is the conversation's id and the number of the part, counted from 0 (``none`` for a null id).
    """
    if min(max_tokens, max_segments, max_loss_tokens, pool_tokens, part_tokens) < 1:
        raise ValueError("limits must be positive")
    rows = conversations.select(F.coalesce(F.col(conv).cast("string"), F.lit("none")).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def items(batches):
        words, end = word_ids(tokenizer_path), np.array([end_id], "<u4")
        of, part, ids, bears, size = None, 0, [], [], 0

        def whole():
            all_ids = np.concatenate(ids)
            return f"{of}/{part}", all_ids, 0, len(all_ids), np.r_[0, np.cumsum(np.concatenate(bears))]

        for columns in slices(batches, "text"):
            for c, r, t in zip(columns["conv"], columns["role"], columns["text"], strict=True):
                if ids and (c != of or size >= part_tokens):
                    yield whole()
                    ids, bears, size, part = [], [], 0, part + 1 if c == of else 0
                of = c
                ids.append(np.concatenate([words.ids(t or ""), end]))
                bears.append(np.full(len(ids[-1]), r == answers))
                size += len(ids[-1])
        if ids:
            yield whole()

    limits = (max_tokens, max_segments, max_loss_tokens, min_piece, pool_tokens)
    return packed(ordered, items, T.StringType(), *limits).withColumnRenamed("doc_id", "example_id")


def fill_report(packed: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """Tokens, padding and sequences of a packing, in one row."""
    n = F.col("n")
    power = n.bitwiseAND(n - 1) == 0
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n"))
        .agg(
            F.count("*").alias("sequences"),
            F.sum("n").alias("tokens"),
            F.sum(F.when(power, 0).otherwise(max_tokens - n)).alias("padding"),
        )
    )


#: Segments of a sequence of documents at most; the limit on loss-bearing tokens is for prompts, which bear none.
SEGMENTS = 16


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_segments=SEGMENTS)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the table of conversations: what isn't an answer bears no loss, so sequences reach the limit on loss-bearing tokens or on segments."""
    import public_tokenizers

    return pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_packing": op1_packing, "packing_of_instructions": instruction_packing}
ORACLE: dict[str, str] = {}
