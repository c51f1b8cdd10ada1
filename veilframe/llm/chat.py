"""Chat formatting at token level.

Every turn's role and text are encoded by themselves; reserved ids that no text can encode to are spliced
around them: TURN role SEP text END. The loss mask follows from the prefix sums of the segments' lengths: an
assistant's text and its END bear loss. The written form shows the reserved ids as control strings, so
control strings within a text are escaped: each gets an escape character after its first character, and
an escape character of the text's own is doubled. Control strings begin with < or [ and hold neither inside, so
they cannot overlap, and unescaping is exact.

Defined results: turns are ordered by turn, role and text, nulls first; null texts and roles are empty; a null
conv_id is a conversation of its own; repeated rows are turns of their own. Further columns are ignored. A conversation is one
row of the result and is assembled in one task; encoding, the costly part, is dealt out by turn, and only ids are
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

# The template's control strings with their reserved ids, past the vocabulary's 50,257.
RESERVED = {"<|turn|>": 50257, "<|sep|>": 50258, "<|end|>": 50259}
TURN, SEP, END = RESERVED.values()
# Control strings of other common templates, escaped as well.
FOREIGN = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]")
ESCAPE = "␛"
ASSISTANT = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, [*RESERVED, *FOREIGN])))
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return text if ESCAPE not in text else _ESCAPED.sub(lambda m: m[1], text)


def _encoder():
    return encoder(reserved=tuple(RESERVED.items()))


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, turn, role, role_ids, text_ids) of the escaped strings; ids are packed, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder()
        packed = lambda text: np.array(encode(escape(text or "")), "<u2").tobytes()
        roles: dict[str | None, bytes] = {}
        for batch in batches:
            role_ids = []
            for role in batch.column(2).to_pylist():
                if role not in roles:
                    if len(roles) > 1000:
                        roles.clear()
                    roles[role] = packed(role)
                role_ids.append(roles[role])
            text_ids = pa.array((packed(x.as_py()) for x in batch.column(3)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(role_ids, pa.binary()), text_ids], [*batch.schema.names[:3], "role_ids", "text_ids"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, role_ids binary, text_ids binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column one after the other, and how many each of its values has."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    whole = column.buffers()[2]
    if whole is None or not len(column):
        return np.zeros(0, np.uint16), sizes
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(whole, np.uint8)[first : first + 2 * int(sizes.sum())].view("<u2"), sizes


def _scatter(out: np.ndarray, starts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
    """Copy each value's ids to where it starts."""
    before = np.cumsum(sizes) - sizes
    out[np.repeat(starts - before, sizes) + np.arange(len(ids))] = ids


def assemble(loss: np.ndarray, role_ids: np.ndarray, role_sizes: np.ndarray, text_ids: np.ndarray, text_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns -> their ids spliced, the mask, and how many ids each turn has. Starts and mask are prefix sums of segment lengths."""
    sizes = role_sizes + text_sizes + 3
    starts = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int32)
    ids[starts], ids[starts + 1 + role_sizes], ids[starts + sizes - 1] = TURN, SEP, END
    _scatter(ids, starts + 1, role_ids, role_sizes)
    _scatter(ids, starts + 2 + role_sizes, text_ids, text_sizes)
    # +1 where a turn that bears loss has its text, -1 after its END; the running sum is the mask.
    change = np.zeros(len(ids) + 1, np.int8)
    change[(starts + 2 + role_sizes)[loss]] += 1
    change[(starts + sizes)[loss]] -= 1
    return ids, change.cumsum(dtype=np.int8)[:-1], sizes


def _settled(turns: pa.StructArray) -> list[int] | None:
    """The order of a conversation's turns, if some of one place and role have to go by their texts."""
    keys = list(zip(turns.field("turn").to_pylist(), turns.field("role").to_pylist()))
    uses = Counter(keys)
    if len(uses) == len(keys):
        return None
    rank = {key: k for k, key in enumerate(uses)}
    decode = lambda ids: unescape(_encoder().text(np.frombuffer(ids, "<u2").tolist()))
    texts = [decode(ids.as_py()) if uses[key] > 1 else "" for key, ids in zip(keys, turns.field("text_ids"))]
    return sorted(range(len(keys)), key=lambda k: (rank[keys[k]], texts[k]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, input_ids array<int>, loss_mask array<tinyint>), a row per conversation."""
    # Of one turn and role, texts go by themselves: ids stand in for them until they are read back, where that matters.
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "text_ids", "role_ids")
    whole = encode_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, counts = batch.column(1).flatten(), pa.compute.list_value_length(batch.column(1)).to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            parts = [turns.slice(a, n) for a, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist())]
            orders = [_settled(part) for part in parts]
            if any(order is not None for order in orders):
                turns = pa.concat_arrays([part if order is None else part.take(pa.array(order)) for part, order in zip(parts, orders)])
            loss = pa.compute.equal(turns.field("role"), ASSISTANT).to_numpy(zero_copy_only=False).astype(bool)
            ids, mask, sizes = assemble(loss, *_numbers(turns.field("role_ids")), *_numbers(turns.field("text_ids")))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, sizes, len(counts)).astype(np.int64))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, mask)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *lists], ["conv_id", "n_turns", "input_ids", "loss_mask"])

    return whole.mapInArrow(run, "conv_id long, n_turns long, input_ids array<int>, loss_mask array<tinyint>")


def written(ids) -> str:
    """The formatted text of assembled ids: control strings for reserved ids, escaped text between them."""
    return _encoder().text(np.asarray(ids).tolist())


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    turn, sep, end = RESERVED
    split = (part[len(turn) :].split(sep) for part in formatted.split(end)[:-1])
    return [(unescape(role), unescape(text)) for role, text in split]


def masked_text(ids, mask) -> str:
    """The unescaped text of the ids under the loss mask."""
    return "".join(map(unescape, written(np.asarray(ids)[np.asarray(mask) == 1]).split("<|end|>")))
