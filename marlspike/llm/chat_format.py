"""Chat formatting by token-level assembly.

Each turn's text is escaped, encoded by itself, and put between reserved ids, so text can never become a control id. The
loss mask is a prefix sum over +1 and -1 marks at the assistant texts' ends. In the text form the template's control
strings are plain text; where one occurs in content, a U+2060 goes after its first character, and where content already
holds that character there, one more: so removing one U+2060 from every such place gives the content back exactly.

Turns are formatted row by row. The digest query streams each conversation's rows, sorted, through one task without
gathering them: memory stays that of one batch however long a conversation is.

Null texts are empty, null roles the empty role. Rows of the same conv_id and turn are ordered by
role, then text. Empty tables give an empty result. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

JOINER = "⁠"
#: Control strings of the text form: fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|end|>")
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}{JOINER}*{re.escape(c[1:])}" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}{JOINER}+{re.escape(c[1:])}" for c in CONTROL))
#: Text before and after a turn's content, by role; any other role is named in its turn.
TEMPLATE = {"system": ("<s><<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("", "</s>")}
#: Reserved ids follow the vocabulary's: the n-th control string is ``reserved + n``.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + JOINER + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def wrap(role: str) -> tuple[list[str], list[str], str | None]:
    """Control strings before and after the content, and the role's name if it has to be spelled between them."""
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
        cut = lambda s: re.findall("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))), s)
        return cut(before), cut(after), None
    return ["<|role|>"], ["<|end|>"], role


class Assembler:
    """Encodes turns with a byte-level vocabulary; decoding the segments between reserved ids is lossless."""

    def __init__(self, ranks: bytes, reserved: int = 50_257):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.id_of = {c: reserved + n for n, c in enumerate(CONTROL)}
        self.of_id = {v: k for k, v in self.id_of.items()}
        self.reserved = reserved

    def turn(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """Ids and loss mask of one turn: each segment encoded separately, the mask a prefix sum of marks at its ends."""
        before, after, name = wrap(role)
        head = [self.id_of[c] for c in before]
        if name is not None:
            head += [*self.bpe.encode_ordinary(escape(name)), self.id_of["<|role|>"]]
        body = self.bpe.encode_ordinary(escape(text))
        ids = head + body + [self.id_of[c] for c in after]
        marks = np.zeros(len(ids) + 1, np.int64)
        if role == "assistant":
            marks[len(head)] += 1
            marks[len(head) + len(body)] -= 1
        return ids, np.cumsum(marks)[:-1].tolist()

    def spell(self, ids: list[int]) -> str:
        """The text form: control strings and escaped content."""
        out, run = [], []
        for i in [*ids, self.reserved]:
            if i >= self.reserved:
                out += [self.bpe.decode(run), self.of_id[i]]
                run = []
            else:
                run.append(i)
        return "".join(out[:-1])

    def read(self, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
        """Role, content and content under the loss mask of a formatted turn, unescaped."""
        at = np.array(ids)
        ctl = [self.of_id[i] for i in at[at >= self.reserved].tolist()]
        loss = unescape(self.bpe.decode(at[np.array(mask, bool)].tolist())) if ids else ""
        if ctl[0] == "<|role|>":
            a, b = np.flatnonzero(at == self.id_of["<|role|>"])[:2]
            return unescape(self.bpe.decode(at[a + 1 : b].tolist())), unescape(self.bpe.decode(at[b + 1 : -1].tolist())), loss
        role = next(r for r, (x, y) in TEMPLATE.items() if "".join(ctl) == x + y)
        return role, unescape(self.bpe.decode(at[at < self.reserved].tolist())), loss


def format_turns(turns: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, turn, role, input_ids, loss_mask and formatted text of every row; needs no shuffle."""
    with open(ranks_path, "rb") as f:
        blob = turns.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        a = Assembler(blob.value)
        for b in batches:
            out = {k: [] for k in ("conv_id", "turn", "role", "input_ids", "loss_mask", "formatted")}
            for conv, turn, role, text in zip(*(b[k].to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                ids, mask = a.turn(role or "", text or "")
                for k, v in zip(out, (conv, turn, role, ids, mask, a.spell(ids)), strict=True):
                    out[k].append(v)
            yield out

    return by_batch(turns.select("conv_id", "turn", "role", "text"), "conv_id long, turn long, role string, input_ids array<int>, loss_mask array<int>, formatted string", work)


def digest(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """Per conversation what the formatted turns say when read back, from rows streamed in order."""
    with open(ranks_path, "rb") as f:
        blob = formatted.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        a = Assembler(blob.value)
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        now, n, turns, loss, chars, size = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for b in batches:
            out = {k: [] for k in names}
            for conv, ids, mask, shown in zip(*(b[k].to_pylist() for k in ("conv_id", "input_ids", "loss_mask", "formatted")), strict=True):
                if n and conv != now:
                    for k, v in zip(names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True):
                        out[k].append(v)
                    n, turns, loss, chars, size = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                now = conv
                role, text, under = a.read(ids, mask)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
                n, chars, size = n + 1, chars + len(under), size + len(shown)
            yield out
        if n:
            yield {k: [v] for k, v in zip(names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True)}

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "input_ids", "loss_mask", "formatted")
    return by_batch(ordered, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", work)


def op5(turns: DataFrame, ranks_path: str) -> DataFrame:
    spark = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    return digest(format_turns(rows, ranks_path), ranks_path)
