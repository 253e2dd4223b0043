"""Chat logs to training text.

A conversation is a log of events (``conv_id, seq, kind, msg, role, text``):
``message`` and ``delta`` add text to message ``msg``, ``edit`` replaces its text,
``regenerate`` drops it and everything after it. The fold is written as window
functions over each conversation's log in order of ``seq``; rendering then
streams over the surviving fragments, one message in memory at a time.

Rendered, a turn is ``<s>role\\ntext</s>\\n``. A backslash stands before every
backslash of a text and before every control string in it (in a role, before a
line break too), so the output can be read back exactly.

Defined cases: NULL text or role is empty; a message has the first role that any of its
events since the last regeneration tells, edited ones among them; events with equal ``seq`` are taken in
order of kind, text and role; equal rows each count; a NULL ``conv_id`` is a
conversation of its own; an event with NULL ``msg`` is a message of its own that no
edit or regeneration names; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template and of other chat templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLES = ("assistant",)
BATCH_ROWS = 512
BATCH_CHARS = 1 << 20


class Template:
    """Writes turns and reads them back."""

    def __init__(self, controls: Sequence[str] = CONTROLS):
        marks = "|".join(re.escape(c) for c in sorted({*controls, "<s>", "</s>"}, key=len, reverse=True))
        self._text = re.compile(rf"\\|(?={marks})")
        self._role = re.compile(rf"\\|(?=\n|{marks})")
        # a backslash hides whatever follows, so the marks found here are the template's own
        self._turn = re.compile(r"<s>((?:[^\\\n]|\\.)*?)\n((?:[^\\]|\\.)*?)</s>\n", re.DOTALL)
        self._hidden = re.compile(r"\\(.)", re.DOTALL)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn and where the (escaped) text lies in it, in code points."""
        head = f"<s>{self._hide(self._role, role)}\n"
        body = self._hide(self._text, text)
        return f"{head}{body}</s>\n", len(head), len(head) + len(body)

    @staticmethod
    def _hide(pattern: re.Pattern, text: str) -> str:
        return pattern.sub(lambda m: "\\\\" if m[0] else "\\", text)

    def unescape(self, text: str) -> str:
        return self._hidden.sub(r"\1", text)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Role and text of every turn; raises if anything is left over."""
        turns, end = [], 0
        for m in self._turn.finditer(formatted):
            if m.start() != end:
                break
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            end = m.end()
        if end != len(formatted):
            raise ValueError("not written by this template")
        return turns


def reconstruct(events: DataFrame) -> DataFrame:
    """Fragments of the final messages: ``conv_id, msg, part, role, text`` in the order (msg, part).

    An event is dead if a later ``regenerate`` names its message or one before it,
    or a later ``edit`` its message. No state of a conversation is gathered: the
    windows run over sorted rows and spill.
    """
    rows = events.select(
        "conv_id",
        F.coalesce(F.col("seq").cast("long"), F.lit(-(2**62))).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("msg").cast("long").alias("msg"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    backwards = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("kind"), F.desc("text"), F.desc("role"))
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.coalesce("msg", F.lit(-(2**62))))).over(later)
    edits = Window.partitionBy("conv_id", "msg").orderBy(F.desc("seq"), F.desc("kind"), F.desc("text"), F.desc("role"))
    edited = F.max(F.when((F.col("kind") == "edit") & F.col("msg").isNotNull(), True)).over(edits.rowsBetween(Window.unboundedPreceding, -1))
    # the window runs backwards, so the last role in it was told first
    told = F.last(F.when(F.col("role") != "", F.col("role")), ignorenulls=True).over(edits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    role = F.when(F.col("msg").isNull(), F.col("role")).otherwise(F.coalesce(told, F.lit("")))
    return (
        rows.withColumn("cut", cut)
        .filter((F.col("kind") != "regenerate") & F.coalesce(F.col("cut") > F.col("msg"), F.lit(True)))
        .withColumns({"edited": edited, "role": role})
        .filter(F.col("edited").isNull())
        .select("conv_id", "msg", F.col("seq").alias("part"), "kind", "role", "text")
    )


def from_turns(turns: DataFrame) -> DataFrame:
    """Finished rows (``conv_id, turn, role, text``) as a log of one ``message`` event each.

    ``msg`` is NULL: every row is a message of its own, ordered by turn.
    """
    return turns.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("msg"), "role", "text"
    )


_RENDERED = "conv_id long, position long, role string, formatted string, loss_start long, loss_end long, first boolean, last boolean"


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, role, text)`` of each message from sorted fragments."""
    key = role = None
    texts: list[str] = []
    for batch in batches:
        for conv, msg, part_role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            now = (conv, msg)
            if key is not None and now == key and msg is not None:
                texts.append(text)
                role = role or part_role
                continue
            if key is not None:
                yield key[0], role, "".join(texts)
            key, role, texts = now, part_role, [text]
    if key is not None:
        yield key[0], role, "".join(texts)


def render(fragments: DataFrame, controls: Sequence[str] = CONTROLS, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """One row per message: its place, the formatted turn, and the loss span in it (NULL for other roles).

    Concatenated in order of ``position``, the rows of a conversation are its text.
    Rows come out sorted within their partition, a conversation never in two.
    """
    ordered = (
        fragments.select(F.col("conv_id").cast("long").alias("conv_id"), "msg", "role", "text", "part", "kind")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.coalesce("msg", "part"), "part", "kind", "text", "role")
        .select("conv_id", "msg", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(controls)
        rows, chars, position, before = [], 0, 0, None
        waiting = None
        for conv, role, text in _messages(batches):
            turn, a, b = template.render(role, text)
            begins = waiting is None or conv != before
            position = 0 if begins else position + 1
            if waiting is not None:
                rows.append((*waiting, begins))
            loss = (a, b) if role in loss_roles else (None, None)
            waiting, before = (conv, position, role, turn, *loss, begins), conv
            chars += len(turn)
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield from _table(rows)
                rows, chars = [], 0
        if waiting is not None:
            rows.append((*waiting, True))
        yield from _table(rows)

    return ordered.mapInArrow(run, _RENDERED)


def _table(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RENDERED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """Per conversation, what reading the rendered turns back gives. The hashes run
    along the sorted rows of ``render``, so a conversation of any length needs one turn of memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, out = Template(controls), []
        turns = loss = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for conv, _, _, formatted, a, b, first, last in zip(*columns, strict=True):
                if first:
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in template.parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                if a is not None:
                    text = template.unescape(formatted[a:b])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    chars += len(text)
                size += len(formatted)
                if last:
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))],
                    [x.split()[0] for x in _DIGEST.split(", ")],
                )
                out = []

    return rendered.mapInArrow(run, _DIGEST)


def chat_query(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of one whose texts are made of control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(render(reconstruct(from_turns(turns.unionByName(extra)))))
