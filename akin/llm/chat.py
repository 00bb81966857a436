"""Chat formatting from event logs: fold a conversation's events into final messages, then render them.

A log row is an event of one message: conv_id, turn (place of the message), copy (tells apart messages that claim one
place), seq, kind, role, text. Events may arrive in any order; they are folded by ``seq``:

    open        the message exists; ``role`` names its speaker (any event may name it, the last one counts)
    delta       ``text`` is appended
    edit        ``text`` replaces what is there
    regenerate  what is there is thrown away, the deltas of the new answer follow
    retract     the message is taken back; a later open, delta or edit brings it into being again, empty

The log is partitioned by ranges of conversation and message and sorted by sequence, so a task folds a stream of whole
messages and holds one at a time; a conversation that holds a large part of the log spreads over many tasks.

Template. A message is ``### role:``, a line break, its text, a line break, ``</turn>`` and a line break. In text a
backslash is put before every ``###`` and ``</turn>``, which is undone by taking off the backslash directly before
each. So a mark without a backslash is always the template's own. In a role backslash and line break are written as
``\\\\`` and ``\\n``. The loss mask is the span of an assistant's text in what is rendered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.llm.tables import dropped, written

TRAINED_ROLE = "assistant"
HEAD, TAIL = "### ", "\n</turn>\n"
CONTROLS = ("###", "</turn>")
# Code points of a delta made from a finished text, and of a conversation that a task holds for a second look.
DELTA, HELD = 1024, 1 << 20
PLACE = ["conv_id", "turn", "copy"]
LOG = [*PLACE, "seq", "kind", "role", "text"]
MESSAGES = "conv_id long, turn long, copy string, role string, rendered string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TYPES = {"long": pa.int64(), "string": pa.string()}
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


@dataclass
class Message:
    """A message as far as its events are folded."""

    place: tuple
    role: str = ""
    parts: list[str] | None = None
    last: tuple | None = None

    def fold(self, seq: int | None, kind: str | None, role: str | None, text: str | None) -> None:
        event = (seq, kind, role, text)
        if event == self.last:  # delivered twice
            return
        self.last = event
        self.role = self.role if role is None else role
        if kind == "retract":
            self.parts = None
        elif kind in ("edit", "regenerate"):
            self.parts = [text or ""] if kind == "edit" else []
        elif kind in ("open", "delta"):
            self.parts = [] if self.parts is None else self.parts
            if kind == "delta" and text:
                self.parts.append(text)


def escaped(text: str) -> str:
    for control in CONTROLS:
        text = text.replace(control, "\\" + control)
    return text


def unescaped(text: str) -> str:
    for control in CONTROLS:
        text = text.replace("\\" + control, control)
    return text


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """The message in the template, and where its text starts and ends there."""
    head = HEAD + role.replace("\\", "\\\\").replace("\n", "\\n") + ":\n"
    body = escaped(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a formatted text, told by the template's marks alone."""
    found, at = [], 0
    while at < len(formatted):
        line = formatted.index(":\n", at + len(HEAD))
        end = formatted.find("\n", at)
        if not formatted.startswith(HEAD, at) or line + 1 != end:
            raise ValueError("no message starts here")
        role = "\\".join(part.replace("\\n", "\n") for part in formatted[at + len(HEAD) : line].split("\\\\"))
        stop = formatted.index(TAIL, end + 1)
        found.append((role, unescaped(formatted[end + 1 : stop])))
        at = stop + len(TAIL)
    return found


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, str]]:
    """Place, role and text of the messages that a sorted log leaves."""
    now: Message | None = None
    for batch in batches:
        for *place, seq, kind, role, text in zip(*(batch.column(c).to_pylist() for c in LOG), strict=True):
            if now is None or now.place != tuple(place):
                if now is not None and now.parts is not None:
                    yield now.place, now.role, "".join(now.parts)
                now = Message(tuple(place))
            now.fold(seq, kind, role, text)
    if now is not None and now.parts is not None:
        yield now.place, now.role, "".join(now.parts)


def by_message(log: DataFrame) -> DataFrame:
    """The log in ranges of whole messages, each in the order of its events; equal ``seq`` go by kind, role and text."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return log.select(*LOG).repartitionByRange(parts, *PLACE).sortWithinPartitions(*LOG)


def arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def in_batches(rows: Iterator[dict], ddl: str) -> Iterator[pa.RecordBatch]:
    """The rows as record batches of bounded size; fields that a row lacks are null."""
    schema, held, size = arrow(ddl), [], 0
    for row in rows:
        held.append(row)
        size += 1000 + len(row.get("rendered", ""))
        if size > HELD:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def message_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for place, role, text in messages(batches):
        whole, start, end = rendered(role, text)
        row = dict(zip(PLACE, place, strict=True)) | {"role": role, "rendered": whole}
        yield row | ({"loss_start": start, "loss_end": end} if role == TRAINED_ROLE else {})


def formatted(log: DataFrame) -> DataFrame:
    """One row per final message: conv_id, turn, copy, role, rendered, loss_start, loss_end.

    The rendered texts of a conversation in the order of turn and copy are its formatted text. The loss span is given in
    code points of ``rendered``, null for messages of other roles. Null text is empty, a message without a role has an empty
    one, null places sort first and are places like others. An event that repeats exactly counts once; unknown
    and null kinds change nothing but the role. An empty log gives no rows; other columns are ignored. A message of any
    length is folded in one task, which holds its text.
    """
    return by_message(log).mapInArrow(lambda batches: in_batches(message_rows(batches), MESSAGES), MESSAGES)


class Digest:
    """What is read back from the rendered messages of a conversation, one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, row: dict) -> None:
        piece, start = row["rendered"], row.get("loss_start")
        self.chars += len(piece)
        for role, text in read_back(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            trained = unescaped(piece[start : row["loss_end"]])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> dict:
        hashes = {"turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest()}
        counts = {"n_turns": self.n_turns, "loss_chars": self.loss_chars, "formatted_chars": self.chars}
        return {"conv_id": self.conv_id} | counts | hashes


def first_pass(rows: Iterator[dict]) -> Iterator[dict]:
    """Digests of the conversations that surely lie whole in this task; the rendered messages of all others.

    A range may cut its first and its last conversation. Those, and any that outgrow HELD, go on as messages.
    """
    held: list[dict] = []
    size, first, digest = 0, True, None
    for row in rows:
        if digest is None or digest.conv_id != row["conv_id"]:
            if digest is not None and not first and size <= HELD:
                for message in held:
                    digest.read(message)
                held = [digest.row()]
            yield from held
            first, digest = digest is None, Digest(row["conv_id"])
            held, size = [], 0
        held.append(row)
        size += len(row["rendered"])
        if size > HELD:
            yield from held
            held = []
    yield from held


def second_pass(rows: Iterator[dict]) -> Iterator[dict]:
    """Digests of conversations whose rendered messages come in order, one message at a time."""
    digest: Digest | None = None
    for row in rows:
        if digest is None or digest.conv_id != row["conv_id"]:
            if digest is not None:
                yield digest.row()
            digest = Digest(row["conv_id"])
        digest.read(row)
    if digest is not None:
        yield digest.row()


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def digested(log: DataFrame) -> DataFrame:
    """One row per conversation with a final message, read back from what is rendered; see ``digests``.

    SHA-256 needs the bytes of a conversation in order. Conversations inside a range are done where they are folded; those
    that a range cuts, at most two for each task, and very long ones are rendered there and stream through one task
    message by message for their two hashes.
    """
    both = ", ".join([MESSAGES, DIGESTS.removeprefix("conv_id long, ")])
    found = by_message(log).mapInArrow(lambda batches: in_batches(first_pass(message_rows(batches)), both), both)
    found = written(found, "chat")
    done = found.where("turns_sha256 is not null").select(*arrow(DIGESTS).names)
    rest = found.where("turns_sha256 is null").select(*PLACE, "rendered", "loss_start", "loss_end")
    rest = rest.repartition("conv_id").sortWithinPartitions(*PLACE)
    late = rest.mapInArrow(lambda batches: in_batches(second_pass(as_rows(batches)), DIGESTS), DIGESTS)
    result = written(done.unionAll(late), "chat-digests")
    dropped(found)
    return result


def log_of(rows: DataFrame) -> DataFrame:
    """The event log that finished turns (conv_id, turn, role, text) stand for: opened, then streamed in deltas."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    copy = F.concat_ws(" ", role, F.hex(F.xxhash64(text)), F.monotonically_increasing_id().cast("string"))
    deltas = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    place = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), copy.alias("copy")]
    # The number of the row is given before the deltas part it.
    named = rows.select(*place, role.alias("role"), F.concat(F.array(F.lit("")), deltas).alias("deltas"))
    turns = named.select(*PLACE, "role", F.posexplode("deltas").alias("seq", "text"))

    opens = F.col("seq") == 0
    return turns.select(
        *PLACE,
        F.col("seq").cast("long").alias("seq"),
        F.when(opens, "open").otherwise("delta").alias("kind"),
        F.when(opens, F.col("role")).alias("role"),
        F.when(~opens, F.col("text")).alias("text"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations and a probe.

    The probe, conversation PROBE_ID, holds the template's marks in its texts. Rows are turns in the order of ``turn``; equal
    turns go by role, then by a hash of the text, and repeated rows are turns of their own. Null role and
    text are empty; null conversation and turn are values like others, first in order. An empty table gives the
    probe alone; other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = [(PROBE_ID, turn, role, PROBE_TEXT) for turn, role in enumerate(("user", TRAINED_ROLE))]
    probe = rows.sparkSession.createDataFrame(probe, "conv_id long, turn long, role string, text string")
    return digested(log_of(rows.unionAll(probe)))
