"""Chat formatting in budgeted windows.

A conversation's rows are ordered by (turn, role, text). Prefix sums of the turns' tokens choose spans
aligned to turns that fit ``budget`` together with what is repeated: the system turn (a first turn of role
``system``) and the turns just before the span, as far as ``history`` tokens reach. The loss mask covers
each assistant text once, in the window where its turn is new; repeated turns are masked. A turn larger
than the budget makes a window of its own.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every ``<`` that backslashes and a
``|`` follow gets one more backslash, so no control string can appear; line breaks in roles are escaped
too. ``unescape`` undoes it exactly.

A conversation may hold a third of all rows: it is dealt in segments of ``segment`` turn numbers, each
of which carries the system turn and the last turns before it, and a segment streams through its task.

Null role or text counts as empty; rows without conv_id form one conversation; equal rows are turns each;
null turns come first. An empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.tokens import encoder, tokenizer_path

START, END = "<|im_start|>", "<|im_end|>\n"
CARRIED = 8
WINDOW = (
    "conv_id long, segment long, window int, repeated int, turns int, n_tokens long, text string, "
    "loss array<struct<start:int,end:int>>"
)
_BAR, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _BAR.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def dealt(turns: DataFrame, segment: int) -> DataFrame:
    """Rows by (conv_id, segment): kind 0 the system turn carried on, 1 earlier turns carried on, 2 own turns."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(2**40))).cast("long")
    late = F.pmod("turn", F.lit(segment)) >= segment - CARRIED
    places = F.when(late, F.array(F.struct(own.alias("segment"), F.lit(2).alias("kind")), F.struct((own + 1).alias("segment"), F.lit(1).alias("kind"))))
    rows = rows.withColumn("p", F.explode(F.coalesce(places, F.array(F.struct(own.alias("segment"), F.lit(2).alias("kind"))))))
    rows = rows.select("conv_id", "p.segment", "p.kind", "turn", "role", "text")
    places = rows.filter("kind = 2").groupBy("conv_id", "segment").agg(F.min(F.struct("turn", "role", "text")).alias("head"))
    firsts = places.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("segment", "head")).alias("f"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 and f.head.role = 'system'")
    carried = places.join(firsts, places["conv_id"].eqNullSafe(firsts["c"]) & (places["segment"] > F.col("f.segment")))
    return rows.unionAll(
        carried.select("conv_id", "segment", F.lit(0), F.col("f.head.turn"), F.col("f.head.role"), F.col("f.head.text"))
    )


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, segment: int = 256, path: str | None = None) -> DataFrame:
    """Formatted windows: text, the turns in it, how many of them are repeated, and the loss spans (code points)."""
    path = path or tokenizer_path()

    def build(batches):
        enc, key, out = encoder(path), None, []
        for batch in batches:
            for conv, seg, kind, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "kind", "role", "text"))):
                if key != (conv, seg):
                    if key is not None:
                        out += state.close()
                    key, state = (conv, seg), _Window(conv, seg, budget, history)
                body = f"{START}{escape_role(role)}\n"
                shown = escape(text)
                tokens = enc.count(body) + enc.count(shown) + enc.count(END)
                out += state.add(kind, role, body, shown, tokens)
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out = []
        if key is not None:
            out += state.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    rows = dealt(turns, segment).repartition("conv_id", "segment")
    return rows.sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text").mapInArrow(build, WINDOW)


_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("turns", pa.int32()),
    ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


class _Window:
    """Streams one segment: holds the system turn, at most ``history`` tokens of past turns and the open span."""

    def __init__(self, conv, segment, budget, history):
        self.conv, self.segment, self.budget, self.history = conv, segment, budget, history
        self.system, self.past, self.past_tokens = [], deque(), 0
        self.carried, self.span, self.tokens, self.number = [], [], 0, 0
        self.seen = False

    def add(self, kind, role, body, shown, tokens):
        turn = (role, body, shown, tokens)
        if kind == 0:
            self.system, self.seen = [turn], True
            return []
        if kind == 1:
            self._remember(turn)
            return []
        done = []
        if self.span and self.tokens + tokens > self.budget:
            done = self.close()
        if not self.span:
            self._open(tokens)
        self.span.append(turn)
        self.tokens += tokens
        if role == "system" and not self.seen and self.number == 0 and len(self.span) == 1 and not self.past:
            self.system = [turn]
        elif turn is not (self.system[0] if self.system else None):
            self._remember(turn)
        self.seen = True
        return done

    def _remember(self, turn):
        self.past.append(turn)
        self.past_tokens += turn[3]
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[3]

    def _open(self, tokens):
        """Repeats the system turn and as much history as leaves room for the next turn."""
        room = self.budget - tokens - sum(t[3] for t in self.system)
        past, used = [], 0
        for turn in reversed(self.past):
            if used + turn[3] > room:
                break
            past.append(turn)
            used += turn[3]
        self.carried = [*self.system, *reversed(past)]
        self.tokens = sum(t[3] for t in self.carried)

    def close(self):
        if not self.span:
            return []
        text, loss, at = [], [], 0
        for i, (role, body, shown, _) in enumerate([*self.carried, *self.span]):
            if i >= len(self.carried) and role == "assistant":
                loss.append({"start": at + len(body), "end": at + len(body) + len(shown)})
            text += [body, shown, END]
            at += len(body) + len(shown) + len(END)
        row = {
            "conv_id": self.conv, "segment": self.segment, "window": self.number, "repeated": len(self.carried),
            "turns": len(self.carried) + len(self.span), "n_tokens": self.tokens, "text": "".join(text), "loss": loss,
        }
        self.span, self.carried, self.tokens, self.number = [], [], 0, self.number + 1
        return [row]


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(END))))
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the windows back: one row per conversation; the digests are sequential, so its windows stream in order."""

    def read(batches):
        key, have, out = None, False, []
        for batch in batches:
            for conv, repeated, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "repeated", "text", "loss"))):
                if not have or conv != key:
                    if have:
                        out.append(total())
                    key, have = conv, True
                    n, turns, spoken, chars, shown = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, body in parse(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    spoken.update(said.encode())
                    chars += len(said)
                shown += len(text)
                total = lambda: (key, n, turns.hexdigest(), chars, spoken.hexdigest(), shown)  # noqa: E731, B023
        if have:
            out.append(total())
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = formatted.select("conv_id", "segment", "window", "repeated", "text", "loss").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "segment", "window").mapInArrow(read, DIGEST)
