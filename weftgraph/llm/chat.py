"""Chat formatting in budgeted windows of whole turns.

A conversation is cut into windows by prefix sums of its turns' tokens: a window starts with the
leading system turns, repeats the latest turns up to ``history`` tokens, and takes new turns while
the sum stays within ``budget``. A turn's tokens are those of the turn as it is rendered, markers and
escapes included; turns begin and end where the tokenizer cuts, so they add up to the window's.
Only new assistant turns are under the loss mask; repeated turns are marked as such in the text, so
that the conversation can be read back from its windows.

Turns are ``<|turn|>`` or ``<|past|>``, role, newline, text, ``<|end|>``, newline. In roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so that no control string can stand in them; a
newline in a role becomes ``\\n``.

Conversations are dealt by their id, sorted, and streamed: a worker holds one window, its history
and running digests, never a whole conversation. The windows of one conversation follow from one
another, so a conversation is the work of one task, however long it is.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), role and text,
and repeated rows are turns of their own; a null ``conv_id`` is one conversation; every leading
system turn is repeated in every window; a window over the budget holds those and one new turn,
which is never cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, vocabulary_path

BUDGET, HISTORY = 1024, 256
NEW, PAST, END = "<|turn|>", "<|past|>", "<|end|>\n"
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:int,end:int>>, n_tokens long"
_TURN = re.compile(r"<\|(turn|past)\|>(.*?)\n(.*?)<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(mark: str, role: str, text: str) -> tuple[str, str]:
    """The head of a turn, and its escaped text."""
    return f"{mark}{escape_role(role)}\n", escape(text)


class Turn(NamedTuple):
    role: str
    text: str
    #: Tokens when new, when repeated, and of all repeated turns up to this one.
    new: int
    past: int
    upto: int


class Windower:
    """Makes the windows of one conversation, turn by turn."""

    def __init__(self, count, budget: int = BUDGET, history: int = HISTORY):
        self.count, self.budget, self.history = count, budget, history
        self.system: list[Turn] = []
        self.past: deque[Turn] = deque()
        self.new: list[Turn] = []
        #: Whether all turns so far are system turns, and whether they were when the window began.
        self.opening, self.leads, self.window = True, True, 0
        #: Prefix sums: of the turns as new ones and as repeated ones, at the window's first new turn and now.
        self.at_start = self.at_now = self.upto = self.system_tokens = 0

    def _held(self) -> int:
        """Tokens of the repeated turns of the window."""
        past = self.past[-1].upto - self.past[0].upto + self.past[0].past if self.past else 0
        return past + (self.system_tokens if self.window else 0)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        new, past = (self.count("".join(render(mark, role, text)) + END) for mark in (NEW, PAST))
        self.upto += past
        turn = Turn(role, text, new, past, self.upto)
        if self.new and self._held() + self.at_now - self.at_start + new > self.budget:
            yield self.close()
            # The history gives way before a new turn goes over the budget.
            while self.past and self._held() + new > self.budget:
                self.past.popleft()
        self.opening &= role == "system"
        self.new.append(turn)
        self.at_now += new

    def close(self) -> tuple:
        text, loss, at = [], [], 0
        shown = [(PAST, t) for t in (self.system if self.window else [])] + [(PAST, t) for t in self.past] + [(NEW, t) for t in self.new]
        for mark, t in shown:
            head, body = render(mark, t.role, t.text)
            if mark == NEW and t.role == "assistant":
                loss.append((at + len(head), at + len(head) + len(body)))
            text += [head, body, END]
            at += len(head) + len(body) + len(END)
        out = (self.window, "".join(text), loss, self._held() + self.at_now - self.at_start)
        # Leading system turns come with every window, so they are no history.
        leading = len(self.new) if self.opening else next((i for i, t in enumerate(self.new) if t.role != "system"), 0) if self.leads else 0
        self.system += self.new[:leading]
        self.system_tokens += sum(t.past for t in self.new[:leading])
        self.leads = self.opening
        self.past.extend(self.new[leading:])
        while self.past and self.past[-1].upto - self.past[0].upto + self.past[0].past > self.history:
            self.past.popleft()
        self.new, self.at_start, self.window = [], self.at_now, self.window + 1
        return out


def parse(text: str) -> list[tuple[bool, str, str]]:
    """Turns of a window: whether it is new, role and text."""
    return [(m[1] == "turn", unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(text)]


def _key(v):
    return None if pd.isna(v) else int(v)


def windows(conversations: DataFrame, vocabulary: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations, those of one after another in order; see ``WINDOWS``."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(vocabulary)
        count = lambda t: len(ids.encode(t)) // 4
        now, made, state = object(), [], None

        def frame() -> pd.DataFrame:
            out = pd.DataFrame([(k, w, t, [{"start": a, "end": b} for a, b in loss], n) for k, (w, t, loss, n) in made], columns=["conv_id", "window", "text", "loss", "n_tokens"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            made.clear()
            return out

        for b in batches:
            for k, role, text in zip(map(_key, b["conv_id"]), b["role"], b["text"]):
                if state is None or k != now:
                    if state is not None:
                        made.append((now, state.close()))
                    now, state = k, Windower(count, budget, history)
                made.extend((k, w) for w in state.add(role, text))
                if len(made) >= 1000:
                    yield frame()
        if state is not None:
            made.append((now, state.close()))
        if made:
            yield frame()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .drop("turn")
        .mapInPandas(run, WINDOWS)
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_tokens long"


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, from the text and loss mask of its windows as ``windows`` leaves them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, rows = object(), None, []

        def done() -> None:
            rows.append((now, s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["windows"], s["tokens"]))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "n_tokens"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            rows.clear()
            return out

        for b in batches:
            for k, text, loss, tokens in zip(map(_key, b["conv_id"]), b["text"], b["loss"], b["n_tokens"]):
                if s is None or k != now:
                    if s is not None:
                        done()
                    now, s = k, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0, "tokens": 0}
                for new, role, body in parse(text):
                    if new:
                        s["turns"] += 1
                        s["all"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for x in loss:
                    body = unescape(text[x["start"] : x["end"]])
                    s["chars"] += len(body)
                    s["loss"].update(body.encode("utf-8", "surrogatepass"))
                s["formatted"] += len(text)
                s["windows"] += 1
                s["tokens"] += tokens
            if len(rows) >= 10_000:
                yield frame()
        if s is not None:
            done()
        if rows:
            yield frame()

    return made.mapInPandas(run, DIGESTS)


#: A conversation whose texts hold another template's control strings.
PROBE = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(windows(rows.unionByName(spark.sql(PROBE))))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2_chat`` that SQL can say, from the same operator."""
    return op2_chat(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


DIGESTS_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS p(conv_id, turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id"""
