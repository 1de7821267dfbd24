"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation
are rendered, and each output is compared with the one before it: what was added is the new turn's
span. Where the earlier output is not a prefix of the later one the template has rewritten history,
and the turn is marked so. A prefix is the whole conversation so far, whatever its length, and one
conversation is held at a time. Only for templates declared ``turn_local``, such as the built-in one,
it is the last ``context`` turns: their output is that of each turn alone, so it makes no difference
and a conversation of any length streams through bounded memory.

Defined cases: a null text or role is empty; turns go by (turn, role, text), nulls first; rows of a
null conversation id form one conversation; repeated rows are turns of their own; a very long text is
one turn; equal turns come one after the other; other columns are not looked at, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``<|`` becomes ``<\\|``, and each level that is there already gets one more backslash."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def turn_local(template: Template) -> Template:
    """Declare that a template's output is the outputs of its turns, each on its own, one after the other."""
    template.turn_local = True
    return template


@turn_local
def chatml(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


@dataclass
class Segment:
    """What one turn added: its place in the whole output, its text, and the part under the loss mask."""

    start: int
    text: str
    loss_start: int  # within text; equal to loss_end where nothing is under the mask
    loss_end: int
    rewritten: bool


def mask_of(segment: str) -> tuple[int, int]:
    """The body of an assistant turn, in the built-in template's output."""
    m = _TURN.fullmatch(segment)
    return (m.start(2), m.end(2)) if m and unescape_role(m[1]) == "assistant" else (0, 0)


def render(turns: Iterable[Turn], template: Template = chatml, mask: Callable[[str], tuple[int, int]] = mask_of, context: int = 32) -> Iterator[Segment]:
    """The span of every turn, found by comparing the outputs of successive prefixes."""
    local = getattr(template, "turn_local", False)
    window: deque[Turn] = deque(maxlen=context if local else None)
    before, at = "", 0
    for turn in turns:
        slides = local and len(window) == context
        window.append(turn)
        if slides:
            before = template(list(window)[:-1])
        after = template(list(window))
        rewritten = not after.startswith(before)
        if rewritten:  # the new span begins where the outputs part
            shared = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if a != b), min(len(before), len(after)))
            at -= len(before) - shared
        else:
            shared = len(before)
        added = after[shared:]
        yield Segment(at, added, *mask(added), rewritten)
        at += len(added)
        before = after


def rewrites_history(template: Template, turns: list[Turn]) -> list[int]:
    """Indexes of the turns at which the template changes what it gave before."""
    return [i for i, s in enumerate(render(turns, template, lambda _: (0, 0), context=max(1, len(turns)))) if s.rewritten]


def read_back(segments: Iterable[Segment]) -> Iterator[tuple[str, str, str]]:
    """Role, text and the text under the loss mask of each turn, from the output alone."""
    for s in segments:
        m = _TURN.fullmatch(s.text)
        if not m:
            raise ValueError("the output can't be read back")
        yield unescape_role(m[1]), unescape(m[2]), unescape(s.text[s.loss_start : s.loss_end])


def _sorted_stream(df: DataFrame, partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = narrow.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    #: As strings: pandas would round whole numbers beside a null.
    return ordered.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple[object, str, str]]]]:
    """Each conversation id and its turns, as they stream by."""

    def rows():
        for b in batches:
            ids = [None if x is None else int(x) for x in b["conv_id"]]
            turns = [None if x is None else int(x) for x in b["turn"]]
            yield from zip(ids, turns, b["role"], b["text"])

    from itertools import groupby

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, ((t, role, text) for _, t, role, text in group)


def format_conversations(df: DataFrame, template: Template = chatml, mask=mask_of, context: int = 32, partitions: int | None = None) -> DataFrame:
    """One row per turn: its segment of the formatted text, its place and its part under the loss mask."""
    schema = "conv_id bigint, seq bigint, turn bigint, start bigint, segment string, loss_start int, loss_end int, rewritten boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        out = []
        for conv, turns in _conversations(batches):
            numbers: deque = deque()

            def pairs():
                for t, role, text in turns:
                    numbers.append(t)
                    yield role, text

            for seq, s in enumerate(render(pairs(), template, mask, context)):
                out.append((conv, seq, numbers.popleft(), s.start, s.text, s.loss_start, s.loss_end, s.rewritten))
                if len(out) >= 2000:
                    yield _frame(out, names)
                    out = []
        if out:
            yield _frame(out, names)

    return _sorted_stream(df, partitions).mapInPandas(run, schema)


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    cols = zip(*rows, strict=True)
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if n in ("conv_id", "turn") else c for n, c in zip(names, cols, strict=True)})


def digest_conversations(df: DataFrame, context: int = 32, partitions: int | None = None) -> DataFrame:
    """One row per conversation, read back from the formatted output as it streams by."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        out = []
        for conv, turns in _conversations(batches):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rewritten = False

            def seen():
                nonlocal chars, rewritten
                for s in render(((role, text) for _, role, text in turns), context=context):
                    chars = s.start + len(s.text)
                    rewritten |= s.rewritten
                    yield s

            for role, text, masked in read_back(seen()):
                n += 1
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss.update(masked.encode("utf-8", "surrogatepass"))
                loss_chars += len(masked)
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten))
            if len(out) >= 2000:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)

    return _sorted_stream(df, partitions).mapInPandas(run, schema)
