"""Chat formatting: turns of typed content parts become training text with a loss mask, reversibly.

A turn is a role and an ordered list of parts (text, image, audio, document). ``Flatten`` visits the parts: it has one method for
each kind, which gives the shown text, the attachment reference and the number of tokens the part expands to. Text is
escaped, other parts become numbered placeholders such as ``<image 2>``; the number is the part's place in its turn. The
visitor makes Column expressions, so formatting stays in the JVM.

Template: ``<turn ROLE>``, newline, parts, ``</turn>``, newline. Inside texts a backslash is put before each backslash and before each
``<`` that could begin a mark (also the last character of a text, as the next part might complete it); inside roles before each
backslash and angle bracket. A reader that drops every unescaped backslash has the text again.

``format_turns`` keeps a conversation's turns together and in order (turn, role, content), one row a turn, so that no row
grows with the conversation; the conversation's text is its rows one after the other. Rows of a conversation are sorted with spill and
streamed, also by ``read_back``: a digest of an ordered text is sequential, so a conversation is one task, but never in memory at once.

Nulls: a null text, role or list of parts is empty; a null ``turn`` comes first; rows with null conv_id are a conversation. A null part
or one of unknown kind counts as its text. Repeated rows and ties of ``turn`` stay, ordered by role, then content. Empty table: empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
MARKS = ("image", "audio", "document")
#: Characters after ``<`` by which a mark begins: ``</turn>``, ``<turn``, and the first letters of MARKS.
_FIRST = "/t" + "".join(sorted({m[0] for m in MARKS}))
TRAINED = "assistant"


@dataclass(frozen=True)
class Rates:
    """How many tokens parts expand to: image patches of so many pixels a side, audio frames a second, tokens a document page,
    characters a text token."""

    patch: int = 28
    frames: int = 25
    page: int = 512
    chars: int = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"\\|<(?=[{_FIRST}]|\z)", r"\\$0")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), r"[\\<>]", r"\\$0")


class Flatten:
    """Visitor of content parts; each method takes a part and its place in the turn."""

    def __init__(self, rates: Rates = Rates()):
        self.rates = rates

    def visit(self, part: Column, place: Column) -> Column:
        """(shown, attachment, tokens) of a part; the attachment is null for text."""
        shown, tokens = self.text(part)
        for kind in MARKS:
            this = F.coalesce(part["kind"] == kind, F.lit(False))
            tokens = F.when(this, getattr(self, kind)(part)).otherwise(tokens)
            shown = F.when(this, F.concat(F.lit(f"<{kind} "), place.cast("string"), F.lit(">"))).otherwise(shown)
        attached = F.coalesce(part["kind"].isin(*MARKS), F.lit(False))
        ref = F.when(attached, F.struct(place.cast("int").alias("place"), part["kind"].alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens")))
        return F.struct(shown.alias("shown"), ref.alias("ref"), tokens.alias("tokens"))

    def text(self, part: Column) -> tuple[Column, Column]:
        text = F.coalesce(part["text"], F.lit(""))
        return escaped(text), F.ceil(F.length(text) / self.rates.chars).cast("long")

    def image(self, part: Column) -> Column:
        side = lambda x: F.greatest(F.ceil(F.coalesce(x, F.lit(0)) / self.rates.patch), F.lit(1))
        return (side(part["width"]) * side(part["height"])).cast("long")

    def audio(self, part: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.rates.frames), F.lit(1)).cast("long")

    def document(self, part: Column) -> Column:
        return (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.rates.page).cast("long")


def as_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) of a table with ``parts``, or with ``text`` where it has none."""
    own = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role")]
    if "parts" in turns.columns:
        return turns.select(*own, "parts")
    names = [f.split(":") for f in PART[len("struct<") : -1].split(",")]
    part = F.struct(*[(F.lit("text") if n == "kind" else F.coalesce("text", F.lit("")) if n == "text" else F.lit(None)).cast(t).alias(n) for n, t in names])
    return turns.select(*own, F.array(part).alias("parts"))


def format_turns(turns: DataFrame, visitor: Flatten | None = None, trained: str = TRAINED) -> DataFrame:
    """(conv_id, place, turn, formatted, loss_start, loss_chars, tokens, attachments): a row a turn, in order of ``place`` within its
    conversation. The loss mask covers ``loss_chars`` code points of ``formatted`` from ``loss_start`` on: the parts of a turn of role
    ``trained``, none of others. ``tokens`` counts what the parts expand to; ``attachments`` lists place, kind, uri and tokens."""
    v = visitor or Flatten()
    rows = as_parts(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    seen = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p, k: v.visit(p, k + 1))
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", seen.alias("_v"))
    head = F.concat(F.lit("<turn "), escaped_role(F.col("role")), F.lit(">\n"))
    body = F.array_join(F.transform("_v", lambda x: x["shown"]), "")
    rows = rows.withColumns({"_head": head, "_body": body})
    loss = F.col("role") == trained
    return rows.select(
        "conv_id", "place", "turn", F.concat("_head", "_body", F.lit("</turn>\n")).alias("formatted"),
        F.when(loss, F.length("_head")).otherwise(0).cast("long").alias("loss_start"), F.when(loss, F.length("_body")).otherwise(0).cast("long").alias("loss_chars"),
        F.aggregate("_v", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"),
        F.filter(F.transform("_v", lambda x: x["ref"]), lambda x: x.isNotNull()).alias("attachments"),
    )


_OPEN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
_CLOSE = re.compile(r"\\.|(</turn>\n)", re.S)
_PLACEHOLDER = re.compile(rf"\\(.)|<(?:{'|'.join(MARKS)}) \d+>", re.S)


def _plain(text: str) -> str:
    """Without placeholders, unescaped."""
    return _PLACEHOLDER.sub(lambda m: m.group(1) or "", text) if "\\" in text or "<" in text else text


def parse(formatted: str):
    """(role, text) of each turn of a formatted text; what is no turn is an error."""
    at = 0
    while at < len(formatted):
        head = _OPEN.match(formatted, at)
        end = head and next((m for m in _CLOSE.finditer(formatted, head.end()) if m.group(1)), None)
        if not end:
            raise ValueError(f"no turn at character {at}")
        yield _plain(head.group(1)), _plain(formatted[head.end() : end.start()])
        at = end.end()


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, length: int) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if length:
            trained = _plain(formatted[start : start + length])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self):
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in READ.split(", ")])


def _digests(batches):
    now = None
    for b in batches:
        done = []
        for conv, text, start, length in zip(*[b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_chars")], strict=True):
            if now is None or now.conv_id != conv:
                done += [now.row()] if now else []
                now = _Digest(conv)
            now.add(text, start, length)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in done], _READ)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, now.row(), strict=True))], _READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """READ of formatted turns: parsed, unescaped and digested in one pass over each conversation in order."""
    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "formatted", "loss_start", "loss_chars")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digests, READ)


def round_trip(turns: DataFrame, visitor: Flatten | None = None) -> DataFrame:
    """Format, write to the shared folder, read back; one row a conversation."""
    return read_back(Scratch(turns.sparkSession, "chat").store(format_turns(turns, visitor), "formatted"))


#: The contract's conversation of control strings.
HARD = r"\### Assistant: </turn> ok"


def with_hard_conversation(turns: DataFrame) -> DataFrame:
    rows = [(-7, k, role, HARD) for k, role in enumerate(("user", "assistant"))]
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
s AS (SELECT *, role = 'assistant' AS trained, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g'))
  + length(text) + len(regexp_extract_all(text, '\\|<[/taid]|<\z')) + 16 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE trained), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE trained), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
