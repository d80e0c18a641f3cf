"""Chat formatting: a visitor flattens typed content parts into one string a conversation, in DataFrame functions.

A turn is `[INST]` role `[/INST]` content `</s>`. Text parts are escaped; image, audio and document parts become ordered
placeholders, and what each refers to and how many tokens it stands for is recorded beside the string.

Control strings in roles and texts are escaped reversibly: an opening bracket, any backslashes and the rest of a control
string get one more backslash after the bracket. Since no control string has an opening bracket or a backslash after its
first character, none can arise where two strings meet, and taking one backslash away gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """The marks of a turn, the placeholders, other control strings to escape, and whose content is learnt."""

    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"})
    others: tuple[str, ...] = ("<s>",)
    learnt: str = "assistant"

    def __post_init__(self):
        bad = [c for c in self.controls if not re.fullmatch(r"[<\[][^<\[\\]+", c)]
        if bad or len(set(self.controls)) < len(self.controls):
            raise ValueError(f"a control string is a bracket (< or [) and more without brackets of that kind or backslashes, and each differs: {bad or self.controls}")

    @property
    def controls(self) -> list[str]:
        return [self.open, self.close, self.end, *self.placeholders.values(), *self.others]

    @property
    def tails(self) -> str:
        return "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=len, reverse=True))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self.tails})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self.tails})", "$1$2$3")


#: A content part. Sizes that are null count as one unit of their kind.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


class Visitor:
    """Visits the parts of a turn in order; each visit gives what the part adds to the string and what it attaches.

    Kinds are text, image, audio and document; any other (or a null) kind counts as text, and a null part adds nothing.
    Subclasses change what an attachment expands to.
    """

    patch, rate, page_tokens = 28, 25.0, 1024

    def __init__(self, template: Template):
        self.template = template

    def visit_text(self, part: Column) -> Column:
        return self._gives(self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0))

    def visit_image(self, part: Column) -> Column:
        sides = [F.ceil(F.coalesce(part[s], F.lit(1)) / F.lit(self.patch)) for s in ("width", "height")]
        return self._attaches("image", part, sides[0] * sides[1])

    def visit_audio(self, part: Column) -> Column:
        return self._attaches("audio", part, F.ceil(F.coalesce(part["seconds"], F.lit(1 / self.rate)) * F.lit(self.rate)))

    def visit_document(self, part: Column) -> Column:
        return self._attaches("document", part, F.coalesce(part["pages"], F.lit(1)) * F.lit(self.page_tokens))

    def _attaches(self, kind: str, part: Column, tokens: Column) -> Column:
        return self._gives(F.lit(self.template.placeholders[kind]), F.lit(kind), part["ref"], tokens)

    @staticmethod
    def _gives(text: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(text.alias("text"), kind.alias("kind"), ref.alias("ref"), tokens.cast("long").alias("tokens"))

    def visit(self, part: Column) -> Column:
        out = self.visit_text(part)
        for kind in self.template.placeholders:
            out = F.when(part["kind"] == kind, getattr(self, f"visit_{kind}")(part)).otherwise(out)
        return out

    def flatten(self, parts: Column) -> Column:
        """The parts' visits, in order."""
        return F.transform(F.filter(parts, lambda p: p.isNotNull()), self.visit)


def text_part(text: Column) -> Column:
    """A plain text as the parts of its turn."""
    names = {"kind": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    fields = [c.split(":")[0].strip() for c in PART[len("struct<") : -1].split(",")]
    return F.array(F.struct(*(names.get(n, F.lit(None)).alias(n) for n in fields)).cast(PART))


def format_conversations(messages: DataFrame, template: Template | None = None, parts: str | None = None, visitor: type[Visitor] = Visitor) -> DataFrame:
    """conv_id, n_turns int, formatted, loss_spans, attachments, expanded_tokens long: a row for each conv_id of (conv_id, turn, role, text).

    `parts` names a column of content parts (PART) that stands for text where it isn't null. Rows go by turn, null
    first; ties by role and text, and a repeated row is a turn of its own. Null roles and texts are empty; null
    conv_ids are one conversation. An empty table has an empty result; other columns are ignored, whatever their names.

    loss_spans: turn (from 0), start (in formatted), within (in the turn's string), length, in code points, of the content
    of each turn of the template's learnt role. attachments: turn, place (from 0, within the turn), kind, ref, tokens.
    A conversation is one string of its turns, so it's what one task holds at a time.
    """
    template = template or Template()
    content = text_part(F.col("text")) if parts is None else F.coalesce(F.col(parts).cast(f"array<{PART}>"), text_part(F.col("text")))
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), content.alias("content"))
    flat = turns.select("conv_id", "turn", "role", "text", visitor(template).flatten(F.col("content")).alias("flat"))
    said = flat.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.close)).alias("head"),
        F.array_join(F.transform("flat", lambda p: p["text"]), "").alias("body"), F.filter("flat", lambda p: p["kind"].isNotNull()).alias("attached"),
    )
    said = said.withColumn("string", F.concat("head", "body", F.lit(template.end)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "string")
    said = said.withColumns({
        "place": F.row_number().over(order) - 1,
        "start": F.coalesce(F.sum(F.length("string").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    span = F.struct(F.col("place").alias("turn"), (F.col("start") + F.length("head")).alias("start"), F.length("head").alias("within"), F.length("body").alias("length"))
    one = said.select("conv_id", F.struct("place", "string", F.when(F.col("role") == template.learnt, span).alias("span"), F.transform(
        "attached", lambda p, k: F.struct(F.col("place").alias("turn"), k.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached")).alias("said"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    attachments = F.flatten(F.transform("said", lambda s: s["attached"]))
    return whole.select(
        "conv_id", F.size("said").alias("n_turns"), F.array_join(F.transform("said", lambda s: s["string"]), "").alias("formatted"),
        F.filter(F.transform("said", lambda s: s["span"]), lambda s: s.isNotNull()).alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(F.transform(attachments, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, t: s + t).alias("expanded_tokens"),
    )


def read_turns(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The conversations with `turns`: role and text of each turn, read from the string alone.

    Placeholders stay in the text; unescaped, they can't be told from the same words in a text part, so `pieces` has the
    text parts and placeholders one by one: kind (text or the attachment's) and text (empty for an attachment).
    """
    template = template or Template()
    kinds = {mark: kind for kind, mark in template.placeholders.items()}
    marks = "|".join(re.escape(m) for m in kinds)

    def piece(t: Column) -> Column:
        kind = F.lit("text")
        for mark, k in kinds.items():
            kind = F.when(t == mark, F.lit(k)).otherwise(kind)
        return F.struct(kind.alias("kind"), F.when(kind == "text", template.unescape(t)).otherwise("").alias("text"))

    def turn(s: Column) -> Column:
        head = F.locate(template.close, s)
        body = s.substr(head + F.lit(len(template.close)), F.length(s))
        role = template.unescape(s.substr(F.lit(len(template.open) + 1), head - F.lit(len(template.open) + 1)))
        pieces = F.transform(F.filter(F.split(body, f"(?={marks})|(?<={marks})"), lambda t: t != ""), piece)
        return F.struct(role.alias("role"), template.unescape(body).alias("text"), pieces.alias("pieces"))

    return formatted.withColumn("turns", F.transform(_strings(template), turn))


def _strings(template: Template) -> Column:
    """Each turn's string, without its end."""
    parts = F.split("formatted", re.escape(template.end), -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def loss_text(template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped: the learnt role's contents in order, nothing between."""
    template = template or Template()
    strings = _strings(template)
    return F.array_join(F.transform("loss_spans", lambda s: template.unescape(F.get(strings, s["turn"]).substr(s["within"] + 1, s["length"]))), "")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, from what the string holds."""
    read = read_turns(formatted, template).withColumn("loss", loss_text(template))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
