"""Chat formatting: a machine over roles, a declarative template, and segments with loss flags; DataFrame functions only.

A template says for each role which marks stand around a text, whether the text counts for the
loss, and after which roles it may stand. Marks that stand in a text itself are
broken by an escape, so that the formatted text gives roles and texts back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

START = "<start>"
ESCAPE = "\\"
#: Turns of a conversation that are one row of output; longer conversations are several.
PART_TURNS = 256


@dataclass(frozen=True)
class Speaker:
    """Marks before and after a role's text, whether the text is learnt, and the roles it may follow (START: none)."""

    opens: str
    closes: str
    loss: bool = False
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """``others`` (mark, mark, mark) stands around the name and the text of roles without a speaker; ``ends``: roles that may speak last."""

    speakers: dict[str, Speaker]
    others: tuple[str, str, str]
    ends: tuple[str, ...] = ()
    roles: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "roles", tuple(self.speakers))
        marks = self.controls
        if len(set(marks)) < len(marks) or any(not m or ESCAPE in m for m in marks):
            raise ValueError("marks must differ, and hold more than spaces and no escape")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if b[:k] != a):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")

    @property
    def controls(self) -> list[str]:
        """All marks without the spaces around them: what no text may hold."""
        return [m.strip() for x in self.speakers.values() for m in (x.opens, x.closes)] + [m.strip() for m in self.others]

    @property
    def leads(self) -> str:
        return "".join(sorted({m[0] for m in self.controls}))

    @property
    def start(self) -> int:
        """The machine's states: a number for each speaker's role, one for other roles, and this one before the first turn."""
        return len(self.roles) + 1

    def follows(self) -> list[bool]:
        """Whether a turn of role b may stand in state a, at place a * (roles + 1) + b; other roles never may."""
        names = [*self.roles, None, START]
        return [b is not None and a in self.speakers[b].after for a in names for b in [*self.roles, None]]


INSTRUCT = Template(
    {
        "system": Speaker("<<SYS>>\n", "\n<</SYS>>\n", after=(START,)),
        "user": Speaker("[INST] ", " [/INST]\n", after=(START, "system", "assistant")),
        "assistant": Speaker("<s> ", " </s>\n", True, after=("user",)),
    },
    ("[ROLE] ", " [TEXT] ", " [/TEXT]\n"),
    ("assistant",),
)


def _java(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    """An escape after each escape of the text, and after each mark's first character where a mark, an escape or the text's end follows it."""
    rests = {c: [_java(m[1:]) for m in template.controls if m[0] == c] for c in template.leads}
    heads = [f"{_java(c)}(?={'|'.join([*rest, _java(ESCAPE), ESCAPE + 'z'])})" for c, rest in rests.items()]
    return F.regexp_replace(text, f"({'|'.join([_java(ESCAPE), *heads])})", "$1" + ESCAPE * 2)


def unescape(text: Column, template: Template) -> Column:
    kinds = "".join(map(_java, ESCAPE + template.leads))
    return F.regexp_replace(text, f"([{kinds}]){_java(ESCAPE)}", "$1")


def _role_number(role: Column, template: Template) -> Column:
    out = F.lit(len(template.roles))
    for k, name in enumerate(template.roles):
        out = F.when(role == name, k).otherwise(out)
    return out


def _segments(turn: Column, template: Template) -> Column:
    before, name, after = template.others
    opens, closes, loss = F.concat(F.lit(before), escape(turn["role"], template), F.lit(name)), F.lit(after), F.lit(False)
    for role, s in template.speakers.items():
        own = turn["role"] == role
        opens, closes, loss = F.when(own, s.opens).otherwise(opens), F.when(own, s.closes).otherwise(closes), F.when(own, s.loss).otherwise(loss)
    mark = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
    return F.array(mark(opens), F.struct(escape(turn["text"], template).alias("text"), loss.alias("loss")), mark(closes))


def format_turns(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Conversations as segments: conv_id, part, place, whole, segments, last_role, bad_place.

    A row is a stretch of ``part_turns`` turn numbers of one conversation, in order of turn, role and text: ``segments``
    (text, loss) are marks and escaped texts whose concatenation is the formatted conversation; ``place`` counts the turns before
    it; ``whole`` says that the conversation has no other part. ``bad_place`` is the place of the first turn that may not stand after
    the one before it (null: none), ``last_role`` the number of the role that spoke last.

    The machine's state is the role that spoke last, so a part needs only the last role of the part before. These
    are found on roles and numbers alone and meet their part in the one shuffle of the
    texts, so that a conversation of any length is shared by many tasks.

    Null text or role: empty. Null turns stand first, null conversations are one. Equal rows are turns of their own. Rows of one
    conversation with the same turn number are one task's. No rows: no rows. Other columns are left out, so no name can clash.
    """
    turn = F.col(f"`{turn_col}`").cast("long")
    said = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.coalesce(F.floor(turn / part_turns), F.lit(-(2**62))).cast("long").alias("part"), turn.alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("part")
    ends = said.groupBy("conv_id", "part").agg(F.max_by(_role_number(F.col("role"), template), F.struct("turn", "role")).alias("last"), F.count("*").alias("n"))
    ends = ends.select(
        "conv_id", "part", F.coalesce(F.lag("last").over(order), F.lit(template.start)).alias("begin"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("place"),
        (F.lag("n").over(order).isNotNull() | F.lead("n").over(order).isNotNull()).alias("several"),
    ).where("several")
    rows = said.select("conv_id", "part", F.struct("turn", "role", "text").alias("t"))
    met = rows.unionByName(ends.select("conv_id", "part", "begin", "place"), allowMissingColumns=True).groupBy("conv_id", "part")
    met = met.agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("begin").alias("begin"), F.max("place").alias("place"))
    numbers = F.transform("t", lambda x: _role_number(x["role"], template))
    begin, width = F.coalesce("begin", F.lit(template.start)), len(template.roles) + 1
    follows = F.array(*map(F.lit, template.follows()))

    def checked(n: Column) -> Column:
        fits = F.transform(n, lambda b, k: F.get(follows, F.when(k == 0, begin).otherwise(F.get(n, k - 1)) * width + b))
        at = F.array_position(fits, False)
        return F.struct(F.get(n, F.size(n) - 1).alias("last_role"), F.when(at > 0, at - 1 + F.coalesce("place", F.lit(0))).alias("bad_place"))

    return met.select(
        "conv_id", "part", F.coalesce("place", F.lit(0)).alias("place"), F.col("begin").isNull().alias("whole"),
        F.flatten(F.transform("t", lambda x: _segments(x, template))).alias("segments"), let(numbers, checked).alias("m"),
    ).select("conv_id", "part", "place", "whole", "segments", "m.last_role", "m.bad_place")


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text holds, found by its marks alone."""
    before, name, after = template.others
    marks = {s.opens: role for role, s in template.speakers.items()}
    opens = "|".join(map(_java, [*marks, before]))
    closes = "|".join(map(_java, [*(s.closes for s in template.speakers.values()), after]))
    found = [F.regexp_extract_all(formatted, F.lit(f"(?s)({opens})(.*?)({closes})"), F.lit(k)) for k in (1, 2)]

    def turn(mark: Column, k: Column, bodies: Column) -> Column:
        body, role = F.get(bodies, k), F.lit(None).cast("string")
        for m, r in marks.items():
            role = F.when(mark == m, r).otherwise(role)
        own = F.split(body, _java(name), 2)
        text = F.when(role.isNull(), F.get(own, F.lit(1))).otherwise(body)
        return F.struct(F.coalesce(role, unescape(F.get(own, F.lit(0)), template)).alias("role"), unescape(text, template).alias("text"))

    return let(found[1], lambda bodies: F.transform(found[0], lambda mark, k: turn(mark, k, bodies)))


def conversation_digests(parts: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, bad_place.

    A hash needs its whole text in one row, so the parts of long conversations meet here; the others stay where they are.
    ``valid``: no turn out of order, and the last one's role may speak last.
    """
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    told = lambda t: F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    texts = let(formatted, lambda f: F.struct(F.length(f).cast("long").alias("chars"), let(read_turns(f, template), lambda t: F.struct(F.size(t).cast("long").alias("n"), told(t).alias("text"))).alias("turns")))
    read = parts.select("conv_id", "part", "whole", "last_role", "bad_place", learnt.alias("learnt"), texts.alias("f"))
    read = read.select("conv_id", "part", "whole", "last_role", "bad_place", "learnt", F.col("f.chars").alias("chars"), F.col("f.turns.n").alias("n"), F.col("f.turns.text").alias("told"))
    several = read.where("NOT whole").groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.min("bad_place").alias("bad_place"), F.max_by("last_role", "part").alias("last_role"), F.sort_array(F.collect_list(F.struct("part", "told", "learnt"))).alias("x")
    )
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "").alias(c)
    both = read.where("whole").select("conv_id", "n", "chars", "bad_place", "last_role", "told", "learnt").unionByName(several.select("conv_id", "n", "chars", "bad_place", "last_role", joined("told"), joined("learnt")))
    ends = F.col("last_role").isin(*[template.roles.index(r) for r in template.ends])
    return both.select(
        "conv_id", F.col("n").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"), (F.col("bad_place").isNull() & ends).alias("valid"), "bad_place",
    )
