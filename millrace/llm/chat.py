"""Chat formatting on Spark SQL functions only: a finite-state machine over roles, and text segments with loss flags.

A template declares for each role an opening and a closing mark and whether its text is trained on; other roles share a mark
that carries their name. Control strings (the marks) inside texts are escaped reversibly: `&` becomes `&amp;`, and the first
character of a control string becomes an entity; marks hold `<` and `[` only at their start, so no mark can arise across a
border. parsed() reads turns back from the formatted text.

The machine walks the roles in order of turns; `valid` tells whether it accepts, `error_turn` the position (from 0) of the
first turn without a transition. Invalid conversations are formatted all the same, so that callers decide.

Defined results: null texts and roles are empty; turns sort by turn (null first), then role, then text, so ties have one
order; repeated rows are turns of their own; rows of null conv_id form one conversation of null id. A conversation is one row
of the result, so its turns meet in one task by nature; Spark's aggregation spills around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """role: (opening mark, closing mark, trained on)."""

    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<SYS>", "</SYS>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    start: str = "start"
    moves: frozenset[tuple[str, str]] = frozenset({("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    accepts: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        marks = [m.strip() for a, b, _ in self.roles.values() for m in (a, b)] + list(self.other)
        for m in marks:
            if m[:1] not in "<[" or re.search(r"[<\[&]", m[1:]):
                raise ValueError(f"a mark begins with < or [ and holds no <, [ or & further on: {m!r}")
        return list(dict.fromkeys(marks))


ENTITIES = {"<": "&lt;", "[": "&lsqb;"}


def escaped(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(ENTITIES[c[0]] + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    for char, entity in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def by_role(role: Column, template: Template, named, other: Column) -> Column:
    out = None
    for r, spec in template.roles.items():
        out = F.when(role == r, named(spec)) if out is None else out.when(role == r, named(spec))
    return other if out is None else out.otherwise(other)


def formatted(conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted (the segments' texts joined), valid, error_turn."""
    template = template or Template()
    c = conversations
    turn = F.struct(c[f"`{turn_col}`"].cast("long").alias("turn"), F.coalesce(c[f"`{role_col}`"].cast("string"), F.lit("")).alias("role"), F.coalesce(c[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    turns = c.select(c[f"`{id_col}`"].cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    name, middle, end = template.other

    def parts(x: Column) -> Column:
        opening = by_role(x["role"], template, lambda s: F.lit(s[0]), F.concat(F.lit(name), escaped(x["role"], template), F.lit(middle)))
        closing = by_role(x["role"], template, lambda s: F.lit(s[1]), F.lit(end))
        loss = by_role(x["role"], template, lambda s: F.lit(s[2]), F.lit(False))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(opening, F.lit(False)), piece(escaped(x["text"], template), loss), piece(closing, F.lit(False)))

    moves = F.create_map(*[F.lit(x) for a, b in sorted(template.moves) for x in (f"{a}>{b}", b)])

    def step(a: Column, x: Column) -> Column:
        to = F.when(a["error"].isNull(), moves[F.concat(a["state"], F.lit(">"), x["role"])])
        return F.struct(F.coalesce(to, a["state"]).alias("state"), F.coalesce(a["error"], F.when(to.isNull(), a["at"])).alias("error"), (a["at"] + 1).alias("at"))

    first = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("at"))
    walked = turns.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), F.aggregate("turns", first, step).alias("machine"))
    return walked.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("machine.error").isNull() & F.col("machine.state").isin(*template.accepts)).alias("valid"),
        F.col("machine.error").alias("error_turn"),
    )


def parsed(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    template = template or Template()
    name, middle, end = template.other
    opens = "|".join([*(re.escape(a) for a, _, _ in template.roles.values()), f"{re.escape(name)}.*?{re.escape(middle)}"])
    closes = "|".join([*(re.escape(b) for _, b, _ in template.roles.values()), re.escape(end)])
    pattern = F.lit(f"(?s)({opens})(.*?)(?:{closes})".replace("\\ ", " "))
    marks, bodies = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))

    def role(mark: Column) -> Column:
        out = F.when(mark.startswith(name), unescaped(F.substring(mark, F.lit(len(name) + 1), F.length(mark) - len(name) - len(middle))))
        for r, (a, _, _) in template.roles.items():
            out = out.when(mark == a, F.lit(r))
        return out

    return F.zip_with(marks, bodies, lambda m, b: F.struct(role(m).alias("role"), unescaped(b).alias("text")))


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, error_turn: what the formatted text and the segments hold."""
    rows = chats.select(
        "conv_id",
        parsed(F.col("formatted"), template).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
    )
