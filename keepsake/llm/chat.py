"""Chat formatting: recognise a record's layout by its field paths, map it to turns, write a masked template.

A record is JSON text in one of several layouts (a prompt with its completion,
an instruction with input and output, lists of messages under various names).
Each declared layout has a fingerprint, the hash of the nested field paths that it
needs.  A record's own paths, as far as a layout declares them, are hashed in the same
way; the first layout whose fingerprint that gives, those with most paths first, is
the record's, and its expressions give the canonical turns (role, text).  Other fields
(identifiers, sources, names of speakers) don't matter; a ``system`` text beside any
layout is the first turn.  A message's text may be a list of parts.  A record that
fits no layout has null turns, so the row is kept and can be found.

The template writes ``<|turn|>role<|text|>text<|end|>`` per turn.  Control
strings inside roles and texts (the template's own, and those of common chat
templates) lose their first character to an escape pair, so no text can hold
one, and ``unescape`` restores the text exactly.  The loss mask is the list of
segments: the formatted text is their concatenation, and a segment counts for
the loss if it is the text of a turn whose canonical role is ``assistant``.

All of it is one projection per conversation; ``conversation_records`` gathers
rows by conversation with one exchange.  A conversation is one training example,
so its turns meet in one row.

Defined results: null roles and texts are empty; an empty list of messages has no
turns; a null ``conv_id`` is a conversation of its own; rows of one turn number are
ordered by role and text, null turn numbers come first; repeated rows stay repeated
turns; an empty table gives no rows; text that isn't JSON has null fields, but a record
of more than ``LONGEST`` bytes, which Spark can't parse, is an error; further columns
pass through, and one named like the output is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escape character, and what stands for it and for the two first characters of control strings.
ESC = "␛"
#: The control strings that no formatted text may hold.
CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|\[/?INST\]|<</?SYS>>|\[/?(?:SYSTEM|TOOL)\]"
ASSISTANT = "assistant"
#: Bytes of a record that Spark parses to a VARIANT.
LONGEST = 128 << 20
TOO_LONG = "a record is longer than can be parsed"
#: Role names of other layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are.

    ``items``: name of a list of messages with its role and text fields, or
    ``fields``: (role, name of the text, whether it may be absent or empty and then is no turn).
    """

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str, bool], ...] = ()
    rename_roles: bool = False

    def paths(self) -> list[str]:
        """The field paths that a record must have, sorted."""
        if self.items:
            at, role, body = self.items
            return sorted([at, f"{at}[].{role}", f"{at}[].{body}"])
        return sorted(name for _, name, optional in self.fields if not optional)


def _pair(question: str, answer: str) -> tuple:
    return ("user", question, False), ("assistant", answer, False)


LAYOUTS = (
    Layout("messages", ("messages", "role", "content")),
    Layout("conversations", ("conversations", "from", "value"), rename_roles=True),
    Layout("turns", ("turns", "role", "text")),
    Layout("prompt", fields=_pair("prompt", "completion")),
    Layout("response", fields=_pair("prompt", "response")),
    Layout("qa", fields=_pair("question", "answer")),
    Layout("instruction", fields=(("user", "instruction", False), ("user", "input", True), ("assistant", "output", False))),
)
#: Optional text beside any layout.
SYSTEM = "system"


def _field(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "variant")


def _list(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "array<variant>")


def known_paths(variant: Column, layouts=LAYOUTS) -> Column:
    """The field paths of a record that some layout declares, sorted; a message's field counts if all messages have it."""
    def has(path: str) -> Column:
        at, _, field = path.partition("[].")
        if field:
            return F.forall(_list(variant, at), lambda m: _field(m, field).isNotNull())
        lists = [lay.items[0] for lay in layouts if lay.items]
        return (_list(variant, path) if path in lists else _field(variant, path)).isNotNull()
    every = sorted({p for lay in layouts for p in lay.paths()})
    return F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in every]))


def fingerprint(paths: Column) -> Column:
    """Hash of sorted field paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(variant: Column, paths: Column, layouts=LAYOUTS) -> tuple[Column, Column]:
    """(layout name, turns) of a record with its known paths; both null where no layout fits."""
    name = turns = None
    for lay in sorted(layouts, key=lambda lay: -len(lay.paths())):
        declared = F.array(*[F.lit(p) for p in lay.paths()])
        fits = fingerprint(F.array_intersect(paths, declared)) == fingerprint(declared)
        value = _turns_of(variant, lay)
        name = F.when(fits, lay.name) if name is None else name.when(fits, lay.name)
        turns = F.when(fits, value) if turns is None else turns.when(fits, value)
    return name, turns


def _text(variant: Column, name: str) -> Column:
    """A field's text; of a list of parts, the texts of those."""
    def part(p: Column) -> Column:
        return F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(_list_or_map(p), F.lit("")).otherwise(
            F.try_variant_get(p, "$", "string")), F.lit(""))
    return F.coalesce(F.array_join(F.transform(_list(variant, name), part), ""),
                      F.try_variant_get(variant, f"$.{name}", "string"), F.lit(""))


def _list_or_map(v: Column) -> Column:
    return (F.try_variant_get(v, "$", "array<variant>").isNotNull()
            | F.try_variant_get(v, "$", "map<string,variant>").isNotNull())


def _turns_of(variant: Column, lay: Layout) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))
    if lay.items:
        at, role, body = lay.items

        def message(m: Column) -> Column:
            who = _text(m, role)
            if lay.rename_roles:
                named = F.lit(None).cast("string")
                for k, v in ROLE_NAMES.items():
                    named = F.when(who == k, v).otherwise(named)
                who = F.coalesce(named, who)
            return turn(who, _text(m, body))
        turns = F.transform(_list(variant, at), message)
    else:
        turns = F.array_compact(F.array(*[
            F.when(F.lit(not optional) | (_text(variant, name) != ""), turn(F.lit(role), _text(variant, name)))
            for role, name, optional in lay.fields]))
    system = F.when(_text(variant, SYSTEM) != "", F.array(turn(F.lit(SYSTEM), _text(variant, SYSTEM)))).otherwise(
        F.array().cast(TURNS))
    return F.concat(system, turns)


def escape(text: Column) -> Column:
    """The text without control strings: ``␛0`` for ``␛``, ``␛1`` and ``␛2`` for a control string's ``<`` or ``[``."""
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    out = F.regexp_replace(out, rf"<(?={_tails('<')})", ESC + "1")
    return F.regexp_replace(out, rf"\[(?={_tails('[')})", ESC + "2")


def _tails(first: str) -> str:
    alternatives = {"<": r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>", "[": r"/?INST\]|/?(?:SYSTEM|TOOL)\]"}
    return alternatives[first]


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(ESC + "1"), F.lit("<")), F.lit(ESC + "2"), F.lit("["))
    return F.replace(out, F.lit(ESC + "0"), F.lit(ESC))


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(turns: Column) -> Column:
    """Segments (text, loss) of the formatted conversation; their concatenation is the output text."""
    def write(t):
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss")),
                       F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, write))


def read_turns(formatted: Column) -> Column:
    """The canonical turns, read back from a formatted text."""
    def read(chunk):
        body = F.split(chunk, r"\Q" + TEXT + r"\E", 2)
        end = F.char_length(F.get(body, F.lit(1))) - len(END)
        return F.struct(unescape(F.get(body, F.lit(0))).alias("role"),
                        unescape(F.substr(F.get(body, F.lit(1)), F.lit(1), end)).alias("text"))
    chunks = F.split(formatted, r"\Q" + TURN + r"\E", -1)
    return F.transform(F.slice(chunks, F.lit(2), F.size(chunks) - 1), read)


def format_chat(records: DataFrame, record_col: str = "record", layouts=LAYOUTS, out_col: str = "chat") -> DataFrame:
    """``records`` with a struct column ``out_col``: layout, turns, segments, formatted.

    ``record_col`` holds JSON text; text that isn't JSON gives null fields.
    """
    names = records.columns
    if out_col in names:
        raise ValueError(f"the records have a column {out_col!r}; choose another out_col")
    text = F.col(f"`{record_col}`")
    record = F.when(F.octet_length(text) > LONGEST, F.raise_error(F.lit(TOO_LONG)).cast("variant")).otherwise(
        F.try_parse_json(text))
    parsed = records.select(F.struct([F.col(f"`{c}`") for c in names]).alias("row"), record.alias("record"))
    parsed = parsed.withColumn("paths", known_paths(F.col("record"), layouts))
    layout, turns = canonical_turns(F.col("record"), F.col("paths"), layouts)
    out = (parsed.select("row", layout.alias("layout"), turns.alias("turns"))
           .withColumn("segments", format_turns(F.col("turns")))
           .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"]))))
    chat = F.struct("layout", "turns", "segments",
                    F.when(F.col("segments").isNotNull(), F.col("formatted")).alias("formatted")).alias(out_col)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], chat)


def conversation_records(rows: DataFrame, varied: bool = False) -> DataFrame:
    """One JSON record per conversation from rows (conv_id, turn, role, text), in the plainest layout that fits.

    ``varied``: in any of the layouts that hold it (a hash of conv_id decides), with fields that no layout declares,
    as a corpus from many sources has them.
    """
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2 ** 63))).alias("turn"), text("role").alias("role"),
                 text("text").alias("text")))).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    at = lambda i: F.get("t", F.lit(i))["text"]
    extra = [F.struct(F.col("conv_id").alias("source")).alias("meta")] if varied else []

    def record(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields, *extra))

    def messages(role: str, body: str, name=lambda r: r) -> Column:
        return F.transform("t", lambda t: F.struct(name(t["role"]).alias(role), t["text"].alias(body)))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4)) if varied else F.lit(0)
    pair = [record(at(0).alias(q), at(1).alias(a)) for q, a in
            (("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"))]
    listed = [record(messages("role", "content").alias("messages"))]
    if varied:
        plain = F.forall(roles, lambda r: r.isin("user", ASSISTANT, SYSTEM))

        def named(r: Column) -> Column:
            return F.when(r == "user", "human").when(r == ASSISTANT, "gpt").otherwise(r)
        listed = [listed[0], record(messages("role", "text").alias("turns")),
                  F.when(plain, record(messages("from", "value", named).alias("conversations"))).otherwise(listed[0])]
    some = F.array(*listed)
    out = (F.when((F.size("t") == 2) & (F.array_join(roles, ",") == "user,assistant"), F.get(F.array(*pair), kind.cast("int")))
           .when((F.size("t") == 3) & (F.array_join(roles, ",") == "system,user,assistant"),
                 record(at(0).alias(SYSTEM), at(1).alias("prompt"), at(2).alias("completion")))
           .otherwise(F.get(some, (kind % len(listed)).cast("int"))))
    return gathered.select("conv_id", out.alias("record"))


def digest_columns(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask hold, read back: one row per conversation."""
    back = read_turns(F.col("chat.formatted"))
    masked = F.transform(F.filter("chat.segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (formatted.select("conv_id", "chat", back.alias("back"), F.concat_ws("", masked).alias("loss"))
            .select("conv_id", F.size("back").cast("long").alias("n_turns"),
                    F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("chat.formatted").cast("long").alias("formatted_chars"),
                    F.col("chat.layout").alias("layout")))
