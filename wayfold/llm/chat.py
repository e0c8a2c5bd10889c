r"""Chat records of many layouts to canonical turns, chosen by a fingerprint of their nested field paths, and templates.

A record is a variant. Its fingerprint is a hash of its nested field paths, whatever the values' types, and selects a
declarative mapping. A record whose layout is unknown gives one row with its fingerprint and no turn, so that nothing
disappears silently. Mappings name paths, not code; `register` adds more.

A template writes `<|turn|>ROLE<|text|>TEXT<|end|>` for each turn. Inside roles and texts a backslash is doubled, and
control strings, this template's and other common ones, get a backslash after their first character; dropping one
backslash before each character gives the text back. So no text can open or close a turn.

Nulls: a null role or text is empty; records with a null conversation id are one conversation; turns with a null number
come first, and turns with equal numbers are ordered by role and text. Repeated turns are kept. A conversation becomes
one row and must fit in a task's memory. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """How records with these field paths ([] after an array) become turns.

    `messages` is the path of an array of messages, with `role` and `text` as paths within one; without `messages`, a
    record is itself one turn, and `number` its place. Or `fields` lists (role, paths): the texts at the paths, joined
    by a blank line, are one turn, left out if there is none. Fields come before messages. `rename` maps roles.
    """

    name: str
    paths: tuple[str, ...]
    messages: str = ""
    role: str = ""
    text: str = ""
    number: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


_SPEAKERS = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = [
    Mapping("turn rows", ("role", "text", "turn"), role="$.role", text="$.text", number="$.turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), "$.messages", "$.role", "$.content"),
    Mapping("speakers", ("conversations[].from", "conversations[].value"), "$.conversations", "$.from", "$.value", rename=_SPEAKERS),
    Mapping("system and speakers", ("conversations[].from", "conversations[].value", "system"), "$.conversations", "$.from", "$.value", fields=(("system", ("$.system",)),), rename=_SPEAKERS),
    Mapping("prompt and completion", ("completion", "prompt"), fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("prompt and response", ("prompt", "response"), fields=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Mapping("instruction and input", ("input", "instruction", "output"), fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping("question and answer", ("answer", "question"), fields=(("user", ("$.question",)), ("assistant", ("$.answer",)))),
]

_CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"


def register(mapping: Mapping) -> None:
    MAPPINGS.append(mapping)


def layout(paths: tuple[str, ...]) -> str:
    """The nested layout that has exactly these field paths, as records show it."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path.split("."):
            node = node.setdefault(step, {})

    def show(node: dict) -> str:
        inner = []
        for name in sorted(node):
            array = name.count("[]")
            below = show(node[name]) if node[name] else ""
            below = "ARRAY<" * array + below + ">" * array
            inner.append(name.replace("[]", "") + (f": {below}" if below else ""))
        return f"OBJECT<{', '.join(inner)}>"

    return show(tree)


def record_layout(record: Column) -> Column:
    """The nested layout of a variant, without the types of its values."""
    shown = F.schema_of_variant(record)
    shown = F.regexp_replace(shown, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]*\))?", "")
    return F.regexp_replace(shown, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]*\))?>", "ARRAY<>")


def fingerprint(shown: Column) -> Column:
    return F.substring(F.sha2(shown, 256), 1, 16)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _turns(mapping: Mapping, record: Column) -> Column:
    """array<struct<number, place, role, text>> of a record with this mapping."""

    def turn(number: Column, place: Column, role: Column, text: Column) -> Column:
        for old, new in mapping.rename:
            role = F.when(role == old, new).otherwise(role)
        return F.struct(number.cast("long").alias("number"), place.cast("int").alias("place"), role.alias("role"), text.alias("text"))

    none = F.lit(None)
    fixed = []
    for k, (role, paths) in enumerate(mapping.fields):
        found = F.filter(F.array(*(_text(record, p) for p in paths)), lambda t: F.length(t) > 0)
        fixed.append(F.when(F.size(found) > 0, turn(none, F.lit(k), F.lit(role), F.array_join(found, "\n\n"))))
    out = F.array_compact(F.array(*fixed)) if fixed else None
    if mapping.messages:
        messages = F.coalesce(F.try_variant_get(record, mapping.messages, "array<variant>"), F.array().cast("array<variant>"))
        listed = F.transform(messages, lambda m, k: turn(none, k + len(fixed), _text(m, mapping.role), _text(m, mapping.text)))
        return listed if out is None else F.concat(out, listed)
    if out is None:
        return F.array(turn(F.try_variant_get(record, mapping.number, "long"), F.lit(0), _text(record, mapping.role), _text(record, mapping.text)))
    return out


def canonical_turns(records: DataFrame, key: str, record: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """key, fingerprint, layout (the mapping's name or null), number, place, role and text, a row for each turn."""
    mappings = MAPPINGS if mappings is None else mappings
    shown = records.select(F.col(key).alias("key"), F.col(record).alias("record"), record_layout(F.col(record)).alias("shown"))
    marked = shown.select("key", "record", fingerprint(F.col("shown")).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<number:bigint,place:int,role:string,text:string>>")
    for mapping in mappings:
        is_it = F.col("fingerprint") == fingerprint(F.lit(layout(mapping.paths)))
        name, turns = F.when(is_it, mapping.name).otherwise(name), F.when(is_it, _turns(mapping, F.col("record"))).otherwise(turns)
    found = marked.select("key", "fingerprint", name.alias("layout"), F.explode_outer(turns).alias("t"))
    return found.select(F.col("key").alias(key), "fingerprint", "layout", "t.*")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, key: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: key, formatted, and loss_spans (start, end in code points) of the texts to learn from.

    Rows of canonical_turns without a place (records of an unknown layout, and known ones without turns) hold no turn and
    are left out; a conversation of such rows alone has no row here, and is found among canonical_turns by its null layout."""
    clean = turns.where("place is not null").select(F.col(key).alias("key"), "number", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit("<|text|>"))
    pieces = clean.withColumn("head", head).withColumn("body", escape(F.col("text")))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit("<|end|>")))
    order = Window.partitionBy("key").orderBy(F.col("number").asc_nulls_first(), "place", "role", "text")
    placed = pieces.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("upto") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    listed = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", span.alias("span")))).alias("all"))
    formatted = F.array_join(F.transform("all", lambda t: t["piece"]), "")
    spans = F.array_compact(F.transform("all", lambda t: t["span"]))
    return listed.select(F.col("key").alias(key), formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """Adds turns: array<struct<role, text>>, read back from the formatted text alone."""
    pieces = F.split(text, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|text\|>")
        return F.struct(unescape(F.substr(halves[0], F.lit(len("<|turn|>") + 1))).alias("role"), unescape(halves[1]).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
