"""Chat formatting: records of many layouts, told apart by a hash of their field paths, become one list of turns.

A layout declares which field paths its records have and where roles and texts
stand in them. The fingerprint of a record, a hash of all its nested field paths,
picks the layout; nothing is guessed from single fields. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand.

    With `turns` (the path of an array) each element is a turn with the fields
    `role` and `text`; `roles` renames its roles. `pairs` (an array of two-element
    arrays) gives a user and an assistant turn for each element. Then come the
    `fields` (role, paths): a turn of the texts at the paths, blank lines between
    those that are not empty; a field turn whose paths are all absent is left out.
    `optional` paths may be absent, `ignored` ones may be present.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    pairs: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    def path_sets(self) -> Iterator[frozenset[str]]:
        """All sets of field paths that a record of this layout may have."""
        own = {p for _, paths in self.fields for p in paths} - set(self.optional)
        lists = [[]]
        if self.turns:  # an empty list has no fields inside
            lists = [[f"{self.turns}[*].{self.role}", f"{self.turns}[*].{self.text}"], [f"{self.turns}[*]"]]
        if self.pairs:
            lists = [x + [y] for x in lists for y in (f"{self.pairs}[*][*]", f"{self.pairs}[*]")]
        free = [*self.optional, *self.ignored]
        for some in (c for k in range(len(free) + 1) for c in combinations(free, k)):
            for inside in lists:
                yield prefixes({*own, *some, *inside})


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: The layouts known to format_chats(); more can be given.
LAYOUTS = (
    Layout("messages", turns="$.messages", ignored=("$.id",)),
    Layout("conversations", turns="$.conversations", role="from", text="value", roles=SHARED_ROLES, ignored=("$.id",)),
    Layout("dialogue", turns="$.data.dialogue", role="speaker", text="utterance", roles=SHARED_ROLES),
    Layout("prompt", fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",))), optional=("$.system",), ignored=("$.id",)),
    Layout("completion", fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("instruction", fields=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))), optional=("$.system", "$.input")),
    Layout("history", pairs="$.history", fields=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
)


def prefixes(paths: set[str]) -> frozenset[str]:
    """The paths and those of all containers around them, but for the root."""
    out = set()
    for path in paths:
        while path != "$":
            out.add(path)
            path = path[:-3] if path.endswith("[*]") else path[: path.rindex(".")]
    return frozenset(out)


def path_hash(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """All nested field paths of a VARIANT, sorted; arrays count as [*], whatever their length.

    They are folded from the record's own schema text: names, openings and closings
    of objects and arrays in order, with a stack of the containers that are open.
    Scalar types, nulls included, have no say. Names other than words keep their
    back quotes, so no name can pass for structure. Where the elements of an array
    are of several kinds, paths end at the array.
    """
    schema = F.call_function("schema_of_variant", record)
    marks = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`|[A-Za-z0-9_]+(?=: )|OBJECT<|ARRAY<|>)"), F.lit(1))
    begin = F.struct(F.array().cast("array<string>").alias("open"), F.lit("$").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, mark: Column) -> Column:
        item = F.concat(acc["at"], F.lit("[*]"))
        name = F.concat(F.element_at(acc["open"], -1), F.lit("."), mark)
        no_paths = F.array().cast("array<string>")
        opened = F.when(mark == "OBJECT<", F.concat(acc["open"], F.array(acc["at"]))).when(mark == "ARRAY<", F.concat(acc["open"], F.array(item)))
        closed = F.when(mark == ">", F.slice(acc["open"], 1, F.size(acc["open"]) - 1)).otherwise(acc["open"])
        plain = ~mark.isin("OBJECT<", "ARRAY<", ">")
        at = F.when(mark == "ARRAY<", item).when(plain, name).otherwise(acc["at"])
        new = F.when(mark == "ARRAY<", F.array(item)).when(plain, F.array(name)).otherwise(no_paths)
        return F.struct(F.coalesce(opened, closed).alias("open"), at.alias("at"), F.concat(acc["paths"], new).alias("paths"))

    return F.array_sort(F.array_distinct(F.aggregate(marks, begin, step)["paths"]))


def fingerprint(record: Column) -> Column:
    """SHA-256 of a record's field paths; null for a null record."""
    return F.when(record.isNotNull(), F.sha2(F.concat_ws("\n", field_paths(record)), 256))


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of(record: Column, layout: Layout) -> Column:
    """The turns of a record of this layout."""
    parts = []
    if layout.turns:
        listed = F.variant_get(record, layout.turns, f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")

        def named(t: Column) -> Column:
            role = t[layout.role]
            for old, new in layout.roles:
                role = F.when(t[layout.role] == old, new).otherwise(role)
            return _turn(role, t[layout.text])

        parts.append(F.transform(listed, named))
    if layout.pairs:
        listed = F.variant_get(record, layout.pairs, "array<array<string>>")
        parts.append(F.flatten(F.transform(listed, lambda p: F.array(_turn(F.lit("user"), F.get(p, F.lit(0))), _turn(F.lit("assistant"), F.get(p, F.lit(1)))))))
    fields = []
    for role, paths in layout.fields:
        texts = [_text(record, p) for p in paths]
        joined = texts[0] if len(texts) == 1 else F.concat_ws("\n\n", F.filter(F.array(*texts), lambda x: x != ""))
        present = F.lit(True)
        if all(p in layout.optional for p in paths):
            present = F.lit(False)
            for p in paths:
                present = present | F.variant_get(record, p, "variant").isNotNull()
        fields.append(F.when(present, _turn(F.lit(role), joined)))
    if fields:
        parts.append(F.filter(F.array(*fields), lambda t: t.isNotNull()))
    return (parts[0] if len(parts) == 1 else F.concat(*parts)).cast(TURNS)


def canonical_turns(records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per row of records: (id_col, fingerprint, layout, turns).

    A record whose fingerprint no layout has gets a null layout and null turns and
    can be counted by its fingerprint. Null roles and texts become empty; a null
    record has nothing. Rows that repeat are kept, each of them; further columns are
    not read. A fingerprint that two layouts share is refused when the plan is made.
    """
    known: dict[str, str] = {}
    for layout in layouts:
        for h in {path_hash(p) for p in layout.path_sets()}:
            if known.setdefault(h, layout.name) != layout.name:
                raise ValueError(f"layouts {known[h]} and {layout.name} share a set of field paths")
    own = records.select(F.col(id_col), F.col(record_col).alias("__record"), fingerprint(F.col(record_col)).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        hit = F.col("fingerprint").isin([h for h, n in known.items() if n == layout.name])
        name = F.when(hit, layout.name).otherwise(name)
        turns = F.when(hit, turns_of(F.col("__record"), layout)).otherwise(turns)
    return own.select(id_col, "fingerprint", name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Text without control strings: one backslash more between each < and |, so that it can be taken back."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<\\")), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def escaped_role(role: Column) -> Column:
    """A role on one line without < in it."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per row of records: (id_col, fingerprint, layout, formatted, loss_spans).

    formatted has a block for each turn: START, the role, a line end, the text, END
    and a line end. Inside texts and roles control strings are escaped, so only the
    template itself marks turns. loss_spans (turn, start, end) says in which blocks,
    and there between which code points, a model is trained: the texts of the
    `trained` roles. Records without a layout have nulls, those without turns an
    empty string and no spans; for the rest see canonical_turns(). A record's text is
    one value, and the records are VARIANTs, which Spark limits to 128 MB.
    """
    made = canonical_turns(records, id_col, record_col, layouts)
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    blocks = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))
    shown = made.select(id_col, "fingerprint", "layout", blocks.alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit(END + "\n"))), "")

    def span(b: Column, i: Column) -> Column:
        start = F.length(b["head"])
        return F.when(b["loss"], F.struct(i.alias("turn"), start.alias("start"), (start + F.length(b["body"])).alias("end")))

    spans = F.filter(F.transform("blocks", span), lambda s: s.isNotNull())
    return shown.select(id_col, "fingerprint", "layout", whole.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame, id_col: str = "id") -> DataFrame:
    """(id_col, turns, loss_texts, formatted): turns and the texts under the loss mask, read from formatted and loss_spans alone and unescaped."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    cut = chats.select(id_col, "formatted", "loss_spans", F.slice(blocks, F.lit(1), F.size(blocks) - 1).alias("blocks"))

    def turn(b: Column) -> Column:
        inside = F.substr(b, F.lit(len(START) + 1))
        line = F.instr(inside, F.lit("\n"))
        return F.struct(unescaped_role(F.substr(inside, F.lit(1), line - 1)).alias("role"), unescaped(F.substr(inside, line + 1)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.get(F.col("blocks"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return cut.select(id_col, F.transform("blocks", turn).alias("turns"), loss.alias("loss_texts"), "formatted")
