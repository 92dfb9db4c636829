"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is one JSON text of any layout. Its fingerprint is the hash of its nested field paths; a declared layout is chosen by
fingerprint and says, as a SQL expression, how the record becomes turns.

Edge cases: null or malformed records, and records whose paths fit no layout, have layout null (``unmapped`` returns them) and no
turns. An empty message list gives no turns. Null roles and texts are empty texts. Turns of a conversation are ordered by turn
(nulls first), role, text; repeated rows stay repeated turns; a null conversation id is a conversation of its own. An empty table
gives no rows. A conversation becomes one text, hence must fit in one row; everything before the last step works on turns.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TURNS = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: nested fields, ``[]`` after arrays; ``optional`` may be absent; ``turns``: expression over the variant ``v``."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str


def _text(path: str) -> str:
    return f"try_variant_get(v, '$.{path}', 'string')"


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    who = f"x.{role}"
    for source, target in (names or {}).items():
        who = f"if(x.{role} = '{source}', '{target}', {who})"
    return (
        f"transform(try_variant_get(v, '$.{path}', 'array<struct<{role}: string, {text}: string>>'),"
        f" (x, i) -> named_struct('turn', cast(i as bigint), 'role', {who}, 'text', x.{text}))"
    )


def _steps(*pairs: tuple[str, str]) -> str:
    steps = ", ".join(
        f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})" for i, (role, text) in enumerate(pairs)
    )
    return f"filter(array({steps}), x -> x.role <> 'system' or x.text is not null)"


_IDS = ("conv_id", "conversation_id", "id")
_ASK = "concat_ws('\\n\\n', {0}, nullif({1}, ''))"

LAYOUTS = (
    Layout("turn", ("turn", "role", "text"), _IDS,
           "array(named_struct('turn', try_variant_get(v, '$.turn', 'bigint'), 'role', " + _text("role") + ", 'text', "
           + _text("text") + "))"),
    Layout("messages", ("messages[].role", "messages[].content"), _IDS, _list("messages", "role", "content")),
    Layout("speakers", ("conversations[].from", "conversations[].value"), _IDS,
           _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("instruction", ("instruction", "output"), (*_IDS, "input", "system"),
           _steps(("system", _text("system")), ("user", _ASK.format(_text("instruction"), _text("input"))),
                  ("assistant", _text("output")))),
    Layout("prompt", ("prompt", "completion"), (*_IDS, "system"),
           _steps(("system", _text("system")), ("user", _text("prompt")), ("assistant", _text("completion")))),
    Layout("question", ("question", "answer"), (*_IDS, "context"),
           _steps(("user", _ASK.format(_text("context"), _text("question"))), ("assistant", _text("answer")))),
)


def _render(paths: tuple[str, ...], empty: bool = False) -> str:
    """The paths as one nested text, names sorted; ``empty``: arrays without elements."""
    tree: dict[str, dict | None] = {}
    for path in paths:
        head, inside, rest = path.partition("[].")
        if inside:
            tree.setdefault(head, {})[rest] = None
        else:
            tree[head] = None
    parts = [
        name if tree[name] is None else f"{name}: ARRAY<>" if empty
        else f"{name}: ARRAY<OBJECT<{', '.join(sorted(tree[name]))}>>"
        for name in sorted(tree)
    ]
    return f"OBJECT<{', '.join(parts)}>"


def _shapes(layout: Layout) -> list[str]:
    shapes = set()
    for k in range(len(layout.optional) + 1):
        for extra in combinations(layout.optional, k):
            paths = layout.paths + extra
            shapes |= {_render(paths), _render(paths, empty=True), _render(tuple(p.split("[]")[0] for p in paths))}
    return sorted(shapes)


def fingerprint(variant: Column) -> Column:
    """Hash of the nested field paths of a variant; types of leaves do not count."""
    leaf = r"(?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]+\))?(?=[,>]|$)"
    bare = F.regexp_replace(F.schema_of_variant(variant), f": {leaf}", "")
    return F.xxhash64(F.regexp_replace(bare, f"(?<=ARRAY<){leaf}", ""))


def with_layout(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds the variant ``v``, its ``fingerprint`` and the name of the ``layout`` it selects."""
    known = records.select(F.try_parse_json(record).alias("v")).select("v", fingerprint(F.col("v")).alias("fingerprint"))
    name = F.lit(None).cast("string")
    for layout in LAYOUTS:
        name = F.when(F.col("fingerprint").isin([F.xxhash64(F.lit(s)) for s in _shapes(layout)]), layout.name).otherwise(name)
    return known.withColumn("layout", name)


def unmapped(records: DataFrame, record: str = "record") -> DataFrame:
    """Records that no layout fits, counted by fingerprint."""
    rest = with_layout(records, record).filter("layout is null")
    return rest.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Records of any declared layout -> ``conv_id, turn, role, text, layout``."""
    turns = F.lit(None).cast(_TURNS)
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, F.expr(layout.turns).cast(_TURNS)).otherwise(turns)
    conv = F.coalesce(*[F.expr(f"try_variant_get(v, '$.{name}', 'bigint')") for name in _IDS])
    rows = with_layout(records, record).select(conv.alias("conv_id"), "layout", F.explode(turns).alias("t"))
    return rows.select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"),
                       F.coalesce("t.text", F.lit("")).alias("text"), "layout")


# The template: "<turn ROLE>\n" TEXT "</turn>\n". After escaping, no text holds a control string, and every backslash starts a pair.
END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), "<(?=/?turn)", r"\\l")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for char, code in (("\n", "\\n"), (">", "\\g")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return unescape(role)


def format_chat(turns: DataFrame) -> DataFrame:
    """Turns -> ``conv_id, formatted, loss_mask``: spans (code points, end exclusive) of the escaped assistant texts."""
    piece = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("<turn "), _escape_role(F.col("role")), F.lit(">\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    long = F.length("head") + F.length("body") + len(END)
    placed = piece.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.sum(long).over(order.rowsBetween(W.unboundedPreceding, 0)) - long + F.length("head")
    )
    one = F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), "start",
                   (F.col("start") + F.length("body")).alias("end"), (F.col("role") == "assistant").alias("loss"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    return whole.select(
        "conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    parts = F.filter(F.split(formatted, END), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        _unescape_role(F.regexp_extract(x, r"\A<turn ([^>]*)>", 1)).alias("role"),
        unescape(F.substr(x, F.locate(">\n", x, 1) + 2)).alias("text"),
    ))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda x: unescape(
        F.substr(formatted, (x.start + 1).cast("int"), (x.end - x.start).cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from the formatted texts, as counts and digests."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
