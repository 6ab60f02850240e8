"""Chat formatting with a grammar round trip; DataFrame expressions only.

A conversation is the concatenation of its turns.  A turn of a known role is
its text between the role's marks; any other role is named between marks of
its own.  A deterministic parser reads the output back: it takes marks from
left to right, and the text between two marks is a role or a body.

Texts are first rendered as they are.  The rendered conversation is parsed and
compared with its source; turns that come back different, or that make the
parser lose its way, are rendered again with escapes, and the last resort is
to escape every turn.  Escaped text holds no ``<`` and no ``[``, so it holds no
mark: the backslash, ``<`` and ``[`` become two characters each.

Defined cases: null text and null role count as empty; turns are ordered by
(turn, role, text), nulls first; rows with a null conversation id form one
conversation; repeated rows are turns of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks by role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Marks of a turn whose role is written out: before the role, before the text, after it.
NAMED = ("[ROLE]", "[SAYS]", "[/ROLE]")

_ALL_MARKS = [m for pair in MARKS.values() for m in pair] + list(NAMED)
#: Fixed by the marks: any one of them, as a pattern.
MARK_PATTERN = "|".join("".join("\\" + c if c in "[]" else c for c in m) for m in _ALL_MARKS)


def escape(text: Column) -> Column:
    r"""``\`` ``<`` ``[`` become ``\\`` ``\l`` ``\b``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: pairs of backslashes are taken from the left."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def _render(turn: Column, escaped: Column) -> Column:
    body = F.when(escaped, escape(turn["text"])).otherwise(turn["text"])
    name = F.when(escaped, escape(turn["role"])).otherwise(turn["role"])
    out = F.concat(F.lit(NAMED[0]), name, F.lit(NAMED[1]), body, F.lit(NAMED[2]))
    for role, (left, right) in MARKS.items():
        out = F.when(turn["role"] == role, F.concat(F.lit(left), body, F.lit(right))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, or null if it does not follow the grammar.

    The marks alternate with texts.  For each opening mark the next marks must
    be the ones of its turn, with nothing between turns.
    """
    marks = F.regexp_extract_all(formatted, F.lit(f"({MARK_PATTERN})"), F.lit(1))
    texts = F.split(formatted, MARK_PATTERN, -1)
    both = F.struct(marks.alias("marks"), texts.alias("texts"))

    def read(x: Column) -> Column:
        m, t = x["marks"], x["texts"]
        close = F.create_map(*[F.lit(v) for pair in MARKS.values() for v in pair])
        opened = F.create_map(*[F.lit(v) for role, (left, _) in MARKS.items() for v in (left, role)])
        at = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        # element k of m stands between t[k] and t[k + 1]; F.get is null beyond the end
        here = lambda k: F.get(m, k)
        known = lambda k: F.coalesce(here(k + 1) == F.try_element_at(close, here(k)), F.lit(False))
        named = lambda k: F.coalesce((here(k) == NAMED[0]) & (here(k + 1) == NAMED[1]) & (here(k + 2) == NAMED[2]), F.lit(False))
        starts = F.filter(at, lambda k: F.map_contains_key(opened, here(k)) | (here(k) == NAMED[0]))
        turns = F.transform(
            starts,
            lambda k: F.when(known(k), F.struct(F.try_element_at(opened, here(k)).alias("role"), unescape(F.get(t, k + 1)).alias("text"), F.lit(2).alias("used"), (F.get(t, k) == "").alias("tight"))).when(
                named(k), F.struct(unescape(F.get(t, k + 1)).alias("role"), unescape(F.get(t, k + 2)).alias("text"), F.lit(3).alias("used"), (F.get(t, k) == "").alias("tight"))
            ),
        )
        # every mark is used, and nothing stands before, between or after the turns
        whole = F.forall(turns, lambda u: F.coalesce(u["tight"], F.lit(False))) & (F.aggregate(turns, F.lit(0), lambda a, u: a + F.coalesce(u["used"], F.lit(0))) == F.size(m)) & (F.element_at(t, -1) == "")
        return F.when(whole, F.transform(turns, lambda u: F.struct(u["role"], u["text"])))

    return F.transform(F.array(both), read)[0]


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, and the turns read back from it (array of role, text).

    ``escaped`` counts the turns written with escapes.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    source = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def same(turn: Column) -> Column:
        """Does the turn, rendered alone as it is, come back as itself?"""
        return F.transform(F.array(parse(_render(turn, F.lit(False)))), lambda p: F.coalesce((F.size(p) == 1) & (p[0]["role"] == turn["role"]) & (p[0]["text"] == turn["text"]), F.lit(False)))[0]

    def joined(flags: Column) -> Column:
        return F.array_join(F.transform(F.arrays_zip(F.col("turns").alias("turn"), flags.alias("hard")), lambda x: _render(x["turn"], x["hard"])), "")

    wanted = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # First as it is; then with the turns escaped that came back different; then with all of them.
    first = source.withColumn("conflicts", F.transform("turns", lambda t: ~same(t)))
    second = first.withColumn("formatted", joined(F.col("conflicts"))).withColumn("parsed", parse(F.col("formatted")))
    identical = F.coalesce(F.col("parsed") == wanted, F.lit(False))
    third = second.withColumn("identical", identical)
    all_hard = F.transform("turns", lambda t: F.lit(True))
    final = third.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(joined(all_hard)))
    final = final.withColumn("parsed", F.when(F.col("identical"), F.col("parsed")).otherwise(parse(F.col("formatted"))))
    escaped = F.when(F.col("identical"), F.size(F.filter("conflicts", lambda x: x))).otherwise(F.size("turns"))
    return final.select("conv_id", "formatted", F.col("parsed").alias("turns"), escaped.alias("escaped"))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the parsed output: turns, their hash, the text under the loss mask, and the length."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
