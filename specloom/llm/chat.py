"""Chat formatting with a grammar round trip.

A conversation is rendered as its turns in order, each between the markers of its role:

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>
    any other   [ROLE]role[SAYS]text[/ROLE]

The parser takes an opening marker, the text up to the first matching closing marker, and undoes
escapes (\\l is <, \\s is [, \\b is a backslash).  A turn is first rendered as it is and parsed
again; where that does not give back exactly this one turn, its content is escaped and the check
is made again, until it does.  Escaped content has neither < nor [ and no backslash but those of
escapes, so one round is always enough.  As every turn opens and closes itself, turns that parse
alone also parse side by side; the whole text is parsed once more and compared with the source.

Only DataFrame functions are used.  Long conversations are joined in two steps, runs of turns
first, so that a conversation with a third of all rows arrives as a few rows.  A formatted
conversation is one value and so must fit in one row.

Defined results: rows go by turn, nulls first; rows with the same turn go by role, then text,
and repeated rows are turns each; null text and null role are empty; rows with a null
conv_id form one conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template's markers.
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
ESCAPES = {"\\": "\\b", "[": "\\s", "<": "\\l"}

GRAMMAR = (r"(?s)(?:(\Q<<SYS>>\E)(.*?)\Q<</SYS>>\E|(\Q[INST]\E)(.*?)\Q[/INST]\E|(\Q<s>\E)(.*?)\Q</s>\E"
           r"|\Q[ROLE]\E(.*?)\Q[SAYS]\E(.*?)\Q[/ROLE]\E)")
#: Turns joined to one run before runs are joined to a conversation.
RUN = 32


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (start, end) in MARKERS.items():
        out = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
    return out


def parsed(text: Column) -> Column:
    """Turns of a formatted text: array of struct(role, text)."""
    turns = F.regexp_extract_all(text, F.lit(GRAMMAR), F.lit(0))

    def turn(piece):
        body = F.regexp_extract(piece, GRAMMAR, 8)
        role = unescaped(F.regexp_extract(piece, GRAMMAR, 7))
        for i, name in ((2, "system"), (4, "user"), (6, "assistant")):
            hit = F.startswith(piece, F.lit(MARKERS[name][0]))
            body = F.when(hit, F.regexp_extract(piece, GRAMMAR, i)).otherwise(body)
            role = F.when(hit, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def _same(piece: Column, role: Column, text: Column) -> Column:
    """Does a rendered turn parse to exactly this turn?"""
    found = parsed(piece)
    return (F.size(found) == 1) & (found[0]["role"] == role) & (found[0]["text"] == text) & (
        F.length(F.regexp_extract(piece, GRAMMAR, 0)) == F.length(piece))


def rendered_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, role, text, piece: each turn rendered so that it parses back to itself."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = rendered(F.col("role"), F.col("text"))
    # A text without a backslash, [ or < holds no marker and no escape; only others need the parser.
    quiet = ~F.rlike(F.concat("role", "text"), F.lit(r"[\\\[<]"))
    rows = rows.withColumn("piece", plain).withColumn("__kept", quiet | _same(F.col("piece"), F.col("role"), F.col("text")))
    known = F.col("role").isin(*MARKERS)
    role = F.when(known, F.col("role")).otherwise(escaped(F.col("role")))
    return rows.withColumn("piece", F.when(F.col("__kept"), F.col("piece")).otherwise(rendered(role, escaped(F.col("text"))))).drop("__kept")


def formatted(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: conv_id, formatted, and source (the turns as given)."""
    rows = rendered_turns(turns, **columns)
    place = F.struct("turn", "role", "text", "piece")
    # Runs are cut by turn number, so runs follow each other in the order of their turns.
    run = F.floor(F.col("turn") / RUN)
    runs = rows.groupBy("conv_id", run.alias("run")).agg(F.sort_array(F.collect_list(place)).alias("turns"))
    runs = runs.select("conv_id", "run", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
                       F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "formatted", "source")),
                                                     lambda a, b: F.when(a["run"].eqNullSafe(b["run"]), 0).when(a["run"].isNull(), -1).when(b["run"].isNull(), 1)
                                                     .when(a["run"] < b["run"], -1).otherwise(1)).alias("runs"))
    return whole.select("conv_id", F.array_join(F.transform("runs", lambda r: r["formatted"]), "").alias("formatted"),
                        F.flatten(F.transform("runs", lambda r: r["source"])).alias("source"))


def recovered(conversations: DataFrame) -> DataFrame:
    """Parse the formatted text: conv_id, formatted, turns, loss (assistant texts in order) and same (equal to the source)."""
    out = conversations.withColumn("turns", parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return out.select("conv_id", "formatted", "turns", loss.alias("loss"), (F.col("turns") == F.col("source")).alias("same"))
