"""Chat formatting with a grammar round trip, in DataFrame functions throughout.

A conversation is rendered turn by turn as START role NEWLINE text END NEWLINE. The rendered text is parsed again by a deterministic
grammar (a role runs to the first bare newline, a text to the first END; a backslash makes the next character plain;
no control string of any known template may stand in a text), and the turns read back are compared with the source.
Where they differ, the conversation's texts are escaped: a backslash before each backslash, and one inside each control string after its first
character. One such round is enough: an escaped text has no bare control string (none of them holds a backslash, and each is broken after its first
character), and taking one backslash off each pair of a backslash and a character gives the source again. The second comparison
proves it row by row; a conversation that differs then is an error, never a silent loss.

Defined results: null texts and roles are empty; turns with equal numbers go by role and text; repeated turns are all kept;
rows with a null conversation id make one conversation; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates, none of which may stand bare in a text.
CONTROLS = (START, END, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|begin_of_text|>",
            "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
#: Turns whose lengths are summed together.
RUN = 128
BARE = "|".join(re.escape(c) for c in CONTROLS)
INSIDE = "([" + "".join(sorted({"\\" + c[0] for c in CONTROLS})) + "])(?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS})) + ")"
GRAMMAR = r"(?s)" + re.escape(START) + r"((?:[^\\\n]++|\\.)*+)\n(.*?)" + re.escape(END) + r"\n"


def escape(text: Column, newline: bool = False) -> Column:
    """Reversible; a text without backslash and control strings stays as it is. newline: escape that too (for roles)."""
    out = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), INSIDE, r"$1\\")
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if newline else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: Column) -> Column:
    """turns: array of role and text. The role is escaped always, as the grammar needs it; the text where asked for."""
    one = lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"), F.when(escaped, escape(t["text"])).otherwise(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """array of role, text (as they stand) and the text's place in code points; null where the text is not of the grammar."""
    part = lambda n: F.regexp_extract_all(rendered, F.lit(GRAMMAR), F.lit(n))
    ok = (F.array_join(part(0), "") == rendered) & ~F.exists(part(2), lambda b: b.rlike(BARE))
    return F.when(ok, F.arrays_zip(part(1).alias("role"), part(2).alias("body"), part(0).alias("all")))


def recovered(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["body"]).alias("text")))


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chats(rows: DataFrame, loss_role: str = "assistant", places: bool = True, **columns: str) -> DataFrame:
    """conv_id, formatted text, whether it had to be escaped, and the turns read back from the formatted text with
    the place (code points from 0; only if places are asked for) and length of each text; loss: whether the text is under the loss mask."""
    plain = conversations(rows, **columns).withColumn("raw", render(F.col("turns"), F.lit(False)))
    first = plain.withColumn("back", recovered(parse(F.col("raw"))))
    second = first.withColumn("escaped", ~F.coalesce(F.col("back") == F.col("turns"), F.lit(False)))
    third = second.select("conv_id", "turns", "escaped", F.when(F.col("escaped"), render(F.col("turns"), F.lit(True))).otherwise(F.col("raw")).alias("formatted"))
    read = third.withColumn("parsed", parse(F.col("formatted")))
    same = F.coalesce(recovered(F.col("parsed")) == F.col("turns"), F.lit(False))
    checked = read.select("conv_id", "escaped", "formatted", F.when(same, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation differs after its round trip"))).alias("parsed"))
    spans = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["body"].alias("body"), F.char_length(t["body"]).cast("long").alias("length"), (unescape(t["role"]) == loss_role).alias("loss")))
    if not places:
        return checked.select("conv_id", "escaped", "formatted", spans.alias("spans"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)
    # lengths are summed in runs first, so that a turn's place takes the runs before it and the turns of its own run; an array of one binds what is used many times
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    lengths = F.transform("parsed", lambda t: F.char_length(t["all"]).cast("long"))
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / RUN).cast("int")), lambda j: total(F.slice(x, j * RUN + 1, F.lit(RUN))))
    before = lambda x, sums, i: total(F.slice(sums, F.lit(1), F.floor(i / RUN).cast("int"))) + total(F.slice(x, (F.floor(i / RUN) * RUN).cast("int") + 1, (i % RUN) + 1))
    place = lambda z, sums: F.transform(z["cut"], lambda t, i: F.struct(
        t["role"].alias("role"), t["body"].alias("body"), (before(z["lengths"], sums, i) - t["length"] - len(END) - 1).alias("start"), t["length"].alias("length"), t["loss"].alias("loss")))
    placed = bound(F.struct(spans.alias("cut"), lengths.alias("lengths")), lambda z: bound(runs(z["lengths"]), lambda sums: place(z, sums)))
    return checked.select("conv_id", "escaped", "formatted", placed.alias("spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all from what the parser cut out of the formatted text (a cut by place would walk the text from its start for each turn)."""
    turns = F.array_join(F.transform("spans", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("spans", lambda t: t["loss"]), lambda t: unescape(t["body"])), "")
    return formatted.select("conv_id", F.size("spans").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
