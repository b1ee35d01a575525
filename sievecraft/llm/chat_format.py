"""Chat formatting in budgeted windows, in built-in functions only.

Prefix sums of turn tokens choose spans of whole turns for a conversation; every window repeats the leading system turns and a limited
history of earlier turns, whose targets are masked, so that each assistant text is learnt from exactly once.

Template of a turn: <|turn|>role<|text|>text<|end|> and a new line. Every control string starts with "<|"; inside roles and texts a
backslash is doubled and "<|" becomes "<\\|", so no text can contain a control string and unescape() restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Window starts that are gathered before they join the others.
_RUN = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Only an escaped "<|" has one backslash alone between its two characters, so the order of the two steps is safe."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes or part of it, and four for the template."""
    return (F.floor((F.octet_length(text) + 3) / 4) + 4).cast("long")


def _starts(turns: Column, n_system: Column, system_tokens: Column, budget: int, history: int, history_tokens: int) -> Column:
    """Indexes of the turns that begin a span. before: prefix sums of tokens, so a span's or history's size is a difference of two."""

    def hist(i: Column) -> Column:
        low = F.greatest(n_system, i - history)
        fits = F.filter(F.sequence(F.lit(0), F.lit(history)), lambda k: (i - k >= low) & (F.get(turns, i)["before"] - F.get(turns, i - k)["before"] <= history_tokens))
        return let(F.array_max(fits), lambda k: F.struct((i - k).cast("int").alias("from"), (F.get(turns, i)["before"] - F.get(turns, (i - k).cast("int"))["before"]).alias("tokens")))

    def appended(acc: Column, start: Column) -> tuple[Column, Column]:
        """The starts go into a short array, and full ones into `out`, so that adding one does not copy all that came before."""
        full = F.size(acc["last"]) >= _RUN
        return F.when(full, F.array_append(acc["out"], acc["last"])).otherwise(acc["out"]).alias("out"), F.when(full, F.array(start)).otherwise(F.array_append(acc["last"], start)).alias("last")

    def step(acc: Column, i: Column) -> Column:
        over = F.get(turns, i)["before"] + F.get(turns, i)["tokens"] - acc["base"] > budget - system_tokens
        fresh = hist(i)
        # base: the prefix sum at the first token counted in the window; a turn beyond the budget alone gets a window of its own, whole
        again = let(fresh, lambda h: F.struct(
            (F.get(turns, i)["before"] - F.when(h["tokens"] + F.get(turns, i)["tokens"] <= budget - system_tokens, h["tokens"]).otherwise(F.lit(0).cast("long"))).alias("base"),
            *appended(acc, F.struct(i.alias("start"), F.when(h["tokens"] + F.get(turns, i)["tokens"] <= budget - system_tokens, h["from"]).otherwise(i).alias("from"))),
        ))
        return F.when(over & (i > n_system), again).otherwise(acc)

    zero = F.struct(
        F.when(F.size(turns) > n_system, F.get(turns, n_system)["before"]).otherwise(F.lit(0).cast("long")).alias("base"),
        F.array().cast("array<array<struct<start:int,from:int>>>").alias("out"),
        F.array(F.struct(n_system.alias("start"), n_system.alias("from"))).alias("last"),
    )
    todo = F.when(F.size(turns) > n_system, F.sequence(n_system, F.size(turns) - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.aggregate(todo, zero, step), lambda a: F.concat(F.flatten(a["out"]), a["last"]))


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256, tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_masked (leading turns that are repeated), n_new, loss (array of start, length in
    code points of formatted: assistant texts that are new in this window), n_tokens.

    turns has conv_id, turn, role, text, one row per turn; tokens: the tokens of a row's text, else an estimate by bytes. A window is
    the leading system turns (those before the first other turn), up to `history` earlier turns of at most history_tokens tokens, and
    new turns as far as the budget goes; a new turn that exceeds it alone still makes a window, whole. Null texts and roles are
    empty. Turns come in order of turn (null first), then role and text, so ties and repeated rows have a fixed order and all stay. Rows
    with null conv_id are one conversation. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (estimated_tokens(text) if tokens is None else tokens.cast("long")).alias("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", F.struct("turn", "role", "text", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0).cast("long")).alias("before")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["tokens"].alias("tokens"), x["before"].alias("before"))).alias("t"))
    lead = let(F.filter(F.transform("t", lambda x, i: F.when(x["role"] != "system", i)), lambda i: i.isNotNull()), lambda others: F.coalesce(F.get(others, F.lit(0)), F.size("t")))
    convs = convs.select("conv_id", "t", lead.cast("int").alias("sys"))

    def windows(bound: Column) -> Column:
        t, sys = bound["t"], bound["sys"]
        system_tokens = F.when(F.size(t) > sys, F.get(t, sys)["before"]).otherwise(F.lit(0).cast("long"))
        return let(_starts(t, sys, system_tokens, budget, history, history_tokens), lambda s: F.transform(s, lambda w, i: F.struct(
            i.alias("window"), w["from"].alias("from"), w["start"].alias("start"), F.coalesce(F.get(s, i + 1)["start"], F.size(t)).alias("end"))))

    def cut(bound: Column) -> Column:
        """The turns of each window: the first window's system turns are new, later ones repeat them."""
        t, sys = bound["t"], bound["sys"]
        return F.transform(windows(bound), lambda w: F.struct(
            w["window"].alias("window"),
            F.when(w["window"] == 0, F.lit(0)).otherwise(sys + w["start"] - w["from"]).alias("n_masked"),
            F.concat(F.slice(t, F.lit(1), sys), F.slice(t, w["from"] + 1, w["end"] - w["from"])).alias("turns"),
        ))

    rows = convs.select("conv_id", F.explode(let(F.struct("t", "sys"), cut)).alias("w")).select("conv_id", "w.*")
    piece = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT), escape(x["text"]), F.lit(END))
    rows = rows.select(
        "conv_id", "window", "n_masked", "turns",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.length(escape(x["role"])).alias("role_len"), F.length(escape(x["text"])).alias("text_len"))).alias("sizes"),
    )
    fixed = len(TURN) + len(TEXT) + len(END)
    spans_zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def span(masked: Column):
        def step(a: Column, x: Column) -> Column:
            here = F.struct((a["at"] + len(TURN) + len(TEXT) + x["role_len"]).alias("start"), x["text_len"].alias("length"))
            out = F.when((x["role"] == "assistant") & (a["i"] >= masked), F.array_append(a["out"], here)).otherwise(a["out"])
            return F.struct((a["i"] + 1).alias("i"), (a["at"] + fixed + x["role_len"] + x["text_len"]).alias("at"), out.alias("out"))

        return step

    loss = F.aggregate("sizes", spans_zero, span(F.col("n_masked")))["out"]
    return rows.select(
        "conv_id", F.col("window").cast("long").alias("window"), "formatted", F.col("n_masked").cast("long").alias("n_masked"),
        (F.size("turns") - F.col("n_masked")).cast("long").alias("n_new"), loss.alias("loss"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: conv_id, turns (array of role, text: every turn once), loss_texts, formatted_chars, n_windows.

    A window's turns are parsed from its formatted text; the masked ones, which repeat earlier windows, are left out.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.col("n_masked").cast("int") + 2, F.col("n_new").cast("int"))

    def turn(p: Column) -> Column:
        return let(F.instr(p, TEXT), lambda at: F.struct(
            unescape(F.substring(p, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(p, at + len(TEXT), F.length(p) - at + 1 - len(TEXT) - len(END))).alias("text")))

    texts = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    parsed = windows.select("conv_id", F.struct(F.col("window").alias("window"), F.transform(pieces, turn).alias("turns"), texts.alias("texts")).alias("w"), F.length("formatted").alias("chars"))
    convs = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    return convs.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.texts")).alias("loss_texts"), "formatted_chars", "n_windows")


def digests(convs: DataFrame) -> DataFrame:
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), F.col("n_windows").cast("long").alias("n_windows"),
    )
