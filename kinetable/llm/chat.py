"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes ``<turn ROLE>TEXT</turn>`` and a newline. Inside role and text ``&``, ``<`` and ``>``
are written as character references, so no text can look like a mark, and reading back undoes it.

Prefix sums of the turns' tokens choose the windows. The room of a window is the budget less the
system turn and the history. Turns that lie wholly inside one multiple of the room share a window;
a turn that crosses a multiple has a window of its own. So a window's fresh turns never exceed the
room unless a single turn does, and no turn waits for the windows before it. Every window starts
with the conversation's system turn and repeats the last turns before it as far as the history
allows. Repeated turns are masked: an assistant turn is a target in one window only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.plans.segments import bounded, number_rows

CLOSE = "</turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def token_estimate(segment: Column) -> Column:
    """Tokens of a formatted turn: one for every four bytes, rounded up."""
    return F.ceil(F.octet_length(segment) / 4).cast("long")


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
    budget: int = 1024, history: int = 256, history_turns: int = 2, system: str = "system", target: str = "assistant",
) -> DataFrame:
    """One row per window: conv_id, window, text, members, targets, n_tokens, over_budget.

    ``members`` has for each turn in the text, in order, its place in the conversation and whether
    it is fresh here; ``targets`` has place, start and length (code points in ``text``) of each
    fresh turn of the ``target`` role, the loss mask. Turns are ordered by turn, then role and text;
    null roles and texts count as empty. Repeated rows are turns of their own. The first turn of
    the ``system`` role is the one retained. Rows without a conv_id form one conversation. A window
    is over_budget when one turn with its system turn and history exceeds it. An empty table gives
    an empty one; other columns are not read.
    """
    if budget <= history:
        raise ValueError("the budget must exceed the history")
    said, spoken = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), spoken.alias("role"), said.alias("body"))
    rows = rows.withColumn("head", F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"))).withColumn("body", escaped(F.col("body")))
    rows = rows.withColumn("cost", token_estimate(F.concat("head", "body", F.lit(CLOSE))))
    placed = number_rows(rows, ["conv"], ["turn", "role", "body"], "pos", sums={"upto": "cost"})
    lead = placed.where(F.col("role") == system).groupBy(F.col("conv").alias("of")).agg(F.min(F.struct("pos", "cost")).alias("first"))
    lead = lead.select("of", F.col("first.pos").alias("sys_pos"), F.col("first.cost").alias("sys_cost"))
    placed = placed.join(lead, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    sys_cost = F.coalesce("sys_cost", F.lit(0))
    is_system = F.coalesce(F.col("pos") == F.col("sys_pos"), F.lit(False))
    room = F.greatest(F.lit(1), F.lit(budget - history) - sys_cost)
    before = F.col("upto") - F.col("cost") - F.when(F.col("pos") > F.col("sys_pos"), sys_cost).otherwise(F.lit(0))
    placed = placed.withColumns({"is_system": is_system, "room": room, "before": before})
    step = F.floor(F.col("before") / F.col("room"))
    crosses = F.col("before") + F.col("cost") > (step + 1) * F.col("room")
    placed = placed.withColumn("window", F.when(~F.col("is_system"), 2 * step + F.when(crosses, 1).otherwise(0)))

    def ahead(window) -> dict[str, Column]:
        parts = []
        for j in range(1, history_turns + 1):
            at = F.lead("window", j).over(window)
            previous = F.lead("window", j - 1).over(window) if j > 1 else F.col("window")
            begins = at.isNotNull() & (previous.isNull() | (at != previous)) & (at != F.col("window"))
            near = F.lead("before", j).over(window) - F.col("before") <= history
            parts.append(F.when(begins & near, at))
        return {"again": F.array_distinct(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<long>")}

    placed = bounded(placed, ["conv"], "pos", 0, history_turns, ahead)
    keep = ["conv", "pos", "role", "head", "body", "cost"]
    ordinary = placed.where(~F.col("is_system"))
    fresh = ordinary.select(*keep, "window", F.lit(True).alias("fresh"))
    repeated = ordinary.select(*keep, F.explode("again").alias("window"), F.lit(False).alias("fresh"))
    windows = ordinary.select("conv", "window").distinct()
    first = windows.groupBy(F.col("conv").alias("of")).agg(F.min("window").alias("first"))
    systems = placed.where("is_system").select(*keep)
    systems = systems.join(first, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    opening = systems.select(*keep, F.coalesce("first", F.lit(0)).alias("window"), F.lit(True).alias("fresh"))
    later = windows.withColumnRenamed("conv", "of").join(systems, F.col("conv").eqNullSafe(F.col("of")) & (F.col("window") > F.col("first")))
    later = later.select(*keep, "window", F.lit(False).alias("fresh"))
    everyone = fresh.unionByName(repeated).unionByName(opening).unionByName(later)
    learnt = F.col("fresh") & (F.col("role") == target)
    member = F.struct("pos", "fresh", learnt.alias("learnt"), "head", "body", "cost")
    gathered = everyone.groupBy("conv", "window").agg(F.array_sort(F.collect_list(member)).alias("turns"))
    size = "length(m.head) + length(m.body) + length('</turn>\\n')"
    targets = F.expr(
        "aggregate(turns, named_struct('at', 0, 'spans', cast(array() as array<struct<turn: bigint, start: int, length: int>>)), (a, m) -> "
        f"named_struct('at', a.at + {size}, 'spans', if(m.learnt, concat(a.spans, array(named_struct('turn', m.pos, 'start', a.at + length(m.head), 'length', length(m.body)))), a.spans)), a -> a.spans)")
    return gathered.select(
        F.col("conv").alias(conv_id), "window",
        F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))), "").alias("text"),
        F.transform("turns", lambda m: F.struct(m["pos"].alias("turn"), m["fresh"].alias("fresh"))).alias("members"),
        targets.alias("targets"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, m: a + m["cost"]).alias("n_tokens"),
    ).withColumn("over_budget", F.col("n_tokens") > budget)


def read_turns(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The turns and targets of each window, read back from its text and masks.

    Adds ``turns`` (place, role, text of fresh turns) and ``learnt`` (place, text under the loss mask).
    """
    pieces = F.slice(F.split("text", CLOSE), F.lit(1), F.size("members"))
    both = F.arrays_zip(pieces.alias("piece"), F.col("members").alias("member"))
    fresh = F.filter(both, lambda b: b["member"]["fresh"])

    def read(b: Column) -> Column:
        close = F.instr(b["piece"], ">")
        role = F.substring(b["piece"], F.lit(7), close - 7)
        body = F.substring(b["piece"], close + 1, F.length(b["piece"]))
        return F.struct(b["member"]["turn"].alias("turn"), unescaped(role).alias("role"), unescaped(body).alias("text"))

    masked = F.transform("targets", lambda t: F.struct(t["turn"].alias("turn"), unescaped(F.substring("text", t["start"] + 1, t["length"])).alias("text")))
    return windows.withColumn("turns", F.transform(fresh, read)).withColumn("learnt", masked)


def chat_digest(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is over one conversation's text, so that text meets in one row.
    """
    read = read_turns(windows, conv_id)
    whole = read.groupBy(conv_id).agg(
        F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"), F.array_sort(F.flatten(F.collect_list("learnt"))).alias("learnt"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("learnt", lambda t: t["text"]), "")
    return whole.select(
        conv_id, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
