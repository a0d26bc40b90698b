"""What a user's session does step by step: a growing citation graph, and filters that a panel or a chat owns."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import top_per_group

#: Nodes that a step adds at most, and nodes that are shown at most.
A_STEP, SHOWN = 6, 100


def growing_graph(steps: DataFrame, start: DataFrame, inside: DataFrame, outside: DataFrame, k: int = A_STEP, most: int = SHOWN) -> DataFrame:
    """session, step, node, added (ids, own papers first), more (neighbours are left), capped (the limit on shown nodes kept some away).

    steps: session, step, node in order; start: session, node (shown at first); inside and outside: src, dst, year, title, own and external
    neighbours. A step adds the first k neighbours of its node that are not shown yet, own ones first, while fewer than `most` are shown.
    As at most `most` nodes can be in the way, a node's first most + k neighbours decide, and whether there are more; a session folds
    over these, so a task holds one session's steps with a bounded list each."""
    reach = most + k
    x = inside.select("src", "dst", "year", "title", F.lit(0).alias("o")).unionByName(outside.select("src", "dst", "year", "title", F.lit(1).alias("o")))
    x = x.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("o", -F.col("year"), "title", "year")).alias("b"))
    asked = steps.select(F.col("node").alias("src")).distinct()
    x = x.join(asked, "src", "left_semi").select("src", "dst", "b.o", "b.year", "b.title")
    x = top_per_group(x, ["src"], ["o", F.col("year").desc_nulls_last(), "title", "dst"], reach + 1)
    near = x.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("o", F.coalesce(-F.col("year"), F.lit(1 << 30)).alias("y"), "title", "dst"))).alias("a"))
    near = near.select(F.col("src").alias("node"), F.transform("a", lambda s: s["dst"]).alias("near"))
    rows = steps.select("session", "step", "node").join(near, "node", "left").join(start.groupBy("session").agg(F.collect_set("node").alias("shown")), "session", "left")
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["step", "node"])
        first = pdf["shown"].iloc[0]
        shown, out = set(first.tolist() if first is not None else []), []
        for r in pdf.itertuples(index=False):
            shown.add(r.node)
            near = r.near.tolist() if r.near is not None else []
            room = most - len(shown)
            if room <= 0:
                out.append((r.session, r.step, r.node, [], True, True))
                continue
            left = [n for n in near if n not in shown]
            added = left[: min(k, room)]
            more = len(left) > len(added) or len(near) > reach
            out.append((r.session, r.step, r.node, added, more, room < k and more))
            shown.update(added)
        return pd.DataFrame(out, columns=["session", "step", "node", "added", "more", "capped"])

    return rows.groupBy("session").applyInPandas(fold, f"session {kinds['session']}, step {kinds['step']}, node {kinds['node']}, added array<{kinds['node']}>, more boolean, capped boolean")


def owned_filters(turns: DataFrame, fields: tuple[str, ...] = ("paper_type", "kci_only", "sci_only")) -> DataFrame:
    """conv_id, turn, the filters in force after it and owned: the fields that the panel owns, in order of name.

    Rows conv_id, turn, panel (whether the panel sent it, else the chat), touched (fields that the panel sent), year_start, year_end and the fields.
    The panel sets what it sends and owns it then; an empty value of its clears a field only if it owns it. A value by the chat takes a field over. The
    two years are one. So a field is the panel's if the last row that named it set it from the panel, which a window tells."""
    from .filters import normal_years

    start, end = normal_years(F.col("year_start"), F.col("year_end"))
    by_panel, sent = F.coalesce("panel", F.lit(False)), lambda f: F.array_contains(F.coalesce("touched", F.array().cast("array<string>")), f)
    none = F.lit(None).cast("int")
    pair = F.when(by_panel & ~sent("year_end"), F.struct(F.col("year_start").alias("a"), F.col("year_start").alias("b"))).otherwise(F.struct(start.alias("a"), end.alias("b")))
    given = F.col("year_start").isNotNull() | F.col("year_end").isNotNull()
    filled = F.when(by_panel & ~sent("year_end"), F.col("year_start").isNotNull()).otherwise(given)
    plans = {"years": (by_panel & (sent("year_start") | sent("year_end")), filled, ~by_panel & given, pair, F.struct(none.alias("a"), none.alias("b")))}
    for f in fields:
        kind = turns.schema[f].dataType.simpleString()
        some = F.coalesce(F.col(f).cast("boolean"), F.lit(False)) if kind == "boolean" else F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        plans[f] = (by_panel & sent(f), some, ~by_panel & F.col(f).isNotNull(), F.struct(F.col(f).alias("a")), F.struct(F.col(f).alias("a")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns
    for f, (panel, some, chat, value, cleared) in plans.items():
        mine: Column = F.when(panel, some).when(chat, F.lit(False))  # NULL: the row does not name the field
        d = d.withColumn(f"__own_{f}", F.coalesce(F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
        before = F.coalesce(F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        d = d.withColumn(f"__set_{f}", F.when(chat | (panel & some), value).when(panel & before, cleared))
        d = d.withColumn(f"__val_{f}", F.last(f"__set_{f}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = {"years": ["year_end", "year_start"]} | {f: [f] for f in fields}
    owned = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"__own_{f}"), F.lit(n)) for f, ns in names.items() for n in ns])))
    return d.select("conv_id", "turn", F.col("__val_years.a").alias("year_start"), F.col("__val_years.b").alias("year_end"), *[F.col(f"__val_{f}.a").alias(f) for f in fields], owned.alias("owned"))
