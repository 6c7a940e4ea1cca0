"""Scores of what a machine read against what people confirmed. Counts are summed before rates are taken; an undefined rate is null.

Defined results: empty tables give no rows; a page without a counterpart has only missed or only extra objects; repeated rows of edge
and relation sets count once; nulls in a compared text are empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph, relational as R

HARD = 0.9  # F1 under which a drawing is hard

# The words by which a correspondence table judges a relation.
NOT_CONNECTED = ["非接続", "交差", "誤り", "×", "ng", "なし"]
UNKNOWN = ["不明", "要確認", "?", "判定不能", "参照先欠落", "未解決"]


def outcomes(gold: DataFrame, found: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """by, g, gold_class, f, found_class: each object once, matched ones together, the others with nulls on one side.
    gold: by, g, gold_class; found: by, f, found_class; matches: by, g, f (one to one)."""
    placed = found.select(*by, "f", "found_class").join(matches.select(*by, "g", "f"), [*by, "f"], "left")
    return placed.join(gold.select(*by, "g", "gold_class"), [*by, "g"], "full")


def class_scores(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, class_key, tp, fp, fn, precision, recall of outcomes(): a wrong class is an extra of one class and a miss of the other."""
    same = F.col("gold_class") == F.col("found_class")
    count = lambda c, tp, fp, fn: F.struct(F.col(c).alias("class_key"), *[F.lit(x).alias(n) for x, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    parts = F.array_compact(F.array(
        F.when(same, count("gold_class", 1, 0, 0)),
        F.when(F.col("found_class").isNotNull() & ~F.coalesce(same, F.lit(False)), count("found_class", 0, 1, 0)),
        F.when(F.col("gold_class").isNotNull() & ~F.coalesce(same, F.lit(False)), count("gold_class", 0, 0, 1)),
    ))
    counts = rows.select(*by, F.explode(parts).alias("x")).groupBy(*by, "x.class_key").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")])
    precision, recall, _ = R.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*by, "class_key", "tp", "fp", "fn", precision, recall)


def confusion(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, gold, found, n of outcomes(): missed objects have found `(missed)`, extra ones gold `(extra)`."""
    gold, found = F.coalesce("gold_class", F.lit("(extra)")).alias("gold"), F.coalesce("found_class", F.lit("(missed)")).alias("found")
    return rows.groupBy(*by, gold, found).agg(F.count(F.lit(1)).alias("n"))


def review_summary(found: DataFrame, saved: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """by, imported, kept, relabeled, deleted, manual_added. found: by, f, found_class; saved: by, g, gold_class, origin; matches: by, g, f.
    Deletions count only where something was imported; additions are manual objects that match nothing."""
    rows = outcomes(saved, found, matches, by).join(saved.select(*by, "g", "origin"), [*by, "g"], "left")
    both = F.col("gold_class").isNotNull() & F.col("found_class").isNotNull()
    imported = F.coalesce(F.bool_or(F.col("origin") == "inference"), F.lit(False))
    return rows.groupBy(*by).agg(
        imported.alias("imported"), F.count_if(both & (F.col("gold_class") == F.col("found_class"))).alias("kept"),
        F.count_if(both & (F.col("gold_class") != F.col("found_class"))).alias("relabeled"),
        F.when(imported, F.count_if(F.col("gold_class").isNull())).otherwise(F.lit(0)).cast("long").alias("deleted"),
        F.count_if(F.col("found_class").isNull() & (F.col("origin") == "manual")).alias("manual_added"),
    )


def drawing_scores(rows: DataFrame, by: list[str], hard: float = HARD) -> DataFrame:
    """by, f1, ai_count, gold_count, missed, false_detections, relabeled, hard of the drawings that have objects on both sides."""
    counts = rows.groupBy(*by).agg(
        F.count("found_class").alias("ai_count"), F.count("gold_class").alias("gold_count"), F.count_if(F.col("gold_class") == F.col("found_class")).alias("kept"),
        F.count_if(F.col("gold_class") != F.col("found_class")).alias("relabeled"),
    ).filter("ai_count > 0 AND gold_count > 0")
    matched, f1 = F.col("kept") + F.col("relabeled"), 2 * F.col("kept") / (F.col("ai_count") + F.col("gold_count"))
    return counts.select(
        *by, F.round(f1, 4).alias("f1"), "ai_count", "gold_count", (F.col("gold_count") - matched).alias("missed"), (F.col("ai_count") - matched).alias("false_detections"),
        "relabeled", (f1 < hard).alias("hard"),
    )


def label_scores(pairs: DataFrame, by: list[str], gold: str, found: str) -> DataFrame:
    """by, total, label_ok, device_ok and their rates over matched pairs whose gold label is not empty: the whole label, its first word."""
    plain = lambda c: text.compact(F.coalesce(F.col(c), F.lit("")))
    first = lambda c: text.compact(F.coalesce(F.try_element_at(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), F.lit(1)), F.lit("")))
    rows = pairs.filter(plain(gold) != "")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(plain(gold) == plain(found)).alias("label_ok"), F.count_if((first(gold) == first(found)) & (first(found) != "")).alias("device_ok"),
    )
    return counts.select("*", *[F.round(F.col(c) / F.col("total"), 4).alias(c.replace("_ok", "_rate")) for c in ("label_ok", "device_ok")])


def edge_scores(gold: DataFrame, found: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, wrong_connections, route_differences, unmatched_ends.
    gold, found: by, a, b (undirected); mapping: by, f, g from found ends to gold ends. Extra edges inside one gold component are
    other routes, those between two are wrong connections; a found edge with an end that maps nowhere, or both to one, is an extra."""
    ends = gold.select(*by, F.explode(F.array(F.least("a", "b"), F.greatest("a", "b"))).alias("node")).distinct()
    wires = graph.cut_lineage(R.undirected(gold, "a", "b", by))
    # Components go by numbers, not by names, of which every round moves two for each edge.
    ends = graph.cut_lineage(R.numbered(ends, [], [F.col(c) for c in (*by, "node")], "k"))
    number = lambda s: ends.select(*by, F.col("node").alias(s), F.col("k").alias(f"k{s}"))
    net = graph.connected_components(wires.join(number("a"), [*by, "a"]).join(number("b"), [*by, "b"]).select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    of = ends.join(net.select(F.col("node").alias("k"), "component"), "k", "left").select(*by, "node", F.coalesce("component", "k").alias("net"))
    side = lambda s: mapping.select(*by, F.col("f").alias(s), F.col("g").alias(f"g{s}"))
    placed = R.undirected(found, "a", "b", by).join(side("a"), [*by, "a"], "left").join(side("b"), [*by, "b"], "left")
    lost = F.col("ga").isNull() | F.col("gb").isNull() | (F.col("ga") == F.col("gb"))
    mapped = placed.filter(~lost).select(*by, F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    both = mapped.withColumn("f", F.lit(1)).join(wires.withColumn("g", F.lit(1)), [*by, "a", "b"], "full")
    named = lambda s: of.select(*by, F.col("node").alias(s), F.col("net").alias(f"n{s}"))
    both = both.join(named("a"), [*by, "a"], "left").join(named("b"), [*by, "b"], "left")
    extra = F.col("g").isNull()
    apart = ~F.coalesce(F.col("na") == F.col("nb"), F.lit(False))
    counts = both.groupBy(*by).agg(
        F.count_if(F.col("f").isNotNull() & ~extra).alias("tp"), F.count_if(extra).alias("extra"), F.count_if(F.col("f").isNull()).alias("fn"), F.count_if(extra & apart).alias("wrong_connections"),
    )
    lost_ends = placed.groupBy(*by).agg(F.count_if(lost).alias("unmatched_ends"))
    total = counts.join(lost_ends, by, "full").na.fill(0).withColumn("fp", F.col("extra") + F.col("unmatched_ends"))
    precision, recall, _ = R.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select(*by, "tp", "fp", "fn", precision, recall, "wrong_connections", (F.col("extra") - F.col("wrong_connections")).alias("route_differences"), "unmatched_ends")


def corrections(rows: DataFrame, labels: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, corrections: what a person has to mend: extra and missed objects, changed classes, labels, extra and missing wires."""
    parts = rows.select(*by, (~F.coalesce(F.col("gold_class") == F.col("found_class"), F.lit(False))).cast("long").alias("n"))
    parts = parts.unionByName(labels.select(*by, (F.col("total") - F.col("label_ok")).alias("n"))).unionByName(edges.select(*by, (F.col("fp") + F.col("fn")).alias("n")))
    return parts.groupBy(*by).agg(F.sum("n").alias("corrections"))


def leakage(sets: DataFrame, train: DataFrame, by: str, page: str) -> DataFrame:
    """by, pages (sorted), n: the pages of evaluation sets that training has used, whatever the writing of their names."""
    used = train.select(text.compact(F.col(page)).alias("k__")).filter("k__ <> ''").distinct()
    rows = sets.withColumn("k__", text.compact(F.col(page))).join(used, "k__", "left_semi")
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(page)).alias("pages"), F.count_distinct(page).alias("n"))


def judged(word: Column) -> Column:
    """yes, no or unknown."""
    w = F.trim(F.coalesce(word, F.lit("")))
    return F.when(w.isin(*NOT_CONNECTED), "no").when(w.isin(*UNKNOWN) | (w.contains("要確認") & ~w.contains("接続")), "unknown").otherwise("yes")


def relation_scores(gold: DataFrame, machine: DataFrame, kind: str, a: str, b: str, judgement: str, shown: int = 50) -> DataFrame:
    """Relations of two tables, for each kind: gold, machine, tp, fp, fn, wrong_connections, precision, recall, missed and extra (the first
    of them). Ends have no order; what gold does not know does not count; the last row of a repeated pair (by judgement) holds."""
    def pairs(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(F.coalesce(F.col(b), F.lit("")) != "")
        return rows.groupBy(F.col(kind).alias("kind"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(judged(F.col(judgement))).alias(name))

    both = pairs(gold, "g").join(pairs(machine, "m").filter("m <> 'no'"), ["kind", "a", "b"], "full")
    said, there = F.col("m").isNotNull(), F.coalesce(F.col("g"), F.lit("none"))
    tp, fp, fn = said & (there == "yes"), said & there.isin("no", "none"), ~said & (there == "yes")
    listed = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.concat_ws(" <-> ", "a", "b")))), 1, shown)
    counts = both.groupBy("kind").agg(
        F.count_if(there == "yes").alias("gold"), F.count_if(said).alias("machine"), *[F.count_if(c).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))],
        F.count_if(said & (there == "no")).alias("wrong_connections"), listed(fn).alias("missed"), listed(fp).alias("extra"),
    )
    precision, recall, _ = R.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("kind", "gold", "machine", "tp", "fp", "fn", "wrong_connections", precision, recall, "missed", "extra")


def adoption(total: DataFrame, classes: DataFrame, by: list[str], tolerance: float = 0.005, drop: float = 0.05, least: int = 5) -> DataFrame:
    """by, verdict, fallen (classes that fell). total: by, baseline, candidate, mode; classes: by, class_key, baseline, candidate, instances.
    unknown without both totals; hold if the total falls beyond the tolerance or a class with enough instances beyond `drop`; caution
    if not measured on a holdout; else adopt."""
    fell = (F.col("instances") >= least) & (F.round(F.col("baseline") - F.col("candidate"), 9) > drop)
    fallen = classes.filter(fell).groupBy(*by).agg(F.array_sort(F.collect_list("class_key")).alias("fallen"))
    rows = total.join(fallen, by, "left").withColumn("fallen", F.coalesce("fallen", F.array().cast("array<string>")))
    verdict = (
        F.when(F.col("baseline").isNull() | F.col("candidate").isNull(), "unknown")
        .when((F.round(F.col("candidate") - F.col("baseline"), 9) < -tolerance) | (F.size("fallen") > 0), "hold")
        .when(~F.col("mode").eqNullSafe(F.lit("holdout")), "caution").otherwise("adopt")
    )
    return rows.select(*by, verdict.alias("verdict"), "fallen")


def worse(now: DataFrame, base: DataFrame, lower: list[str], tolerance: float = 0.005, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, metric, baseline, now of the metrics that got worse than a baseline; those whose name starts with one of `lower` are better low."""
    low = F.lit(False)
    for name in lower:
        low = low | F.substring_index("metric", ".", -1).startswith(name)
    rows = base.select(*by, "metric", F.col("value").alias("baseline")).join(now.select(*by, "metric", F.col("value").alias("now")), [*by, "metric"])
    step = F.round(F.col("now") - F.col("baseline"), 9)
    return rows.filter(F.when(low, step > tolerance).otherwise(step < -tolerance)).select(*by, "metric", "baseline", "now")


def gate(counts: DataFrame, by: list[str], min_recall: float, min_precision: float, expected: Column) -> DataFrame:
    """by, passed, reasons, required_hit, recall, precision. counts: by, errors, hit, gold, judged, wrong."""
    required = F.ceil(expected * min_recall - 1e-12)
    recall, precision = F.try_divide("hit", "gold"), F.try_divide(F.col("judged") - F.col("wrong"), "judged")
    reasons = F.array_compact(F.array(
        F.when(F.col("errors") != 0, "evaluation_errors"), F.when(F.col("gold") != expected, "unexpected_gold_count"),
        F.when(recall.isNull() | (F.col("hit") < required), "recall_below_target"), F.when(precision.isNull() | (precision < min_precision), "precision_below_target"),
    ))
    return counts.select(*by, (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), required.alias("required_hit"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


def clique_pairs(members: DataFrame, net: str, member: str) -> DataFrame:
    """net, a, b: all unordered pairs of each net's distinct members. Nets are small by nature (the ends of one wire net)."""
    m = members.select(net, member).distinct()
    return m.select(net, F.col(member).alias("a")).join(m.select(net, F.col(member).alias("b")), net).filter("a < b")


def partitions_equal(left: DataFrame, right: DataFrame, by: list[str], net: str, member: str) -> DataFrame:
    """by, equal, left_only, right_only: whether two partitions of members into nets are the same, and how many nets are not shared."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by, net).agg(F.array_sort(F.collect_set(member)).alias("block")).select(*by, "block").distinct().withColumn(name, F.lit(1))

    both = blocks(left, "l").join(blocks(right, "r"), [*by, "block"], "full")
    out = both.groupBy(*by).agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return out.select(*by, ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"), "left_only", "right_only")


def same_net_or_apart(extra: DataFrame, nets: DataFrame, by: list[str], node: str, net: str) -> DataFrame:
    """Marks extra pairs (by, a, b): `same component` if gold has both ends on one net, else `hard`."""
    of = lambda s: nets.select(*by, F.col(node).alias(s), F.col(net).alias(f"n{s}"))
    rows = extra.join(of("a"), [*by, "a"], "left").join(of("b"), [*by, "b"], "left")
    return rows.select(*by, "a", "b", F.when(F.col("na") == F.col("nb"), "same component").otherwise("hard").alias("how"))


def node_scores(gold: DataFrame, found: DataFrame, wires: DataFrame, by: list[str]) -> DataFrame:
    """by, wires, hit, wrong: gold wires (by, a, b) whose ends lie on one found node; found nodes that join ends of several gold nodes.
    gold, found: by, member, node."""
    of = lambda s: found.select(*by, F.col("member").alias(s), F.col("node").alias(f"n{s}"))
    hit = wires.join(of("a"), [*by, "a"], "left").join(of("b"), [*by, "b"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("wires"), F.count_if(F.col("na") == F.col("nb")).alias("hit"))
    mixed = found.join(gold.select(*by, "member", F.col("node").alias("gold_node")), [*by, "member"]).groupBy(*by, "node").agg(F.count_distinct("gold_node").alias("n"))
    wrong = mixed.groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("wrong"))
    return hit.join(wrong, by, "left").withColumn("wrong", F.coalesce("wrong", F.lit(0).cast("long")))


def miss_reasons(wires: DataFrame, symbols: DataFrame, terminals: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """wires (by, a, b, a_symbol, b_symbol) that are not there, and why: an end's symbol is not matched, its terminal not mapped, or the
    nodes differ. symbols: by, symbol (matched); terminals: by, end, mapped; nodes: by, mapped, node."""
    def side(df: DataFrame, s: str) -> DataFrame:
        df = df.join(symbols.select(*by, F.col("symbol").alias(f"{s}_symbol")).distinct().withColumn(f"{s}_there", F.lit(1)), [*by, f"{s}_symbol"], "left")
        end = terminals.join(nodes, [*by, "mapped"], "left").select(*by, F.col("end").alias(s), F.col("mapped").alias(f"{s}_mapped"), F.col("node").alias(f"{s}_node"))
        return df.join(end, [*by, s], "left")

    rows = side(side(wires, "a"), "b")
    reason = (
        F.when(F.col("a_there").isNull() | F.col("b_there").isNull(), "unmatched symbol").when(F.col("a_mapped").isNull() | F.col("b_mapped").isNull(), "unmapped terminal")
        .when(~F.coalesce(F.col("a_node") == F.col("b_node"), F.lit(False)), "different nodes")
    )
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select(*by, "a", "b", "reason")


def pass_counts(results: DataFrame, by: list[str], check: str, ok: str) -> DataFrame:
    """by, check, passed, total."""
    return results.groupBy(*by, check).agg(F.count_if(F.col(ok)).alias("passed"), F.count(F.lit(1)).alias("total"))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: evidence lists, the largest boxes of a page."""
    return rows.withColumn("nth__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("nth__") <= n).drop("nth__")
