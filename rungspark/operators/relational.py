"""Joins, groupings and set operations that the list, statistics and comparison queries are made of.

Defined results: empty tables give empty results (counts of children are 0, not null); null keys join nothing and null values are no values; ties go to the lesser key;
repeated rows count each where rows are counted, and once where sets are compared; further columns stay or are ignored as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def with_counts(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Column | None]]) -> DataFrame:
    """Adds a count column for each child table (frame, its key, filter), 0 where there is none. Children are counted before the join, never joined together."""
    for name, (child, child_key, keep) in children.items():
        rows = child if keep is None else child.filter(keep)
        counted = rows.groupBy(F.col(child_key).alias(f"{name}__key")).agg(F.count(F.lit(1)).alias(name))
        parent = parent.join(counted, F.col(key) == F.col(f"{name}__key"), "left").drop(f"{name}__key").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def matching(df: DataFrame, query: str, id_col: str, *text_cols: str) -> DataFrame:
    """All digits: the row of that id; else rows whose texts hold the query, whatever the case; an empty query keeps all."""
    query = query.strip()
    if not query:
        return df
    if query.isdigit():
        return df.filter(F.col(id_col) == int(query))
    pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    keep = F.lit(False)
    for c in text_cols:
        keep = keep | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return df.filter(keep)


def single_or_null(value: Column) -> Column:
    """Aggregate: the value if the group has one distinct value, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def latest(value: Column, order: Column, keep: Column) -> Column:
    """Aggregate: the value of the greatest `order` among rows that `keep`."""
    return F.max_by(F.when(keep, value), F.when(keep, order))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def page_with_pending(df: DataFrame, order: list[Column], size: int, pending: Column) -> DataFrame:
    """The first `size` rows in order and all pending rows beyond them."""
    first = df.orderBy(*order).limit(size)
    return first.unionByName(df.filter(pending).exceptAll(first.filter(pending)))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the fields that differ; nulls are equal to each other."""
    a, b = old.select(F.col(key).alias("k_old"), F.struct(*fields).alias("o")), new.select(F.col(key).alias("k_new"), F.struct(*fields).alias("n"))
    both = a.join(b, F.col("k_old") == F.col("k_new"), "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("k_old").isNull(), "added").when(F.col("k_new").isNull(), "removed").when(F.size(differs) > 0, "changed")
    out = both.select(F.coalesce("k_old", "k_new").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(differs, ",")).otherwise("").alias("fields"))
    return out.filter("change IS NOT NULL")


def undirected(edges: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct edges with their ends in order, without loops."""
    return edges.filter(F.col(a) != F.col(b)).select(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1 to 4 places, null where undefined."""
    part = lambda x, n: F.round(x / F.nullif(n, F.lit(0)), 4)
    return [part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1")]


def set_score(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """tp, fp, fn, precision, recall, f1 of two sets of rows, for each value of `by`."""
    # Marked rows are gathered once, repeated ones too.
    marked = gold.select(*keys).withColumn("g", F.lit(1)).unionByName(found.select(*keys).withColumn("f", F.lit(1)), allowMissingColumns=True)
    rows = graph.dealt(marked, keys).groupBy(*keys).agg(F.max("g").alias("g"), F.max("f").alias("f"))
    counts = rows.groupBy(*by).agg(
        F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    return counts.select(*by, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def conflicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Where the relation between a and b is not one to one: side, key, number of partners, the partner seen least (the first of several)."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    side = lambda k, v: counts.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("partners"), F.min_by(v, F.struct("n", v)).alias("minority")).filter("partners > 1").select(F.lit(k).alias("side"), "key", "partners", "minority")
    return side(a, b).unionByName(side(b, a))


def near_strings(df: DataFrame, col: str) -> DataFrame:
    """Pairs of distinct strings at edit distance one. Strings meet by the string itself and by its forms with one character left out,
    an equi-join: two strings that differ in one place share such a form, and only one, so no pair comes twice (what can be left out
    elsewhere with the same result lies in a run of one character and leaves the same form)."""
    words = df.select(F.col(col).alias("w")).filter(F.col("w").isNotNull()).distinct()
    forms = F.concat(F.array("w"), F.transform(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w")))))
    keyed = words.select("w", F.explode(F.array_distinct(forms)).alias("form"))
    # Spread words are many more than the words that Spark judges them by: shuffled, never sent to every task.
    keyed = keyed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "form")
    pairs = keyed.select(F.col("w").alias("a"), "form").hint("merge").join(keyed.select(F.col("w").alias("b"), "form").hint("merge"), "form").filter("a < b")
    return pairs.filter(F.levenshtein("a", "b") == 1).select("a", "b")


def corrected(counts: DataFrame, confusable: tuple[str, str] = ("OQIB", "0018")) -> DataFrame:
    """word, n -> word, replacement: a word seen at least max(2, 2 n) times that differs in confusable characters only; the most frequent, then the first."""
    keyed = counts.select("word", "n", F.translate("word", *confusable).alias("class"))
    other = keyed.select(F.col("word").alias("other"), F.col("n").alias("m"), "class")
    pairs = keyed.join(other, "class").filter((F.col("word") != F.col("other")) & (F.col("m") >= F.greatest(F.lit(2), 2 * F.col("n"))))
    return pairs.groupBy("word", "n").agg(F.min_by("other", F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("replacement"))


def canonical_join(left: DataFrame, l_name: str, right: DataFrame, r_name: str, canon) -> DataFrame:
    """Joins names that are equal after canon(); left names without a partner go to the only right name they are a prefix of, if there is one."""
    a, b = left.withColumn("canon", canon(F.col(l_name))), right.withColumn("r_canon", canon(F.col(r_name)))
    exact = a.join(b, F.col("canon") == F.col("r_canon"))
    rest = a.join(b.select(F.col("r_canon").alias("canon")).distinct(), "canon", "left_anti")
    # The prefixes of the right names, at the lengths that left names have, make this an equi-join too.
    lengths = rest.select(F.length("canon").alias("len")).distinct()
    starts = b.join(F.broadcast(lengths), F.col("len") < F.length("r_canon")).withColumn("start", F.expr("substring(r_canon, 1, len)"))
    only = starts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("start"))).filter("n = 1").drop("n", "len")
    prefix = rest.join(only, F.col("canon") == F.col("start")).drop("start")
    return exact.withColumn("how", F.lit("exact")).unionByName(prefix.withColumn("how", F.lit("prefix")))


CROWD, SIEVE = 2000, 512  # sets that an element is in from which on the smallest sets are tried first, and how many of them at first
DEALS = 32  # into how many parts the sets that share a rarest element are dealt at most


def absorbed(sets: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """Sets that hold another one (or an equal one with a smaller id) go; an empty set is held by every other. A set is met only through its
    rarest element, so common elements make no pairs."""
    # Of equal sets only the first one goes on, so that copies make no pairs.
    each = sets.select(F.col(id_col).alias("i"), F.array_sort(F.array_distinct(set_col)).alias("s")).filter("s IS NOT NULL")
    # A bit for each element's hash: a set without one of the other's bits does not hold it. What passes is compared element by element.
    bits = F.aggregate("s", F.lit(0).cast("long"), lambda x, e: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(e), F.lit(64)).cast("int"))))
    items = graph.cut_lineage(each.groupBy("s").agg(F.min("i").alias("i")).withColumn("size", F.size("s")).withColumn("bits", bits))
    items = _sieved(items)
    spread = items.select("i", "size", "bits", F.explode("s").alias("e"))
    often = spread.groupBy("e").agg(F.count(F.lit(1)).alias("often"))
    # Only what stands in many sets is dealt into parts: of the others, copies for each part would be many times the table.
    spread = spread.join(often.withColumn("deals", F.least(F.lit(DEALS), F.floor(F.col("often") / CROWD).cast("int") + 1)), "e")
    rarest = spread.groupBy("i", "size", "bits").agg(F.min(F.struct("often", "e", "deals")).alias("m"))
    small = rarest.select(F.col("i").alias("j"), F.col("size").alias("n"), F.col("bits").alias("few"), "m.e", F.pmod(F.xxhash64("i"), F.col("m.deals")).cast("int").alias("deal"))
    large = spread.select("i", "size", "bits", "e", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    near = large.hint("merge").join(small.hint("merge"), ["e", "deal"]).filter((F.col("n") < F.col("size")) & (F.col("few").bitwiseAND(F.bitwise_not("bits")) == 0)).select("i", "j")
    near = near.join(items.select("i", "s"), "i").join(items.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    held = near.filter(F.size(F.array_except("t", "s")) == 0).select("i").distinct()
    # Of empty sets the one with the least id holds against all others.
    none = items.filter("size = 0").agg(F.min("i").alias("least"))
    left = items.join(held, "i", "left_anti").crossJoin(F.broadcast(none)).filter("least IS NULL OR i = least").select(F.col("i").alias(id_col))  # one row
    return sets.join(left, id_col, "left_semi").unionByName(sets.filter(F.col(set_col).isNull()))


def _sieved(items: DataFrame) -> DataFrame:
    """items without what holds one of the smallest sets, while elements are in many sets and it makes them fewer: what is left holds the same sets as before."""
    rows, few = items.count(), SIEVE
    while rows > few:
        often = items.select(F.explode("s").alias("e")).groupBy("e").agg(F.count(F.lit(1)).cast("double").alias("n"))
        if (often.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= CROWD:
            break
        first = items.orderBy("size", "i").limit(few).select(F.col("size").alias("n"), F.col("bits").alias("few"), F.col("s").alias("t"))
        holds = (F.col("n") < F.col("size")) & (F.col("few").bitwiseAND(F.bitwise_not("bits")) == 0) & (F.size(F.array_except("t", "s")) == 0)
        before, items = rows, graph.cut_lineage(items.join(F.broadcast(first), holds, "left_anti"))  # `few` sets
        rows, few = items.count(), 4 * few
        if rows > 0.9 * before:
            break
    return items


def shared_tokens(a: DataFrame, b: DataFrame, key: str, token: str) -> DataFrame:
    """key, shared: the size of the multiset intersection of tokens."""
    x, y = (d.groupBy(key, token).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, [key, token]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("shared"))


def free_numbers(wanted: DataFrame, used: DataFrame, col: str, order: list[Column]) -> DataFrame:
    """Gives each wanted row the next number, from 1, that is not used: the nth wanted row gets the nth free number. Both sides are numbered
    range by range (see numbered()); a wanted row meets only the gap that holds its number, found through coarse steps of the numbers."""
    taken = numbered(used.select(F.col(col).cast("long").alias("u")).filter("u >= 1").distinct(), [], [F.col("u")], "nth")
    # After the used number u, in its nth place, the free numbers are those from u + 1 - nth on, until the next used one.
    steps = taken.select((F.col("u") - F.col("nth")).alias("gap"), "nth").groupBy("gap").agg(F.max("nth").alias("before"))
    steps = numbered(steps, [], [F.col("gap")], "k")
    after = steps.select((F.col("k") - 1).alias("k"), F.col("gap").alias("upto"))
    spans = steps.join(after, "k", "left").select("gap", "before", "upto")
    nth = numbered(wanted, [], order, "nth__")
    last = nth.agg(F.max("nth__")).first()[0] or 0
    cell = max(1, last // 1000)
    cells = F.sequence(F.floor(F.col("gap") / cell), F.floor(F.coalesce(F.least("upto", F.lit(last)), F.lit(last)) / cell))
    spread = spans.filter(F.col("gap") < last).withColumn("cell__", F.explode(cells))
    here = (F.col("nth__") > F.col("gap")) & (F.col("upto").isNull() | (F.col("nth__") <= F.col("upto")))
    out = nth.withColumn("cell__", F.floor(F.col("nth__") / cell)).join(spread, "cell__", "left")
    out = out.filter(here | F.col("gap").isNull() | (F.col("nth__") <= F.col("gap")))
    names = [c for c in wanted.columns if c != col]
    return out.groupBy(*names, "nth__").agg(F.max(F.when(here, F.col("before"))).alias("before")).select(*names, (F.col("nth__") + F.coalesce("before", F.lit(0))).alias(col))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the row number in each group without sorting a group in one task: rows are dealt by range, counted in each range, and numbered
    from where the ranges before end. `order` should have no ties."""
    from .graph import cut_lineage

    keys = [F.col(c) for c in by]
    ranges = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("range__", F.spark_partition_id()))
    sizes = ranges.groupBy(*by, "range__").agg(F.count(F.lit(1)).alias("n__"))  # as many rows as ranges, and groups
    before = F.sum("n__").over(Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("range__").alias("r__"), F.coalesce(before, F.lit(0)).alias("start__"))
    inside = F.row_number().over(Window.partitionBy("range__", *by).orderBy(*order))
    same = F.col("range__") == F.col("r__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    out = ranges.withColumn("inside__", inside).join(starts, same)
    return out.withColumn(name, F.col("start__") + F.col("inside__")).select(*df.columns, name)


def prefix_merged(df: DataFrame, by: list[str], word: str, score: str) -> DataFrame:
    """Drops words that are another one of the group without its last character; that one takes the greater score."""
    longer = df.select(*by, F.col(word).alias("w__"), F.expr(f"substring({word}, 1, length({word}) - 1)").alias(word))
    short = df.join(longer.select(*by, word).distinct(), [*by, word], "left_semi").select(*by, F.col(word).alias("stem__"), F.col(score).alias("s__"))
    kept = df.join(longer.select(*by, word).distinct(), [*by, word], "left_anti").withColumn("stem__", F.expr(f"substring({word}, 1, length({word}) - 1)"))
    merged = kept.join(short.groupBy(*by, "stem__").agg(F.max("s__").alias("s__")), [*by, "stem__"], "left")
    return merged.withColumn(score, F.greatest(F.col(score), F.coalesce("s__", F.col(score)))).select(*df.columns)


def limited_then(df: DataFrame, order: list[Column], n: int, keep: Column, then: int) -> DataFrame:
    """The first rows that `keep` among the first n: the limit comes before the filter."""
    return df.orderBy(*order).limit(n).filter(keep).orderBy(*order).limit(then)


def distinct_by_content(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose columns (maps and arrays too) hold the same content once, whatever a map's order."""
    plain = lambda c: F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("m"))) if df.schema[c].dataType.typeName() == "map" else F.to_json(F.struct(c))
    return df.withColumn("content__", F.concat_ws("\x01", *[plain(c) for c in cols])).dropDuplicates(["content__"]).drop("content__")


def unresolved(rows: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """column, value, n: references that name nothing. references: column -> (table, its key)."""
    out = None
    for c, (table, key) in references.items():
        lost = rows.filter(F.col(c).isNotNull()).join(table.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        part = lost.groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def one_active(df: DataFrame, by: list[str], chosen: Column) -> DataFrame:
    """Makes the chosen row of each group the active one; groups without a choice keep theirs."""
    some = F.max(chosen.cast("int")).over(Window.partitionBy(*by)) == 1
    return df.withColumn("is_active", F.when(some, chosen).otherwise(F.col("is_active")))


def first_resolved(wanted: DataFrame, name: str, candidates: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Adds target and how: the first way in which a name is resolved to exactly one key. candidates: (how, table, its name column, its key)."""
    out = wanted
    for i, (_, table, column, key) in enumerate(candidates):
        only = table.groupBy(F.col(column).alias(name)).agg(single_or_null(F.col(key)).alias(f"t{i}__")).filter(F.col(f"t{i}__").isNotNull())
        out = out.join(only, name, "left")
    found = [F.col(f"t{i}__") for i in range(len(candidates))]
    how = F.coalesce(*[F.when(t.isNotNull(), c[0]) for t, c in zip(found, candidates, strict=True)])
    return out.select(*wanted.columns, F.coalesce(*found).alias("target"), how.alias("how"))


def token_match(expected: Column, observed: Column) -> Column:
    """Whether a word was read well enough: up to 2 characters exactly, up to 4 with one edit, longer ones with 28 % of edits."""
    d = F.levenshtein(expected, observed)
    n = F.length(expected)
    return F.when(n <= 2, d == 0).when(n <= 4, d <= 1).otherwise(d / F.greatest(n, F.length(observed), F.lit(1)) <= 0.28)


def equivalent(pairs: DataFrame, by: list[str], left: str, right: str, most: int = 16, samples: int = 4096) -> DataFrame:
    """by, equivalent, counterexample, exhaustive. Conditions are arrays of branches (see logic.holds()). Up to `most` variables every assignment is tried, and the counterexample is
    the least one, its bits being the variables in order of name, under which they differ; with more, `samples` drawn by hash are, and it is the number of the first sample."""
    from ..functions import logic

    names = F.array_sort(F.array_distinct(F.transform(F.flatten(F.concat(left, right)), lambda x: F.regexp_replace(x, "^!", ""))))
    rows = pairs.withColumn("v__", names).withColumn("whole__", F.size("v__") <= most)
    n = F.when(F.col("whole__"), F.pow(F.lit(2), F.size("v__")).cast("long")).otherwise(F.lit(samples).cast("long"))
    tried = rows.withColumn("i__", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    bits = lambda x, k: F.when(F.col("whole__"), F.getbit(F.col("i__"), F.least(k, F.lit(62))) == 1).otherwise(F.pmod(F.xxhash64(F.col("i__"), x), F.lit(2)) == 1)
    tried = tried.withColumn("states__", F.map_from_arrays("v__", F.transform("v__", bits)))
    differ = logic.holds(F.col(left), F.col("states__")) != logic.holds(F.col(right), F.col("states__"))
    return tried.groupBy(*by).agg((F.count_if(differ) == 0).alias("equivalent"), F.min(F.when(differ, F.col("i__"))).alias("counterexample"), F.first("whole__").alias("exhaustive"))


def best_candidates(found: DataFrame, by: list[str], word: str, score: str, title: str, labelled: str, n: int = 3) -> DataFrame:
    """by, word, score: the n likeliest words of a page. Half the reading score, 0.3 in the title block, 0.2 if the word is there several times, 0.2
    beside a label; at most 1, the best occurrence of a word counts; ties go by the word."""
    often = F.count(F.lit(1)).over(Window.partitionBy(*by, word)) >= 2
    points = 0.5 * F.col(score) + F.when(F.col(title), 0.3).otherwise(0.0) + F.when(often, 0.2).otherwise(0.0) + F.when(F.col(labelled), 0.2).otherwise(0.0)
    best = found.withColumn("p__", F.round(F.least(points, F.lit(1.0)), 3)).groupBy(*by, word).agg(F.max("p__").alias("score"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), word))
    return best.withColumn("nth__", nth).filter(F.col("nth__") <= n).drop("nth__")
