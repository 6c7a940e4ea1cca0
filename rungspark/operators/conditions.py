"""Conditions of loads: values through relays in three-valued logic, branches that share literals, open ends.

literals: circuit_id, device (the driven one), branch, dep (the device of a contact), kind (a: closed when on, b: when off); a device is on if
any of its branches conducts, a branch if all of its contacts do; null means unknown. Every table may hold many circuits and scenarios.

Defined results: a device without branches is unknown; a null dep or kind makes its contact unknown; rows that are repeated change nothing; a given
null fixes a device as unknown; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logic
from . import graph

_CASE = ["circuit_id", "scenario"]


def literals_of(conditions: DataFrame, loads: DataFrame) -> DataFrame:
    """literals of circuit.branches(). loads: circuit_id, load, device; the coils of one device are branches of the device."""
    rows = conditions.join(loads.select("circuit_id", "load", "device"), ["circuit_id", "load"])
    branch = F.concat_ws("|", "load", F.col("branch").cast("string"))
    rows = rows.select("circuit_id", "device", branch.alias("branch"), F.explode_outer("literals").alias("x"))
    # A branch without contacts always conducts.
    return rows.select("circuit_id", "device", "branch", F.col("x.device").alias("dep"), F.when(F.col("x").isNull(), "always").otherwise(F.col("x.kind")).alias("kind"))


def _conducts(kind: Column, on: Column) -> Column:
    return F.when(kind == "always", F.lit(True)).when(kind == "a", on).when(kind == "b", ~on)


def _fixpoint(equations: DataFrame, by: list[str]) -> DataFrame:
    """by, device, on: the devices that are decided. equations: by, device, branch, dep_by (the `by` of the contact's device, if it differs), dep, kind, known.

    Values only ever go from unknown to decided, so the rounds end, after as many as the longest chain of devices; cycles that nothing outside
    decides stay unknown. `known` is the contact's device where that is settled beforehand."""
    at = [F.col(f"dep_{c}").alias(c) if f"dep_{c}" in equations.columns else F.col(c) for c in by]
    decided = None
    while True:
        rows = equations
        if decided is not None:
            now = decided.select(*[F.col(c).alias(f"v_{c}") for c in by], F.col("device").alias("v_device"), F.col("on").alias("v_on"))
            rows = rows.select("*", F.struct(*at).alias("at__"))
            match = F.col("dep") == F.col("v_device")
            for c in by:
                match = match & (F.col(f"at__.{c}") == F.col(f"v_{c}"))
            rows = rows.join(now, match, "left").withColumn("known", F.coalesce("known", "v_on"))
        branch = rows.groupBy(*by, "device", "branch").agg(logic.all_of(_conducts(F.col("kind"), F.col("known"))).alias("v"))
        found = branch.groupBy(*by, "device").agg(logic.any_of(F.col("v")).alias("on")).filter("on IS NOT NULL")
        before, decided = decided, graph.cut_lineage(found)
        n, last = decided.count(), 0 if before is None else before.count()
        graph.forget(before)
        if n == last:
            return decided


def _core(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, device: the devices on cycles, or between two of them; edges: by, device, dep. Ends are peeled off until none is left."""
    given = edges
    while True:
        inner = edges.join(edges.select(*by, F.col("dep").alias("device")).distinct(), [*by, "device"], "left_semi")
        inner = inner.join(edges.select(*by, F.col("device").alias("dep")).distinct(), [*by, "dep"], "left_semi").select(*by, "device", "dep")
        before, edges, n = edges, graph.cut_lineage(inner), edges.count()
        if before is not given:
            graph.forget(before)
        if edges.count() == n:
            return edges.select(*by, "device").distinct()


def _together(literals: DataFrame, given: DataFrame) -> DataFrame:
    """Equations (see _fixpoint()) of literals in each scenario that `given` names, with `named` (the contact's device) and null for `dep` where a given state fixes it.

    Literals and states are shuffled once, by circuit; what follows here and in _passed() sorts within a task, and spills, and holds no circuit as a whole."""
    own = literals.filter("circuit_id IS NOT NULL").select("circuit_id", F.lit(None).cast("string").alias("scenario"), "device", "branch", F.col("dep").alias("named"), "kind", F.lit(None).cast("boolean").alias("state"), F.lit(False).alias("given"))
    fixed = given.filter("circuit_id IS NOT NULL").select("circuit_id", F.col("scenario").cast("string").alias("scenario"), F.col("device").alias("named"), F.col("on").alias("state"), F.lit(True).alias("given"))
    rows = graph.dealt(own.unionByName(fixed, allowMissingColumns=True), ["circuit_id"])
    every = F.collect_set(F.when(F.col("given"), F.struct("scenario"))).over(Window.partitionBy("circuit_id"))
    rows = rows.withColumn("every", every).withColumn("s__", F.explode(F.when(F.col("given"), F.array(F.struct("scenario"))).otherwise(F.col("every"))))
    rows = rows.withColumn("scenario", F.col("s__.scenario")).drop("s__", "every")
    w, named = Window.partitionBy(*_CASE, "named"), F.col("named").isNotNull()
    rows = rows.withColumns({"known": F.max(F.when(F.col("given") & named, F.col("state"))).over(w), "fixed": F.max(F.col("given") & named).over(w)})
    return rows.filter("NOT given").select(*_CASE, "device", "branch", F.when(~F.col("fixed"), F.col("named")).alias("dep"), "named", "kind", "known")


def _passed(rows: DataFrame) -> DataFrame:
    """A round of the fixpoint on equations dealt by circuit, without a shuffle: v and on, the values of branch and device (0 off, 1 unknown, 2 on: all of is the
    least, any of the greatest), then known, by what that decides, and moved: whether that is new."""
    on = _conducts(F.col("kind"), F.col("known"))
    device = Window.partitionBy(*_CASE, "device")
    rows = rows.withColumn("v", F.min(F.when(on, 2).when(~on, 0).otherwise(1)).over(Window.partitionBy(*_CASE, "device", "branch")))
    rows = rows.withColumns({"on": F.max("v").over(device), "nth__": F.row_number().over(device.orderBy("branch"))})
    # One row of each device tells its state to the rows that ask for it.
    asks = F.struct(F.lit(False).alias("tells"), F.col("dep").alias("name"))
    tells = F.struct(F.lit(True).alias("tells"), F.col("device").alias("name"))
    rows = rows.withColumn("x__", F.explode(F.when(F.col("nth__") == 1, F.array(asks, tells)).otherwise(F.array(asks)))).select("*", "x__.tells", "x__.name")
    state = F.max(F.when(F.col("tells") & (F.col("on") != 1), F.col("on") == 2)).over(Window.partitionBy(*_CASE, "name"))
    rows = rows.withColumn("state__", F.when(F.col("name").isNotNull(), state)).filter("NOT tells")
    known = F.coalesce("known", "state__")
    return rows.select(*_CASE, "device", "branch", "dep", "named", "kind", known.alias("known"), "v", "on", (F.col("known").isNull() & F.col("state__").isNotNull()).alias("moved"))


def evaluated(literals: DataFrame, given: DataFrame, before: DataFrame | None = None, open_ends: DataFrame | None = None) -> DataFrame:
    """circuit_id, scenario, device, verdict (ON, OFF, UNKNOWN), unknown (the contacts' devices for want of which it is unknown).

    given: circuit_id, scenario, device, on: fixed states, also of relays; scenarios are those named here. before: states of relays beforehand, of the same
    form; a contact whose device is itself being decided (self-hold, mutual reference) goes by that, so each device is decided with its own state
    before in its own contacts, and so are the devices met on the way, one inside the other. open_ends: circuit_id, device: whose wiring goes on
    where nobody sees it; if not ON they are UNKNOWN."""
    rows = _passed(_passed(_passed(_together(literals, given))))
    again = F.max("moved").over(Window.partitionBy(*_CASE))
    rows = graph.cut_lineage(rows.select(*_CASE, "device", "branch", "dep", "named", "kind", "known", "v", "on", again.alias("again")))
    # Most cases are settled by then; the others go on device by device. A fixed device's own branches are evaluated too (it is a target), but its contacts keep the fixed state: dep is null there.
    rest = graph.cut_lineage(rows.filter("again").drop("v", "on", "again"))
    rows = rows.filter("NOT again")
    known = _fixpoint(rest, _CASE)
    rest = rest.join(known.select(*_CASE, F.col("device").alias("dep"), F.col("on").alias("k__")), [*_CASE, "dep"], "left").withColumn("known", F.coalesce("known", "k__")).drop("k__")
    lacks = F.when(F.col("known").isNull() & (F.col("kind") != "always"), F.col("named"))
    if before is None:
        # Branch and device of settled cases have their values on each row: 0 off, 1 unknown, 2 on.
        settled = rows.groupBy(*_CASE, "device").agg(F.max("on").alias("n__"), F.collect_set(F.when(F.col("v") == 1, lacks)).alias("missing"))
        settled = settled.select(*_CASE, "device", F.when(F.col("n__") != 1, F.col("n__") == 2).alias("on"), "missing")
    else:
        decided = rows.filter("on <> 1").select(*_CASE, "device", (F.col("on") == 2).alias("on")).distinct().unionByName(known.select(*_CASE, "device", "on"))
        rest, settled = _held(graph.cut_lineage(rows.drop("v", "on", "again").unionByName(rest)), decided, before), None
    branch = rest.groupBy(*_CASE, "device", "branch").agg(logic.all_of(_conducts(F.col("kind"), F.col("known"))).alias("v"), F.collect_set(lacks).alias("missing"))
    found = branch.groupBy(*_CASE, "device").agg(logic.any_of(F.col("v")).alias("on"), F.flatten(F.collect_list(F.when(F.col("v").isNull(), F.col("missing")))).alias("missing"))
    if settled is not None:
        found = found.unionByName(settled)
    verdict = logic.verdict(F.col("on"))
    if open_ends is not None:
        found = found.join(open_ends.select("circuit_id", "device").distinct().withColumn("open", F.lit(True)), ["circuit_id", "device"], "left")
        verdict = F.when(F.col("open") & (verdict != "ON"), "UNKNOWN").otherwise(verdict)
    return found.select(*_CASE, "device", verdict.alias("verdict"), F.when(F.col("on").isNull(), F.array_sort(F.array_distinct("missing"))).otherwise(F.array().cast("array<string>")).alias("unknown"))


def _held(rows: DataFrame, decided: DataFrame, before: DataFrame) -> DataFrame:
    """`rows` with the states beforehand where devices come upon themselves.

    A variable is a device together with the devices on cycles that are being decided around it; these have their state before, unknown if there is
    none. The variables that undecided targets need are found step by step, then all are decided in one fixpoint. There are as many as simple paths among undecided
    devices on cycles: few, as circuits hold themselves by a contact or two."""
    open_targets = rows.select(*_CASE, "device").distinct().join(decided, [*_CASE, "device"], "left_anti")
    undecided = rows.filter("known IS NULL AND dep IS NOT NULL").join(open_targets, [*_CASE, "device"], "left_semi")
    edges = graph.cut_lineage(undecided.select(*_CASE, "device", "dep").distinct())
    was = before.groupBy(*_CASE, "device").agg(F.first("on", ignorenulls=True).alias("before"))
    pins = graph.cut_lineage(_core(edges, _CASE).join(was, [*_CASE, "device"], "left"))
    own = lambda df: df.join(pins.select(*_CASE, "device", F.lit(True).alias("pinned")), [*_CASE, "device"], "left").withColumn(
        "inside", F.when(F.col("pinned"), F.array_sort(F.array_union("around", F.array("device")))).otherwise(F.col("around"))
    ).drop("pinned")
    seen = front = graph.cut_lineage(own(open_targets.withColumn("around", F.array().cast("array<string>"))))
    while True:
        deeper = front.join(edges, [*_CASE, "device"]).filter(~F.array_contains("inside", F.col("dep"))).select(*_CASE, F.col("dep").alias("device"), F.col("inside").alias("around")).distinct()
        front = graph.cut_lineage(own(deeper.join(seen, [*_CASE, "device", "around"], "left_anti")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    name = lambda c: F.concat_ws("\x1f", c)
    equations = seen.join(rows, [*_CASE, "device"]).join(pins.withColumnRenamed("device", "dep"), [*_CASE, "dep"], "left")
    equations = equations.select(
        *_CASE, name("around").alias("around"), "device", "branch", name("inside").alias("dep_around"), F.when(~F.array_contains("inside", F.col("dep")), F.col("dep")).alias("dep"), "named", "kind",
        F.coalesce("known", F.when(F.array_contains("inside", F.col("dep")), F.col("before"))).alias("known"),
    )
    equations = graph.cut_lineage(equations)
    found = _fixpoint(equations, [*_CASE, "around"]).select(*_CASE, F.col("around").alias("dep_around"), F.col("device").alias("dep"), F.col("on").alias("v"))
    top = equations.filter("around = ''").join(found, [*_CASE, "dep_around", "dep"], "left")
    top = top.select(*_CASE, "device", "branch", "dep", "named", "kind", F.coalesce("known", "v").alias("known"))
    return rows.join(open_targets, [*_CASE, "device"], "left_anti").select(top.columns).unionByName(top)


def near_open_ends(elements: DataFrame, open_nodes: DataFrame, buses: tuple[str, ...] = ("P", "0")) -> DataFrame:
    """circuit_id, device: loads from which contacts, open or closed, lead to a node where the wiring goes on unseen; not across the supply.
    elements: circuit_id, kind, a, b, device. open_nodes: circuit_id, node."""
    key = lambda c: F.concat_ws("|", F.col("circuit_id").cast("string"), c)
    inner = lambda c: ~F.col(c).isin(*buses)
    nets = graph.connected_components(elements.filter("kind <> 'load'").filter(inner("a") & inner("b")).select(key("a").alias("a"), key("b").alias("b")))
    net = lambda df: df.join(nets, "node", "left").withColumn("net", F.coalesce("component", "node"))
    ends = elements.filter("kind = 'load'").select("circuit_id", "device", F.explode(F.array("a", "b")).alias("n")).filter(inner("n")).select("circuit_id", "device", key("n").alias("node"))
    unseen = net(open_nodes.filter(inner("node")).select(key("node").alias("node"))).select("net").distinct()
    return net(ends).join(unseen, "net", "left_semi").select("circuit_id", "device").distinct()
