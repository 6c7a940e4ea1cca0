"""Formulas, conditions through relays, scenarios: against plain recursion over random networks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rungspark.functions import formula
from rungspark.operators import circuit, conditions, relational, scenarios

LITERALS = "circuit_id int, device string, branch string, dep string, kind string"
STATES = "circuit_id int, scenario string, device string, on boolean"


# --- formulas ---------------------------------------------------------------------------------------------------------


def random_formula(r, depth=3):
    """Text and a function of states (three-valued)."""
    names = ["A", "B 1", "X-2", "器具", "not"]
    if depth == 0 or r.random() < 0.25:
        if r.random() < 0.1:
            c = r.random() < 0.5
            return ("TRUE" if c else "false"), lambda s, c=c: c
        n = r.choice(names)
        return (f'"{n}"' if r.random() < 0.5 or " " in n or n == "not" else n), lambda s, n=n: s.get(n)
    kind = r.choice(["and", "or", "not", "and", "or"])
    a, fa = random_formula(r, depth - 1)
    if kind == "not":
        return r.choice(["!", "¬", "NOT ", "~"]) + f"({a})", lambda s: None if fa(s) is None else not fa(s)
    b, fb = random_formula(r, depth - 1)
    sign = {"and": ["&", " ∧ ", " AND ", " and "], "or": ["|", " ∨ ", " OR "]}[kind]

    def value(s):
        v = fa(s), fb(s)
        return ((False if False in v else None if None in v else True) if kind == "and" else (True if True in v else None if None in v else False))

    return f"({a})" + r.choice(sign) + f"({b})", value


def test_formulas_are_read_valued_and_printed(spark):
    r = random.Random(4)
    made = [random_formula(r) for _ in range(60)]
    states = [dict(zip(["A", "B 1", "X-2", "器具"], v)) for v in itertools.product([True, False, None], repeat=4)][::7]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, t string").withColumn("n", formula.parsed(F.col("t"))).withColumn("p", formula.printed(F.col("n")))
    df = df.withColumn("again", formula.parsed(F.col("p"))).crossJoin(spark.createDataFrame([(k, s) for k, s in enumerate(states)], "k int, s map<string,boolean>"))
    rows = df.select("i", "k", "p", formula.value(F.col("n"), F.col("s")).alias("v"), formula.value(F.col("again"), F.col("s")).alias("w"), formula.printed(F.col("again")).alias("pp")).collect()
    assert len(rows) == 60 * len(states)
    for x in rows:
        assert x.v == x.w == made[x.i][1](states[x.k]) and x.p == x.pp


def test_formula_text_and_errors(spark):
    texts = {"A & B | !C": "(A & B) | !C", "a|b|c": "a | b | c", "A AND (B OR NOT C)": "A & (B | !C)", "!!A": "A", "!(A|B)": "!(A | B)", "!(!A)": "A", "((A))": "A", '「a b」&x': '"a b" & x', "true & A": "TRUE & A"}
    bad = ["", " ", "A B", "A &", "& A", "(A", "A)", "()", "!", '"A', "A ! B", None]
    df = spark.createDataFrame([(t,) for t in [*texts, *bad]], "t string").select("t", formula.printed(formula.parsed(F.col("t"))).alias("p"))
    got = {r.t: r.p for r in df.collect()}
    assert got == {**texts, **dict.fromkeys(bad)}


def test_factored_conditions_are_equal_and_shorter(spark):
    r = random.Random(9)
    rows = []
    for i in range(80):
        branches = [[(f"D{r.randrange(6)}", r.choice("ab")) for _ in range(r.randrange(0 if i % 9 == 0 else 1, 4))] for _ in range(r.randrange(0, 5))]
        rows.append((i, [[{"device": d, "kind": k} for d, k in b] for b in branches]))
    df = spark.createDataFrame(rows, "i int, b array<array<struct<device:string,kind:string>>>").withColumn("t", formula.factored("b"))
    states = spark.createDataFrame([(k, {f"D{d}": bool(k >> d & 1) for d in range(6)}) for k in range(64)], "k int, s map<string,boolean>")
    for x in df.crossJoin(states).select("i", "k", "t", formula.value(formula.parsed(F.col("t")), F.col("s")).alias("v")).collect():
        want = any(all((x.k >> int(lit["device"][1:]) & 1 == 1) == (lit["kind"] == "a") for lit in b) for b in rows[x.i][1])
        assert x.v == want, (x.t, rows[x.i])
    one = spark.createDataFrame([([[{"device": d, "kind": "a"} for d in b] for b in ("ABD", "ACD")],)], "b array<array<struct<device:string,kind:string>>>")
    assert one.select(formula.factored("b").alias("t")).first().t == "A & D & (B | C)"


# --- through relays ---------------------------------------------------------------------------------------------------


def by_recursion(lits, given, before, device):
    """The reading by hand: follow each contact to its coil; one that is being decided has its state before."""
    relays = {d for d, *_ in lits}

    def state(d, stack):
        if d in given:
            return given[d]
        if d not in relays:
            return None
        if d in stack:
            return before.get(d)
        return value(d, (*stack, d))

    def value(d, stack):
        each = []
        for b in sorted({b for x, b, *_ in lits if x == d}):
            v = []
            for x, y, dep, kind in lits:
                if (x, y) == (d, b):
                    s = state(dep, stack)
                    v.append(None if s is None else s == (kind == "a"))
            each.append(False if False in v else None if None in v else True)
        return True if True in each else None if None in each else False

    return value(device, (device,))


def test_verdicts_through_relays_equal_recursion(spark):
    r, lits, given, before = random.Random(7), [], [], []
    for c in range(30):
        for k in range(5):  # relays K0..K4 may drive each other, in cycles too
            for b in range(r.randrange(0, 3)):
                for _ in range(r.randrange(1, 3)):
                    lits.append((c, f"K{k}", f"b{b}", r.choice([f"K{r.randrange(5)}", f"I{r.randrange(3)}"]), r.choice("aab")))
        for s in range(3):
            given += [(c, f"s{s}", f"I{i}", r.choice([True, False, None])) for i in range(3)]
            if r.random() < 0.3:
                given.append((c, f"s{s}", f"K{r.randrange(5)}", r.choice([True, False])))
            before += [(c, f"s{s}", f"K{k}", r.random() < 0.5) for k in range(5) if r.random() < 0.5]
    args = spark.createDataFrame(lits + lits[:3], LITERALS), spark.createDataFrame(given, STATES)
    for held in (None, before):
        got = conditions.evaluated(*args, None if held is None else spark.createDataFrame(held, STATES)).collect()
        assert len(got) == 3 * len({x[:2] for x in lits})
        for x in got:
            mine = [y[1:] for y in lits if y[0] == x.circuit_id]
            fixed = {d: v for c, s, d, v in given if (c, s) == (x.circuit_id, x.scenario)}
            was = {d: v for c, s, d, v in held or [] if (c, s) == (x.circuit_id, x.scenario)}
            want = by_recursion(mine, fixed, was, x.device)
            assert x.verdict == {True: "ON", False: "OFF", None: "UNKNOWN"}[want], (mine, fixed, was, x)
            assert (x.verdict == "UNKNOWN") == bool(x.unknown)


def test_cycles_open_ends_and_empty_tables(spark):
    lits = spark.createDataFrame([(1, "X", "1", "X", "a"), (1, "Y", "1", "I", "a"), (1, "Z", "1", None, "always")], LITERALS)
    given = spark.createDataFrame([(1, "s", "I", False)], STATES)
    seen = lambda **k: {x.device: x.verdict for x in conditions.evaluated(lits, given, **k).collect()}
    assert seen() == {"X": "UNKNOWN", "Y": "OFF", "Z": "ON"}
    assert seen(before=spark.createDataFrame([(1, "s", "X", True)], STATES))["X"] == "ON"
    assert seen(open_ends=spark.createDataFrame([(1, "Y"), (1, "Z")], "circuit_id int, device string")) == {"X": "UNKNOWN", "Y": "UNKNOWN", "Z": "ON"}
    assert conditions.evaluated(lits.limit(0), given).count() == 0 and conditions.evaluated(lits, given.limit(0)).count() == 0
    elements = spark.createDataFrame([(1, "a", "P", "n1", "A"), (1, "a", "n1", "n2", "B"), (1, "load", "n2", "0", "L"), (1, "load", "n9", "0", "M")], "circuit_id int, kind string, a string, b string, device string")
    ends = spark.createDataFrame([(1, "n1"), (1, "P")], "circuit_id int, node string")
    assert {x.device for x in conditions.near_open_ends(elements, ends).collect()} == {"L"}


def test_branches_of_meshes_end(spark):
    """Twenty pairs of parallel contacts in series: a million paths, of which 16 are asked for."""
    rows = [("m", f"x{k}{s}", "a", "P" if k == 0 else f"n{k}", f"n{k + 1}", f"X{k}{s}") for k in range(20) for s in "uv"] + [("m", "L", "load", "n20", "0", "L")]
    rows += [("c", "p", "a", "P", "u", "A"), ("c", "q", "b", "u", "v", "A"), ("c", "L", "load", "v", "0", "L")]
    df = spark.createDataFrame([(c, "1", ref, kind, a, b, dev, False) for c, ref, kind, a, b, dev in rows], "circuit_id string, page_id string, ref string, kind string, a string, b string, device string, has_coil boolean")
    got = circuit.branches(circuit.Circuit(df.filter("circuit_id = 'm'"), None, None), most=16, most_open=300).collect()
    assert len(got) == 16 and all(x.truncated and len(x.literals) == 20 for x in got)
    only = circuit.Circuit(df.filter("circuit_id = 'c'"), None, None)
    assert circuit.branches(only).count() == 0 and circuit.branches(only, contradictory=True).count() == 1


def test_scenarios(spark):
    lits = [(1, "Y", "1", "A", "a"), (1, "Y", "1", "B", "a"), (1, "Y", "1", "D", "a"), (1, "Y", "2", "A", "a"), (1, "Y", "2", "C", "a"), (1, "Y", "2", "D", "a"), (1, "L", "1", "Y", "a")]
    s = "circuit_id int, scenario_id string, subject string, forward boolean, condition string, affected array<string>"
    wanted = [(1, "S1", "Y", False, "A & (B | C) & D", []), (1, "S2", "Y", False, "A & B", []), (1, "S3", "A", True, None, ["L", "Y"]), (1, "S4", "A", True, None, ["Y"]), (1, "S5", "nobody", False, None, []), (1, "S6", "L", False, "Y &", [])]
    cases = [(1, "S1", 1, {"A": True, "B": False, "C": True, "D": True}, "成立"), (1, "S1", 2, {"A": True, "B": True, "C": True, "D": False}, "不成立"), (1, "S1", 3, {"A": True, "B": False, "C": None, "D": True}, "判定不能"),
             (1, "S2", 1, {"A": False}, "on"), (1, "S6", 1, {"A": True, "B": True, "D": True}, "ON"), (1, "S6", 2, {}, "?"), (1, "S6", 3, {"A": True}, "")]
    got = scenarios.checked(spark.createDataFrame(wanted, s), spark.createDataFrame(cases, "circuit_id int, scenario_id string, nth int, states map<string,boolean>, expected string"), spark.createDataFrame(lits, LITERALS)).collect()
    assert {(x.scenario_id, x.check): x.ok for x in got} == {
        ("S1", "condition"): True, ("S1", "case_1"): True, ("S1", "case_2"): True, ("S1", "case_3"): True, ("S2", "condition"): False, ("S2", "case_1"): False, ("S3", "affected"): True, ("S4", "affected"): False,
        ("S5", "found"): False, ("S6", "condition"): False, ("S6", "case_1"): True, ("S6", "case_2"): True,
    }
    assert next(x for x in got if (x.scenario_id, x.check) == ("S1", "condition")).actual == "A & D & (B | C)"


def test_equivalence_beyond_sixteen_variables(spark):
    many = [[f"v{i}", f"!v{i + 1}"] for i in range(30)]
    rows = [(1, many, many[::-1]), (2, many, many[:-1] + [["v29"]]), (3, [["a"]], [["a"]]), (4, [["a"], ["!a"]], [["b"], ["!b"]])]
    df = spark.createDataFrame(rows, "i int, l array<array<string>>, r array<array<string>>")
    got = {x.i: (x.equivalent, x.exhaustive) for x in relational.equivalent(df, ["i"], "l", "r").collect()}
    assert got[1] == (True, False) and got[3] == got[4] == (True, True) and not got[2][1]
    text = spark.createDataFrame([(1, "A & (B | C)", "A & B | A & C"), (2, "A | B", "A & B"), (3, "A &", "A &")], "i int, l string, r string")
    nodes = text.select("i", formula.parsed(F.col("l")).alias("l"), formula.parsed(F.col("r")).alias("r"))
    out = {x.i: x for x in scenarios.formulas_differ(nodes, ["i"], "l", "r").collect()}
    assert (out[1].equal, out[2].equal, out[3].equal) == (True, False, False) and out[2].counterexample == {"A": True, "B": False}


@pytest.mark.parametrize("bad", [[], [None]])
def test_factored_of_nothing(spark, bad):
    df = spark.createDataFrame([(None,), ([],)] if bad else [([],)], "b array<array<struct<device:string,kind:string>>>")
    assert [x.t for x in df.select(formula.factored("b").alias("t")).collect()] == ([None, "FALSE"] if bad else ["FALSE"])
