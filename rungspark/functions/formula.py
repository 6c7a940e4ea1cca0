"""Boolean formulas as columns: text to nodes and back, values, factored forms. All but factoring is built-in functions.

Text: names, TRUE, FALSE, `!` (also ~ ¬ NOT) before, `&` (∧ AND) before `|` (∨ OR), brackets; names with other characters in double quotes or 「」.
Nodes: an array of struct(op, name, negated) in post-order: lit (negated or not), true, false, not, and, or; the last three take the one or two
operands before them.

Defined results: a text that is null or no formula (empty ones too) has null nodes, and so has what is made of them; unknown names have the value
null; doubled negations of a name cancel out.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NODES = "array<struct<op:string,name:string,negated:boolean>>"
_TOKEN = r'"[^"]*"|「[^」]*」|[()&|!~¬∧∨]|[^\s()&|!~¬∧∨"「」]+'
_SIGNS = {"∧": "&", "∨": "|", "¬": "!", "~": "!", "AND": "&", "OR": "|", "NOT": "!"}


def tokens(text: Column) -> Column:
    """Array of struct(sign, name): a sign is one of & | ! ( ) true false, or null with the name of a variable. Null if something is no token."""
    sign = F.create_map(*[F.lit(x) for kv in _SIGNS.items() for x in kv])
    plain = lambda x: F.substring(x, 2, F.length(x) - 2)
    of = lambda x: F.when(x.rlike('^["「]'), F.struct(F.lit(None).cast("string").alias("sign"), plain(x).alias("name"))).otherwise(
        F.struct(
            F.coalesce(F.try_element_at(sign, F.upper(x)), F.when(x.rlike("^[()&|!]$"), x), F.when(F.upper(x).isin("TRUE", "FALSE"), F.lower(x))).alias("sign"),
            x.alias("name"),
        )
    )
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, _TOKEN, ""), r"\s+", ""))
    return F.when(rest == "", F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), of))


def _node(op: str | Column, name: Column | None = None) -> Column:
    op = F.lit(op) if isinstance(op, str) else op
    return F.struct(op.alias("op"), (F.lit(None).cast("string") if name is None else name).alias("name"), F.lit(False).alias("negated"))


def _top(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _less(a: Column, n: Column | int = 1) -> Column:
    return F.slice(a, 1, F.size(a) - n)


def parsed(text: Column) -> Column:
    """The nodes of a formula. One pass over its tokens with a stack of signs: of what is open inside a bracket the stack holds an `|` and an `&` at
    most, so each token takes off two at most; negations wait on it until their operand is complete."""
    state = F.struct(F.array().cast(NODES).alias("out"), F.array().cast("array<string>").alias("ops"), F.lit(True).alias("wants"), F.lit(True).alias("good"))
    make = lambda out, ops, wants, good: F.struct(out.alias("out"), ops.alias("ops"), wants.alias("wants"), good.alias("good"))
    word = F.create_map(F.lit("&"), F.lit("and"), F.lit("|"), F.lit("or"))

    def unwound(out: Column, ops: Column, signs: tuple[str, ...]) -> tuple[Column, Column]:
        for _ in range(2):
            hit = F.coalesce(_top(ops).isin(*signs), F.lit(False))
            out, ops = F.when(hit, F.concat(out, F.array(_node(F.try_element_at(word, _top(ops)))))).otherwise(out), F.when(hit, _less(ops)).otherwise(ops)
        return out, ops

    def complete(out: Column, ops: Column) -> tuple[Column, Column]:
        """Applies the negations that wait for the operand that ends `out`."""
        kept = F.aggregate(ops, F.struct(F.lit(0).alias("at"), F.lit(0).alias("keep")), lambda s, x: F.struct((s["at"] + 1).alias("at"), F.when(x != "!", s["at"] + 1).otherwise(s["keep"]).alias("keep")))["keep"]
        n = F.size(ops) - kept
        last = _top(out)
        flipped = F.concat(_less(out), F.array(F.struct(last["op"].alias("op"), last["name"].alias("name"), (last["negated"] != (n % 2 == 1)).alias("negated"))))
        return F.when(n == 0, out).when(last["op"] == "lit", flipped).otherwise(F.concat(out, F.array_repeat(_node("not"), n))), F.slice(ops, 1, kept)

    def step(s: Column, t: Column) -> Column:
        out, ops, wants, good, sign = s["out"], s["ops"], s["wants"], s["good"], t["sign"]
        push = lambda ops: F.concat(ops, F.array(sign))
        operand = F.when(sign.isNull(), _node("lit", t["name"])).otherwise(_node(sign))
        closed = unwound(out, ops, ("&", "|"))
        anded, ored = unwound(out, ops, ("&",)), closed
        return (
            F.when(sign.isin("!", "("), make(out, push(ops), F.lit(True), good & wants))
            .when(sign == "&", make(anded[0], push(anded[1]), F.lit(True), good & ~wants))
            .when(sign == "|", make(ored[0], push(ored[1]), F.lit(True), good & ~wants))
            .when(sign == ")", make(*complete(closed[0], _less(closed[1], F.least(F.lit(1), F.size(closed[1])))), F.lit(False), good & ~wants & F.coalesce(_top(closed[1]) == "(", F.lit(False))))
            .otherwise(make(*complete(F.concat(out, F.array(operand)), ops), F.lit(False), good & wants))
        )

    def finish(s: Column) -> Column:
        out, ops = unwound(s["out"], s["ops"], ("&", "|"))
        return F.when(s["good"] & ~s["wants"] & (F.size(ops) == 0), out)

    return F.when(F.size(tokens(text)) > 0, F.aggregate(tokens(text), state, step, finish))


def _quoted(name: Column) -> Column:
    odd = name.rlike(r'[\s()&|!~¬∧∨"]') | F.upper(name).isin("AND", "OR", "NOT", "TRUE", "FALSE") | (name == "")
    return F.when(odd, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)


def printed(nodes: Column) -> Column:
    """The text of nodes; brackets only where they are needed."""
    part = "array<struct<text:string,op:string>>"

    def step(stack: Column, x: Column) -> Column:
        inside = lambda p: F.when(p["op"].isin("and", "or") & (p["op"] != x["op"]), F.concat(F.lit("("), p["text"], F.lit(")"))).otherwise(p["text"])
        b, a = _top(stack), F.try_element_at(stack, F.lit(-2))
        both = F.concat(inside(a), F.when(x["op"] == "and", " & ").otherwise(" | "), inside(b))
        own = F.when(x["op"] == "lit", F.concat(F.when(x["negated"], "!").otherwise(""), _quoted(x["name"]))).when(x["op"] == "not", F.concat(F.lit("!("), b["text"], F.lit(")")))
        own = own.when(x["op"].isin("and", "or"), both).otherwise(F.upper(x["op"]))
        taken = F.when(x["op"].isin("and", "or"), 2).when(x["op"] == "not", 1).otherwise(0)
        return F.concat(_less(stack, taken), F.array(F.struct(own.alias("text"), x["op"].alias("op"))))

    return F.try_element_at(F.aggregate(nodes, F.array().cast(part), step), F.lit(1))["text"]


def value(nodes: Column, states: Column) -> Column:
    """Whether a formula holds; states: map of name to true, false or null (unknown, as are names that are not in it)."""

    def step(stack: Column, x: Column) -> Column:
        b, a = _top(stack), F.try_element_at(stack, F.lit(-2))
        on = F.try_element_at(states, x["name"])
        own = F.when(x["op"] == "lit", on != x["negated"]).when(x["op"] == "not", ~b).when(x["op"] == "and", a & b).when(x["op"] == "or", a | b).otherwise(x["op"] == "true")
        taken = F.when(x["op"].isin("and", "or"), 2).when(x["op"] == "not", 1).otherwise(0)
        return F.concat(_less(stack, taken), F.array(own))

    return F.try_element_at(F.aggregate(nodes, F.array().cast("array<boolean>"), step), F.lit(1))


def variables(nodes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(nodes, lambda x: x["op"] == "lit"), lambda x: x["name"])))


def _factor(terms: list[frozenset]) -> str:
    """Text of an OR of ANDs of (name, negated): what all have in common goes first, then the most frequent literal is taken out of its terms, and so on."""
    from re import search

    def lit(x: tuple) -> str:
        name = f'"{x[0]}"' if search(r'[\s()&|!~¬∧∨"]', x[0]) or x[0].upper() in ("AND", "OR", "NOT", "TRUE", "FALSE", "") else x[0]
        return ("!" if x[1] else "") + name

    def conj(literals, rest: tuple | None = None) -> tuple[str, str]:
        parts = [lit(x) for x in sorted(literals)]
        if rest and rest[0] != "true":
            parts.append(f"({rest[1]})" if rest[0] == "or" and parts else rest[1])
        return ("and" if len(parts) > 1 else rest[0] if rest and not literals else "lit", " & ".join(parts)) if parts else ("true", "TRUE")

    def disj(terms: list[frozenset]) -> tuple[str, str]:
        least = [t for t in dict.fromkeys(terms) if not any(o < t for o in terms)]
        if not least:
            return "false", "FALSE"
        common = frozenset.intersection(*least)
        rest = sorted((t - common for t in least), key=sorted)
        if not all(rest) or len(rest) == 1:
            return conj(common | rest[0]) if len(rest) == 1 else conj(common)
        often = Counter(x for t in rest for x in t)
        pick = min(often, key=lambda x: (-often[x], x))
        if often[pick] == 1:
            parts = [conj(t) for t in rest]
        else:
            without = [t for t in rest if pick not in t]
            parts = [conj({pick}, disj([t - {pick} for t in rest if pick in t]))] + ([disj(without)] if without else [])
        inner = [f"({p[1]})" if p[0] == "and" else p[1] for p in parts]
        return conj(common, ("or", " | ".join(inner)) if len(parts) > 1 else parts[0])

    return disj(terms)[1]


@F.pandas_udf(StringType())
def _factored(branches: pd.Series) -> pd.Series:
    terms = lambda bs: [frozenset((x["device"], x["kind"] == "b") for x in json.loads(b)) for b in bs]
    return pd.Series([None if bs is None else _factor(terms(bs)) for bs in branches], dtype=object)


def factored(branches: Column | str) -> Column:
    """The formula of a condition, an array of branches, each an array of struct(device, kind): literals that branches share are taken out. Equal in value."""
    return _factored(F.transform(branches, lambda b: F.to_json(b)))  # arrays of arrays of different lengths do not reach pandas
