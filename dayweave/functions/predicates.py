"""Predicate trees ({all|any|not|feat,op,value}) compiled to Catalyst columns."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}


def compile_predicate(node: dict, columns: Iterable[str]) -> Column:
    """NULL counts as 0; a feature that is not a column is false."""
    known = set(columns)
    if "all" in node or "any" in node:
        word = "all" if "all" in node else "any"
        parts = [compile_predicate(child, known) for child in node[word]]
        joined = F.lit(word == "all")
        for part in parts:
            joined = (joined & part) if word == "all" else (joined | part)
        return joined
    if "not" in node:
        return ~compile_predicate(node["not"], known)
    if node["feat"] not in known:
        return F.lit(False)
    return COMPARE[node["op"]](F.coalesce(F.col(node["feat"]), F.lit(0.0)), F.lit(float(node["value"])))


def features_used(node: dict) -> set[str]:
    if "feat" in node:
        return {node["feat"]}
    children = node.get("all") or node.get("any") or ([node["not"]] if "not" in node else [])
    return set().union(*[features_used(c) for c in children]) if children else set()


def predicate_phrase(node) -> str:
    """One readable line per tree."""
    if not isinstance(node, dict):
        return "?"
    if "feat" in node:
        return f"{node['feat']} {node.get('op', '?')} {node.get('value')}"
    if isinstance(node.get("all"), list):
        return "  AND  ".join(map(predicate_phrase, node["all"]))
    if isinstance(node.get("any"), list):
        return "(" + "  OR  ".join(map(predicate_phrase, node["any"])) + ")"
    return str(node)


def with_composites(df: DataFrame, composites: list[dict]) -> DataFrame:
    """Named 0/1 features in order; each may read the ones before it.

    Definitions are grouped into dependency levels so a long list costs a few
    projections instead of one per feature.
    """
    todo = list(composites)
    while todo:
        level, later, pending = {}, [], set()
        for comp in todo:
            if features_used(comp["ast"]) & pending or comp["name"] in pending:
                later.append(comp)
            else:
                level[comp["name"]] = compile_predicate(comp["ast"], df.columns).cast("double")
            pending.add(comp["name"])
        df = df.withColumns(level)
        todo = later
    return df


def rule_columns(rules: list[dict], columns: Iterable[str], person=None, default: str = "home") -> tuple[Column, Column]:
    """(label, basis) of the first matching enabled rule by ascending priority.

    rules: dicts with slug, priority, predicate, optional person and enabled.
    """
    label, basis = F, F
    for rule in sorted(rules, key=lambda r: r["priority"]):
        if not rule.get("enabled", True):
            continue
        hit = compile_predicate(rule["predicate"], columns)
        if rule.get("person") is not None:
            hit = hit & (person == F.lit(rule["person"]))
        label = label.when(hit, F.lit(rule["slug"]))
        basis = basis.when(hit, F.lit(predicate_phrase(rule["predicate"])))
    if label is F:
        return F.lit(default), F.lit(None).cast("string")
    return label.otherwise(F.lit(default)), basis
