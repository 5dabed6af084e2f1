"""Gates over a registry of table contracts: what a step needs before it runs, and what it must leave behind.

The registry maps a table's name to its contract: ``status``, ``columns`` as ``(name, type, nullable)``, ``invariants``,
``relations``, ``owner`` (``{"notebook": ...}``), ``consumers``, ``enrichers``, ``optional_input``, ``must_be_nonempty`` and
``remediation``. All rules of a table are checked in one pass: every row turns into the keys that its rules look at, and
one aggregation over ``(table, rule, key)``, partial before the shuffle, counts them; rules only read these counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a message quotes.
SAMPLE = 5


class GateError(Exception):
    """A step's tables are not as their contracts say; ``failures`` has one entry a table or rule."""

    def __init__(self, step: str, failures: list):
        super().__init__(f"{step}: " + "; ".join(map(str, failures)))
        self.step, self.failures = step, failures


def _active(registry: dict) -> dict:
    return {name: c for name, c in registry.items() if c.get("status") == "active"}


def inputs(step: str, registry: dict, optional: bool = False) -> list[str]:
    """Active tables that a step consumes and doesn't own: those it requires (or, ``optional``, can do without, owned or not)."""
    found = {n: c for n, c in _active(registry).items() if step in c.get("consumers", []) and bool(c.get("optional_input")) == optional}
    return sorted(n for n, c in found.items() if optional or (c.get("owner") or {}).get("notebook") != step)


def owned(step: str, registry: dict) -> list[str]:
    return [n for n, c in _active(registry).items() if (c.get("owner") or {}).get("notebook") == step or step in c.get("enrichers", [])]


def missing_columns(df: DataFrame, contract: dict) -> list[str]:
    have = {c.upper() for c in df.columns}
    return [name for name, _, _ in contract.get("columns", []) if name.upper() not in have]


def setup_rows(step: str, tables: dict[str, DataFrame], registry: dict, run_at: str) -> list[dict]:
    """A row for each optional input of a step: there or not, and what to do about it."""
    return [{"run_at": run_at, "step": step, "table_name": n, "present": n in tables, "remediation": registry[n].get("remediation", "")} for n in inputs(step, registry, optional=True)]


def precondition_gate(step: str, tables: dict[str, DataFrame], registry: dict) -> list[str]:
    """Names of the required inputs, all there with their columns and, where the contract says so, with a row; else raises.

    ``tables`` holds what exists. A table's first row is all that is read.
    """
    failures, checked = [], []
    for name in inputs(step, registry):
        contract = registry[name]
        entry = {"table": name, "producer": (contract.get("owner") or {}).get("notebook") or "unknown"}
        absent = missing_columns(tables[name], contract) if name in tables else []
        if name not in tables:
            failures.append({**entry, "problem": "missing"})
        elif absent:
            failures.append({**entry, "problem": f"is missing column(s) {', '.join(absent)}"})
        elif contract.get("must_be_nonempty") and tables[name].isEmpty():
            failures.append({**entry, "problem": "is empty"})
        else:
            checked.append(name)
    if failures:
        raise GateError(step, failures)
    return checked


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _holds(where: dict | None) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (where or {}).items()), F.lit(True))


def _needs(name: str, tables: dict, registry: dict) -> list[dict]:
    """The rules of a table that can be checked: none of its invariants if a table that one refers to is absent."""
    contract = registry[name]
    rules = [dict(r, no=k) for k, r in enumerate(contract.get("invariants", []))]
    if any(r["kind"] == "reference" and r["references"].split(".")[0] not in tables for r in rules):
        return []
    return rules


def violations(names: list[str], tables: dict[str, DataFrame], registry: dict) -> DataFrame:
    """``(table, rule, kind, found, samples)``: every rule that is broken, in how many values, and the first few of them.

    Invariants: ``unique`` (``columns``, ``fold_case``; nulls are equal), ``allowed_values`` and ``reference`` (null never
    violates). A relation ``count_equals`` compares the rows that hold ``where`` with those of ``other_table`` that hold
    ``other_where``; ``found`` is the difference. A kind that isn't known raises.
    """
    seen: dict[str, list[Column]] = {}
    rules: list[tuple] = []
    key = lambda table, no, side, value: F.struct(F.lit(table).alias("table"), F.lit(no).alias("rule"), F.lit(side).alias("side"), value.alias("key"))
    for name in names:
        for r in _needs(name, tables, registry):
            if r["kind"] == "unique":
                fold = [F.upper(c) if r.get("fold_case") and dict(tables[name].dtypes)[c] == "string" else F.col(c) for c in r["columns"]]
                parts = [F.coalesce(F.to_json(F.struct(c.alias("k"))), F.lit("")) for c in fold] if len(fold) > 1 else []
                # Several columns as a row of JSON, so that no two rows share a key by chance.
                value = F.concat_ws(",", *parts) if parts else _text(fold[0])
            elif r["kind"] == "allowed_values":
                value = F.when(~F.col(r["column"]).isin(r["values"]), _text(F.col(r["column"])))
            elif r["kind"] == "reference":
                value = F.col(r["column"]).cast("string")
                target, column = r["references"].split(".")
                seen.setdefault(target, []).append(key(name, r["no"], "target", F.col(column).cast("string")))
            else:
                raise ValueError(f"{name}: unknown invariant {r['kind']}")
            seen.setdefault(name, []).append(key(name, r["no"], "own", value))
            rules.append((name, r["no"], r["kind"]))
        for k, r in enumerate(registry[name].get("relations", [])):
            if r["kind"] != "count_equals":
                raise ValueError(f"{name}: unknown relation {r['kind']}")
            if r["other_table"] in tables:
                no = 1000 + k
                seen.setdefault(name, []).append(key(name, no, "own", F.when(_holds(r.get("where")), "")))
                seen.setdefault(r["other_table"], []).append(key(name, no, "target", F.when(_holds(r.get("other_where")), "")))
                rules.append((name, no, "count_equals"))
    schema = "table string, rule int, kind string, found long, samples array<string>"
    if not rules:
        return next(iter(tables.values())).sparkSession.createDataFrame([], schema)
    keys = [tables[t].select(F.explode(F.filter(F.array(*ks), lambda k: k["key"].isNotNull())).alias("k")).select("k.*") for t, ks in seen.items()]
    counted = reduce(DataFrame.unionByName, keys).groupBy("table", "rule", "key").agg(F.count_if(F.col("side") == "own").alias("own"), F.count_if(F.col("side") == "target").alias("target"))
    kinds = F.broadcast(counted.sparkSession.createDataFrame(rules, "table string, rule int, kind string"))  # a row a rule
    counted = counted.join(kinds, ["table", "rule"])
    kind = F.col("kind")
    broken = F.when(kind == "unique", F.col("own") > 1).when(kind == "allowed_values", F.col("own") > 0).when(kind == "reference", (F.col("own") > 0) & (F.col("target") == 0)).otherwise(F.col("own") != F.col("target"))
    bad = counted.where(broken)
    first = bad.withColumn("k", F.row_number().over(Window.partitionBy("table", "rule").orderBy("key"))).where(F.col("k") <= SAMPLE)
    first = first.groupBy("table", "rule").agg(F.array_sort(F.collect_list("key")).alias("samples"))
    sizes = bad.groupBy("table", "rule", "kind").agg(F.sum(F.when(kind == "count_equals", F.abs(F.col("own") - F.col("target"))).otherwise(1)).cast("long").alias("found"))
    return sizes.join(first, ["table", "rule"]).select("table", "rule", "kind", "found", "samples")


def check_all(tables: dict[str, DataFrame], registry: dict) -> DataFrame:
    """Broken invariants of every active table that exists."""
    plain = {n: {**c, "relations": []} for n, c in registry.items()}
    return violations([n for n in _active(registry) if n in tables], tables, plain)


def postcondition_gate(step: str, tables: dict[str, DataFrame], registry: dict) -> list[str]:
    """Names of the tables that a step owns or enriches and that exist, all as their contracts say; else raises.

    One row a broken rule comes to the driver. Tables that a reference of theirs can't be checked for are left out.
    """
    names = [n for n in owned(step, registry) if n in tables and (not registry[n].get("invariants") or _needs(n, tables, registry))]
    found = violations(names, tables, registry).orderBy("table", "rule").collect() if names else []
    if found:
        rules = lambda r: registry[r.table]["relations"][r.rule - 1000] if r.rule >= 1000 else registry[r.table]["invariants"][r.rule]
        raise GateError(step, [f"{r.table}: {r.kind} {rules(r)} broken by {r.found}: {', '.join(r.samples)}" for r in found])
    return names
