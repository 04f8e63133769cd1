"""All declared constraints of a set of tables at once.

Value, state, required and length rules take one scan of each table and no shuffle but of one row of
counts. All references share one exchange, and so do all unique keys: their values are stacked as
rows of one shape. Repeated values are summed before the exchange, so a hot key is one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.operators.quality import PRIMARY, REFERENCES, UNIQUE, conditions


def rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, row_count) for every single-row rule of the given tables' columns, also those that no row breaks.

    A condition that is unknown because of a null passes, as a declared check does.
    """
    counted = []
    for name, df in tables.items():
        rules = conditions(name, df.columns)
        if not rules:
            continue
        sums = df.agg(*[F.count_if(~F.expr(cond)).alias(f"_{i}") for i, cond in enumerate(rules.values())])
        counted.append(
            sums.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("row_count"))
                            for i, rule in enumerate(rules)
                        ]
                    )
                )
            )
        )
    return reduce(DataFrame.unionByName, counted)


def reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(reference, row_count): rows whose reference is set and names no parent row, for every reference
    between the given tables, also those without orphans. A reference to a table that is not given is left out.

    Children and parents are stacked as (parent, key) rows; each reference of a parent has a slot of its own
    to count in, so one grouping serves as the join of them all. Parents go by number, and slots count in
    fixed-size fields, so that a group is short in memory.
    """
    slots: dict[str, list[str]] = {}
    asked = []
    for (child, column), parent in REFERENCES.items():
        if child in tables and parent in tables and column in tables[child].columns:
            slots.setdefault(parent, []).append(f"{child}.{column}")
            asked.append((child, column, parent, len(slots[parent]) - 1))
    width = max(map(len, slots.values()))
    numbers = {parent: i for i, parent in enumerate(slots)}
    stacked = []
    for parent in slots:
        key = _parent_key(parent)
        stacked.append(
            tables[parent].select(
                F.lit(numbers[parent]).alias("parent"), F.col(key).cast("bigint").alias("key"), F.lit(-1).alias("slot")
            )
        )
    for child in dict.fromkeys(c for c, *_ in asked):
        links = [
            F.struct(
                F.lit(numbers[parent]).alias("parent"), F.col(column).cast("bigint").alias("key"), F.lit(slot).alias("slot")
            )
            for c, column, parent, slot in asked
            if c == child
        ]
        stacked.append(tables[child].select(F.inline(F.array(*links))).filter("key is not null"))
    keys = (
        reduce(DataFrame.unionByName, stacked)
        .groupBy("parent", "key")
        .agg(
            F.max(F.col("slot") < 0).alias("known"),
            *[F.count_if(F.col("slot") == i).alias(f"_{i}") for i in range(width)],
        )
    )
    lost = keys.filter("not known").groupBy("parent").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(width)])
    found = lost.select("parent", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(width)])).alias("slot", "row_count"))
    names = tables[next(iter(tables))].sparkSession.createDataFrame(
        [(numbers[parent], slot, name) for parent, names in slots.items() for slot, name in enumerate(names)],
        "parent int, slot int, reference string",
    )
    return names.join(found, ["parent", "slot"], "left").select(
        "reference", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count")
    )


def key_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(unique_key, repeated_keys, row_count): how many values of each declared key occur more than once, and
    in how many rows, for every key whose columns are given, also those that hold. Nulls count as equal."""
    stacked, names = [], []
    for name, df in tables.items():
        lists = [k for k in [PRIMARY.get(name), *UNIQUE.get(name, [])] if k and set(k) <= set(df.columns)]
        if not lists:
            continue
        labels = [f"{name}({', '.join(k)})" for k in lists]
        names += labels
        values = [
            F.struct(
                F.lit(label).alias("unique_key"), F.array(*[F.col(c).cast("string") for c in k]).alias("key")
            )
            for label, k in zip(labels, lists)
        ]
        stacked.append(df.select(F.inline(F.array(*values))))
    repeated = (
        reduce(DataFrame.unionByName, stacked)
        .groupBy("unique_key", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy("unique_key")
        .agg(F.count(F.lit(1)).alias("repeated_keys"), F.sum("n").alias("row_count"))
    )
    none = F.lit(0).cast("bigint")
    asked = tables[next(iter(tables))].sparkSession.createDataFrame([(n,) for n in names], "unique_key string")
    return asked.join(repeated, "unique_key", "left").select(
        "unique_key", F.coalesce("repeated_keys", none).alias("repeated_keys"), F.coalesce("row_count", none).alias("row_count")
    )


def _parent_key(parent: str) -> str:
    return next(column for (_, column), p in REFERENCES.items() if p == parent)
