"""Wide and long forms, decomposition and rejoin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """One row for each id and value column, nulls kept; an Expand without a shuffle. Values are carried as text."""
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values])
    return text.unpivot(ids, values, name, value)


def long_to_wide(df: DataFrame, ids: list[str], values: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """The inverse of wide_to_long; a key that repeats raises, as either value could be meant."""
    one = F.when(F.count(F.lit(1)) <= 1, F.max(value)).otherwise(F.raise_error(F.lit("a key repeats in the long form")).cast(df.schema[value].dataType))
    return df.groupBy(*ids).pivot(name, values).agg(one)


def reshape_check(wide: DataFrame, long: DataFrame, ids: list[str], values: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """issue, n: cardinality, repeated keys, and values that the inverse does not recover."""
    n_wide, n_long = wide.agg(F.count("*").alias("n")), long.agg(F.count("*").alias("m"))
    size = n_wide.crossJoin(n_long).select(F.lit("cardinality_mismatch").alias("issue"), F.abs(F.col("m") - F.col("n") * len(values)).alias("n"))
    repeats = long.groupBy(*ids, name).agg(F.count("*").alias("_k")).filter("_k > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_key").alias("issue"), "n")
    lost = multiset_difference(wide_to_long(wide, ids, values, name, value), long).agg(F.count("*").alias("n")).select(F.lit("reshape_inverse_mismatch").alias("issue"), "n")
    return size.unionByName(repeats).unionByName(lost)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose counts differ, with surplus (a minus b): both directions in one shuffle with partial sums."""
    columns = a.columns
    both = a.withColumn("_w", F.lit(1)).unionByName(b.select(*columns).withColumn("_w", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_w").alias("surplus")).filter("surplus <> 0")


def decompose(df: DataFrame, keys: list[str], parts: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Two or three tables with all keys, each other field in exactly one."""
    fields = [c for cs in parts.values() for c in cs]
    if sorted(fields) != sorted(c for c in df.columns if c not in keys) or not 2 <= len(parts) <= 3:
        raise ValueError("two or three parts must share out the fields that are no keys")
    return {name: df.select(*keys, *cs).distinct() for name, cs in parts.items()}


def rejoin(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), tables.values())


def rejoin_check(original: DataFrame, tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """issue, n: keys that repeat in a part, orphans of any part, and rows that the rejoined table has lost or gained."""
    out = []
    first, *rest = tables
    for name, t in tables.items():
        repeats = t.groupBy(*keys).agg(F.count("*").alias("_k")).filter("_k > 1")
        out.append(repeats.agg(F.count("*").alias("n")).select(F.lit(f"unsafe_join_cardinality:{name}").alias("issue"), "n"))
    for name in rest:
        orphans = tables[name].select(*keys).exceptAll(tables[first].select(*keys)).unionByName(tables[first].select(*keys).exceptAll(tables[name].select(*keys)))
        out.append(orphans.agg(F.count("*").alias("n")).select(F.lit(f"orphan_join_record:{name}").alias("issue"), "n"))
    lost = multiset_difference(original, rejoin(tables, keys))
    out.append(lost.agg(F.count("*").alias("n")).select(F.lit("relational_inverse_mismatch").alias("issue"), "n"))
    return reduce(DataFrame.unionByName, out)


def unique_keys(df: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """keys, distinct, repeated, unique for each set of columns: whether it determines the rows, all sets in one aggregate. Rows with a null in a key count as one that repeats nothing."""
    whole = lambda ks: F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks]), F.struct(*ks))
    sums = df.agg(*[x for i, ks in enumerate(key_sets) for x in (F.count(whole(ks)).alias(f"n{i}"), F.count_distinct(whole(ks)).alias(f"d{i}"))])
    rows = [F.struct(F.array(*map(F.lit, ks)).alias("keys"), F.col(f"d{i}").alias("distinct"), (F.col(f"n{i}") - F.col(f"d{i}")).alias("repeated"), (F.col(f"n{i}") == F.col(f"d{i}")).alias("unique")) for i, ks in enumerate(key_sets)]
    return sums.select(F.inline(F.array(*rows)))


def shared_keys(tables: dict[str, DataFrame]) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    first, *rest = tables.values()
    return [c for c in first.columns if all(c in t.columns for t in rest)]


def _base(tables: dict[str, DataFrame]) -> str:
    """The largest table (the first of equals): the others have a row a key at most, so no join from it makes rows."""
    sizes = {name: t.count() for name, t in tables.items()}
    return max(sizes, key=sizes.__getitem__)


def rejoin_from_largest(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    base = _base(tables)
    return reduce(lambda a, b: a.join(b, keys), [tables[base], *[t for name, t in tables.items() if name != base]])


def _rows_differing(original: DataFrame, whole: DataFrame, keys: list[str]) -> int:
    """How many rows two tables differ by as multisets; whole has no null in its keys. Rows are counted and two 64-bit hashes of them added by key; only the rows of keys that differ in that are compared themselves."""
    columns = original.columns
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]  # a hash leaves nulls out
    halves = [(F.xxhash64(F.lit(seed), *parts), half) for seed in (1, 2) for half in ("high", "low")]
    added = [F.sum(F.shiftright(h, 32) if half == "high" else h.bitwiseAND(F.lit(0xFFFFFFFF))) for h, half in halves]  # in halves, as sums of whole hashes overflow
    prints = lambda df, name: df.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), *[x.alias(f"h{i}") for i, x in enumerate(added)]).alias(name))
    nameless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    differ = original.filter(nameless).count()
    keyed = original.filter(~nameless)
    off = written(prints(keyed, "_a").join(prints(whole, "_b"), keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys), "keys")
    if not off.isEmpty():
        rows = multiset_difference(keyed.join(off, keys, "left_semi").select(*columns), whole.join(off, keys, "left_semi").select(*columns))
        differ += rows.agg(F.sum(F.abs("surplus"))).first()[0] or 0
    return int(differ)


def relational_issues(original: DataFrame, tables: dict[str, DataFrame], keys: list[str] | None = None) -> DataFrame:
    """issue, part, n: what keeps two or three tables from being a lossless decomposition of the original. Without keys, the columns that all tables have.

    Forms are checked first: number of tables, keys that a table lacks, fields in two tables or in none. Then rows a key of the largest table (the base) beside those of each other table find keys with a null,
    keys that repeat outside the base, base rows without a match, and keys that the base lacks. Only where all that holds are the tables joined, from the base on, and compared
    with the original as multisets: n is how many rows differ. All is grouped and joined by the keys, so tables in buckets of the keys move nothing but what differs.
    """
    spark = original.sparkSession
    keys = keys or shared_keys(tables)
    found: list[tuple[str, str | None, int]] = []
    if not 2 <= len(tables) <= 3:
        found.append(("relational_file_count_invalid", None, len(tables)))
    found += [("join_key_missing_from_table", name, lacking) for name, t in tables.items() if (lacking := sum(k not in t.columns for k in keys))]
    owners = [c for t in tables.values() for c in t.columns if c not in keys]
    if len(owners) > len(set(owners)):
        found.append(("field_duplicated_across_tables", None, len(owners) - len(set(owners))))
    if off := (set(owners) | set(keys)) ^ set(original.columns):
        found.append(("relational_fields_not_lossless", None, len(off)))
    if not keys:
        found.append(("join_key_missing", None, 1))
    if not found:
        base = _base(tables)
        others = [name for name in tables if name != base]
        per_key = lambda name, n: tables[name].groupBy(*keys).agg(F.count("*").alias(n))
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys])
        b, n = F.coalesce("_b", F.lit(0)), F.coalesce("_n", F.lit(0))
        total = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
        rules = {
            "null_join_key": total(null, n), "unsafe_join_cardinality": F.count_if(~null & (n > 1)), "join_record_missing": total(~null & (n == 0), b), "orphan_join_record": F.count_if(~null & (n > 0) & (b == 0)), "base": total(null, b),
        }
        sums = [per_key(base, "_b").join(per_key(name, "_n"), keys, "full").agg(*[x.alias(rule) for rule, x in rules.items()]).withColumn("part", F.lit(name)) for name in others]
        counts = {r["part"]: r for r in reduce(DataFrame.unionByName, sums).collect()}  # one row a table
        for name in tables:
            if name == base:
                found += [("null_join_key", name, n)] if (n := counts[others[0]]["base"]) else []
            else:
                found += [(rule, name, n) for rule in rules if rule != "base" and (n := counts[name][rule])]
        if not found:
            whole = reduce(lambda x, y: x.join(y, keys), [tables[base], *[tables[name] for name in others]])
            differ = _rows_differing(original, whole, keys)
            found += [("relational_inverse_mismatch", None, differ)] if differ else []
    return spark.createDataFrame(found, "issue string, part string, n long")
