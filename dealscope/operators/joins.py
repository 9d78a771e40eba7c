"""Join discovery, join quality, joins and join chains.

Discovery compares columns through one value frame: each distinct value is
grouped once and carries a bit per column that holds it, so the shared values of
every candidate pair come from a single aggregation instead of one join per pair.
Quality is a full outer join of key counts, where a key held by a third of the
rows is one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope import fixed_values as fv
from dealscope.functions.names import name_similarity
from dealscope.functions.numbers import NUMBER_TEXT, count_if, fraction_form_sql, number_form_sql, ratio, whole_form_sql
from dealscope.functions.ordering import first_per_group
from dealscope.operators.profiling import _name, _value, kind_of
from dealscope.operators.semantic_types import number_sql

BITS = 60
JOIN_TYPES = ("left", "inner", "outer", "right")
CANDIDATE_SCHEMA = (
    "left_table string, right_table string, left_col string, right_col string, "
    "name_similarity double, value_overlap double, confidence double"
)


@dataclass(frozen=True)
class Candidate:
    left_table: str
    right_table: str
    left_col: str
    right_col: str
    name_similarity: float = 1.0
    value_overlap: float = 1.0
    confidence: float = 1.0
    join_type: str = "left"

    @property
    def sort_key(self):
        return (-self.confidence, self.left_table, self.right_table, self.left_col, self.right_col)


# --- value overlap ---------------------------------------------------------------


def _all_numbers(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether every non-null cell of each text column is a number (one row of counters)."""
    if not columns:
        return {}
    aggs = [f"count({_name(c)}) = count({number_sql(_name(c))}) AS `{i}`" for i, c in enumerate(columns)]
    row = df.selectExpr(*aggs).first()
    return {c: bool(row[i]) for i, c in enumerate(columns)}


def _key_form(field: T.StructField, as_number: bool = True) -> str:
    """Comparable text of a cell: numbers in one form of plain digits, whatever type they come in.

    ``as_number`` reads texts that are numbers as such; other texts are trimmed.
    """
    kind, v = kind_of(field.dataType), _value(field)
    if kind == "boolean":
        return f"concat('n', {whole_form_sql(f'CAST({v} AS INT)')})"
    if kind == "number":
        if field.dataType.typeName() in ("byte", "short", "integer", "long"):
            return f"concat('n', {whole_form_sql(v)})"
        return f"concat('n', {fraction_form_sql(v, isinstance(field.dataType, T.DecimalType))})"
    if kind == "date":
        return f"concat('d', CAST({v} AS STRING))"
    text = f"trim(CAST({v} AS STRING))"
    other = f"concat('s', {text})"
    if not as_number:
        return other
    return f"if({text} RLIKE '{NUMBER_TEXT}', concat('n', {number_form_sql(text)}), {other})"


def _comparable(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> tuple[str, str]:
    """SQL of the two keys as they are compared: as they are, or in one text form if their types differ."""
    a, b = ({f.name: f for f in df.schema.fields}[c] for df, c in ((left, left_col), (right, right_col)))
    if a.dataType == b.dataType:
        return _name(left_col), _name(right_col)
    return _key_form(a), _key_form(b)


def _keyed_values(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(value, word, bit) rows: comparable text form of each cell and its column's bit.

    Numbers compare by value (1 equals 1.0) with all digits, everything else as trimmed
    text; a text column counts as numbers only if all of its cells are.
    """
    fields = {f.name: f for f in df.schema.fields}
    texts = [c for c in columns if kind_of(fields[c].dataType) in ("text",)]
    numeric_text = _all_numbers(df, texts)
    cells = []
    for c, bit in columns.items():
        value = _key_form(fields[c], as_number=numeric_text.get(c, False))
        cells.append(f"struct({value} AS value, {bit // BITS} AS word, shiftleft(1L, {bit % BITS}) AS bit)")
    return df.selectExpr(f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL")


def shared_values(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> dict:
    """Distinct and shared value counts for every (left table, right table, left col, right col).

    One shuffle on the value; the result on the driver is one row of counters.
    """
    columns = sorted({(p[0], p[2]) for p in pairs} | {(p[1], p[3]) for p in pairs})
    number = {c: i for i, c in enumerate(columns)}
    frames = [
        _keyed_values(df, {c: number[(t, c)] for t, c in columns if t == name})
        for name, df in tables.items()
        if any(t == name for t, _ in columns)
    ]
    words = range((len(columns) + BITS - 1) // BITS)
    masks = reduce(DataFrame.unionByName, frames).groupBy("value").agg(
        *[
            F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"m{w}")
            for w in words
        ]
    )

    def has(c: tuple[str, str]) -> str:
        bit = number[c]
        return f"m{bit // BITS} & {1 << (bit % BITS)}L <> 0"

    aggs = [f"count_if({has(c)}) AS `d{i}`" for i, c in enumerate(columns)]
    aggs += [
        f"count_if({has((p[0], p[2]))} AND {has((p[1], p[3]))}) AS `s{i}`" for i, p in enumerate(pairs)
    ]
    row = masks.selectExpr(*aggs).first()
    return {
        p: (row[f"d{number[(p[0], p[2])]}"], row[f"d{number[(p[1], p[3])]}"], row[f"s{i}"])
        for i, p in enumerate(pairs)
    }


def suggest(tables: dict[str, DataFrame]) -> list[Candidate]:
    """Candidates over all column pairs of all table pairs, best first.

    The name gate runs on the driver over column names; only columns of surviving
    pairs are read.
    """
    pairs, similarity = [], {}
    for left, right in combinations(tables, 2):
        for lc in tables[left].columns:
            for rc in tables[right].columns:
                s = name_similarity(lc, rc)
                if s >= fv.MIN_NAME_SIMILARITY:
                    pairs.append((left, right, lc, rc))
                    similarity[pairs[-1]] = s
    if not pairs:
        return []
    found = []
    for pair, (n_left, n_right, shared) in shared_values(tables, pairs).items():
        if not n_left or not n_right:
            continue
        overlap = max(shared / n_left, shared / n_right)
        if overlap >= fv.MIN_OVERLAP:
            s = similarity[pair]
            found.append(
                Candidate(
                    *pair, round(s, 4), round(overlap, 4),
                    round(fv.NAME_WEIGHT * s + fv.OVERLAP_WEIGHT * overlap, 4),
                )
            )
    return sorted(found, key=lambda c: c.sort_key)


def candidate_rows(spark, candidates: list[Candidate]) -> DataFrame:
    rows = [
        (c.left_table, c.right_table, c.left_col, c.right_col, c.name_similarity, c.value_overlap, c.confidence)
        for c in candidates
    ]
    return spark.createDataFrame(rows, CANDIDATE_SCHEMA)


def best_per_pair(candidates: list[Candidate], threshold: float = fv.JOIN_CONFIDENCE) -> list[Candidate]:
    """The best candidate of each table pair above the threshold."""
    best = {}
    for c in sorted(candidates, key=lambda c: c.sort_key):
        if c.confidence >= threshold:
            best.setdefault((c.left_table, c.right_table), c)
    return list(best.values())


# --- join quality ------------------------------------------------------------------


def _key_counts(df: DataFrame, key: str, n: str) -> DataFrame:
    return df.groupBy(F.expr(key).alias("key")).agg(F.count("*").alias(n))


def join_quality(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Shared keys, rows without a match on either side and expansion."""
    a, b = _comparable(left, right, left_col, right_col)
    both = _key_counts(left, a, "nl").join(_key_counts(right, b, "nr"), "key", "full_outer")
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    matched = F.col("key").isNotNull() & (nl > 0) & (nr > 0)
    zero = F.lit(0).cast("bigint")

    def total(value: Column, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), zero)

    sums = both.agg(
        F.coalesce(F.sum(nl), zero).alias("left_rows"),
        F.coalesce(F.sum(nr), zero).alias("right_rows"),
        count_if(matched).alias("matched_keys"),
        count_if(F.col("key").isNotNull() & (nl > 0)).alias("left_keys"),
        count_if(F.col("key").isNotNull() & (nr > 0)).alias("right_keys"),
        total(nl, matched).alias("matched_rows"),
        total(nr, matched).alias("_matched_right"),
        total((nl * nr).cast("decimal(38,0)"), matched).cast("double").alias("joined_rows"),
    )
    rate = F.coalesce(ratio(F.col("matched_rows"), F.col("left_rows")), F.lit(0.0))
    expansion = F.coalesce(ratio(F.col("joined_rows"), F.col("left_rows")), F.lit(0.0))
    lost = F.col("left_rows") - F.col("matched_rows")
    out = sums.select(
        "left_rows",
        "right_rows",
        "left_keys",
        "right_keys",
        "matched_keys",
        "matched_rows",
        lost.alias("lost_left_rows"),
        (F.col("right_rows") - F.col("_matched_right")).alias("lost_right_rows"),
        F.round(rate, 4).alias("match_rate"),
        F.round(expansion, 4).alias("expansion"),
        (expansion > fv.MAX_EXPANSION).alias("duplicate_risk"),
        F.concat_ws(
            "; ",
            F.when(
                1 - rate > fv.MAX_LOSS_RATE,
                F.concat(lost.cast("string"), F.lit(" left rows have no match")),
            ),
            F.when(expansion > fv.MAX_EXPANSION, F.lit("M:N relationship, rows may be duplicated")),
        ).alias("warnings"),
    )
    return out


def overlap(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Bidirectional and one-direction overlap of distinct keys."""
    q = join_quality(left, right, left_col, right_col)
    forward = F.coalesce(ratio(F.col("matched_keys"), F.col("left_keys")), F.lit(0.0))
    backward = F.coalesce(ratio(F.col("matched_keys"), F.col("right_keys")), F.lit(0.0))
    return q.select(
        F.round(forward, 6).alias("referential_overlap"),
        F.round(F.greatest(forward, backward), 6).alias("value_overlap"),
    )


# --- joins -------------------------------------------------------------------------


def prefixed(right: DataFrame, table: str, taken: list[str], key: str) -> DataFrame:
    """Right-side columns that clash become ``{table}__{column}``."""
    clashes = {c: f"{table}__{c}" for c in right.columns if c != key and c in taken}
    return right.withColumnsRenamed(clashes)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_col: str,
    right_col: str,
    how: str = "left",
    right_table: str = "right",
    null_safe: bool = False,
) -> DataFrame:
    """Join on one key pair; broadcast or sort-merge is left to Spark's size checks.

    Equal key names give one key column, filled from either side. ``null_safe``
    lets null keys match each other. Keys of different types are compared by value,
    and a key column filled from both sides is then text.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}")
    right = prefixed(right, right_table, left.columns, right_col)
    mark, form, left_form = "__join_key", "__join_form", "__left_form"
    mixed = left.schema[left_col].dataType != right.schema[right_col].dataType
    key_a, key_b = _comparable(left, right, left_col, right_col)
    other = right.withColumn(form, F.expr(key_b)).withColumnRenamed(right_col, mark)
    with_form = left.withColumn(left_form, F.expr(key_a))
    same = F.col(left_form).eqNullSafe(F.col(form)) if null_safe else F.col(left_form) == F.col(form)
    joined = with_form.join(other, same, how).drop(form, left_form)
    a, b = F.col(_name(left_col)), F.col(mark)
    if left_col == right_col:
        sides = [c.cast("string") for c in (a, b)] if mixed else [a, b]
        key = (F.coalesce(*sides) if how in ("outer", "right") else a).alias(left_col)
        own = [key if c == left_col else F.col(_name(c)) for c in left.columns]
        return joined.select(*own, *[F.col(_name(c)) for c in right.columns if c != right_col])
    if right_col in left.columns:
        return joined.withColumnRenamed(mark, f"{right_table}__{right_col}")
    return joined.withColumnRenamed(mark, right_col)


@dataclass
class Chain:
    master: DataFrame | None
    applied: list[Candidate] = field(default_factory=list)


def build_chain(
    tables: dict[str, DataFrame],
    candidates: list[Candidate],
    threshold: float = fv.JOIN_CONFIDENCE,
    row_counts: dict[str, int] | None = None,
) -> Chain:
    """Fold the approved candidates onto an anchor table.

    The anchor is the most frequent left table (ties: more rows, if counts are
    given, else name order). A candidate whose tables are both in, or both out, is
    skipped; a flipped candidate keeps the name of the table it really adds. A column
    that a clash has renamed is still found by its table and own name.
    """
    approved = [c for c in dict.fromkeys(candidates) if c.confidence >= threshold]
    if not approved:
        return Chain(None)
    frequency = {}
    for c in approved:
        frequency[c.left_table] = frequency.get(c.left_table, 0) + 1
    sizes = row_counts or {}
    anchor = sorted(frequency, key=lambda t: (-frequency[t], -sizes.get(t, 0), t))[0]
    master, merged, applied = tables[anchor], {anchor}, []
    shown = {(anchor, c): c for c in master.columns}
    for c in sorted(approved, key=lambda c: (c.left_table != anchor, *c.sort_key)):
        if c.left_table in merged and c.right_table not in merged:
            new, held, r_col = c.right_table, (c.left_table, c.left_col), c.right_col
        elif c.right_table in merged and c.left_table not in merged:
            new, held, r_col = c.left_table, (c.right_table, c.right_col), c.left_col
        else:
            continue
        l_col, taken = shown[held], set(master.columns)
        master = equi_join(master, tables[new], l_col, r_col, c.join_type, new)
        shown |= {(new, n): f"{new}__{n}" if n in taken else n for n in tables[new].columns}
        if l_col == r_col:
            shown[(new, r_col)] = l_col
        merged.add(new)
        applied.append(c)
    return Chain(master if applied else None, applied)


def unknown_mentions(notes: DataFrame, mention_list: str, known: DataFrame, name: str) -> DataFrame:
    """Comma-separated mentions that match no known name (trimmed, any case)."""
    mentioned = notes.select(F.explode(F.split(mention_list, ",")).alias("mention")).select(
        F.trim("mention").alias("mention")
    )
    counted = (
        mentioned.filter(F.col("mention") != "")
        .groupBy("mention")
        .agg(F.count("*").alias("mentions"))
        .withColumn("key", F.lower("mention"))
    )
    names = known.select(F.lower(F.col(name)).alias("key")).distinct()
    return counted.join(names, "key", "left_anti").drop("key")


def drop_seen(items: DataFrame, hash_col: str, registry: DataFrame, order: str) -> DataFrame:
    """First item per hash that the registry does not hold yet."""
    fresh = first_per_group(items, [hash_col], [F.col(order)])
    return fresh.join(registry.select(hash_col).distinct(), hash_col, "left_anti")
