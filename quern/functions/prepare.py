"""Feature preparation: scaling, encodings, splits, folds, derived targets, series and lookup features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``; a row with a null, NaN or infinite value fails the job."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(F.assert_true(good, F.lit("non-finite value")).isNull())


def row_numbers(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """``df`` with 0-based numbers in order of the unique ``key``, counted by ranges so that no task holds all rows."""
    from .metrics import running_sums

    return running_sums(df.withColumn("__one", F.lit(1)), key, {name: "__one"}).withColumn(name, F.col(name).cast("long")).drop("__one")


def label_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sorted distinct values become 0, 1, ...; nulls stay null. The dictionary joins as Spark sees fit."""
    words = row_numbers(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name)
    return df.join(words, column, "left")


def first_seen_index(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """Values become 0, 1, ... in order of first appearance by ``key``."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias("__first"))
    return df.join(row_numbers(seen, "__first", name).drop("__first"), column, "left")


def decide(p: Column, cut: float = 0.5, keep_equal: bool = False) -> Column:
    """0 or 1 by p >= cut; with ``keep_equal`` a value of exactly the cut stays as it is."""
    if keep_equal:
        return F.when(p < cut, 0.0).when(p > cut, 1.0).otherwise(p)
    return F.when(p >= cut, 1.0).otherwise(0.0)


def arg_max(p: Column) -> Column:
    """Index of the largest entry, the first among equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(df: DataFrame, column: str, values: list, drop_first: bool = True) -> DataFrame:
    chosen = list(values)[1 if drop_first else 0 :]
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in chosen])


def tag_flags(df: DataFrame, column: str, tags: list[str]) -> DataFrame:
    """One 0/1 column for each tag of a space-separated list."""
    parts = F.split(column, " ")
    return df.select("*", *[F.coalesce(F.array_contains(parts, t).cast("int"), F.lit(0)).alias(f"tag_{t}") for t in tags])


def frequency_encode(df: DataFrame, column: str, rare: int = 100, name: str = "freq", missing: str = "NA", other: str = "RARE") -> DataFrame:
    """Share of rows with the value; nulls are a level, levels with fewer than ``rare`` rows one level together."""
    keyed = df.withColumn("__v", F.coalesce(F.col(column).cast("string"), F.lit(missing)))
    counts = keyed.groupBy("__v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("__level", F.when(F.col("n") < rare, other).otherwise(F.col("__v")))
    levels = counts.groupBy("__level").agg(F.sum("n").alias("m"))
    total = counts.agg(F.sum("n").alias("t"))
    table = counts.join(levels, "__level").join(F.broadcast(total)).select("__v", F.col("__level").alias(f"{name}_level"), (F.col("m") / F.col("t")).alias(name))
    return keyed.join(table, "__v").drop("__v")


def scaled(df: DataFrame, columns: list[str], kind: str = "minmax", low: float = 0.0, high: float = 1.0, least_sd: float = 0.0) -> DataFrame:
    """Mean-imputed and scaled columns (minmax or zscore); columns with a deviation below ``least_sd`` go. One statistics job."""
    row = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("b", F.max))]).first()
    out, gone = [], []
    for c in columns:
        m, s, a, b = (row[f"{c}__{n}"] for n in "msab")
        if m is None or (s or 0.0) < least_sd:
            gone.append(c)
            continue
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(m)))
        if kind == "minmax":
            out.append((F.lit(low) + (x - float(a)) / (float(b - a) or 1.0) * (high - low)).alias(c))
        else:
            out.append(((x - float(m)) / (float(s or 0.0) or 1.0)).alias(c))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def standardized(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """``train`` and ``others`` with their columns less the mean of ``train`` over its sample deviation (1 if that is 0), which all get alike."""
    row = train.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    moved = {c: (F.col(c).cast("double") - float(row[f"{c}__m"] or 0.0)) / (float(row[f"{c}__s"] or 0.0) or 1.0) for c in columns}
    return [df.withColumns(moved) for df in (train, *others)]


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n) of the exact number of distinct values of each column, nulls not among them; each value of a column is one row of a partial aggregate."""
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])))
    found = values.where("value IS NOT NULL").groupBy("name", "value").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return names.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def sampled(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random, or all if there are fewer: each task hands on its ``n`` smallest draws."""
    return df.orderBy(F.rand(seed)).limit(n)


def date_text(seconds: Column | str, form: str = "yyyy-MM-dd", zone: str = "UTC") -> Column:
    """Seconds since 1970 as text in a pattern of Spark's, in the zone's time."""
    at = F.timestamp_seconds(F.col(seconds) if isinstance(seconds, str) else seconds)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz")), form)


def split_kinds(df: DataFrame, columns: list[str], most: int = 1000, exact: bool = True) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns by their number of distinct values, approximate without ``exact``; constant ones are in neither."""
    if exact:
        counts = {r["name"]: r["n"] for r in distinct_counts(df, columns).collect()}
        kept = [c for c in columns if counts[c] > 1]
        return [c for c in kept if counts[c] >= most], [c for c in kept if counts[c] < most]
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns], *[(F.min(c) == F.max(c)).alias(f"{c}__one") for c in columns]).first()
    kept = [c for c in columns if row[f"{c}__one"] is False]
    return [c for c in kept if row[c] >= most], [c for c in kept if row[c] < most]


def correlated(df: DataFrame, columns: list[str], least: float = 0.9) -> list[str]:
    """The columns to drop: later ones whose correlation with an earlier kept one is at least ``least``. One job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return []
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    value = {p: row[str(i)] for i, p in enumerate(pairs)}
    gone: list[str] = []
    for a, b in pairs:
        if a not in gone and b not in gone and abs(value[a, b] or 0.0) >= least:
            gone.append(b)
    return gone


def head_tail_split(df: DataFrame, key: str, valid: float = 0.2) -> DataFrame:
    """``df`` with ``is_valid``: the last int(valid * m) rows by ``key``."""
    m = df.count()
    return row_numbers(df, key, "__row").withColumn("is_valid", F.col("__row") >= m - int(valid * m)).drop("__row")


def contiguous_folds(df: DataFrame, key: str, k: int, name: str = "fold") -> DataFrame:
    """``df`` with fold numbers 0 to k - 1 over contiguous stretches by ``key``."""
    m = max(1, df.count())
    return row_numbers(df, key, "__row").withColumn(name, F.floor(F.col("__row") * k / F.lit(m)).cast("int")).drop("__row")


def weighted_sample(df: DataFrame, cost: str, expected: float, seed: int = 0) -> DataFrame:
    """Rows picked with a chance in proportion to ``cost``, ``expected`` of them on average."""
    total = df.agg(F.sum(cost)).first()[0] or 0.0
    return df.where(F.rand(seed) < F.col(cost) * (expected / total if total else 0.0))


# -- series ----------------------------------------------------------------------------------------------------------


def differenced(df: DataFrame, value: str, order: str, by: list[str], times: int = 1, name: str = "diff") -> DataFrame:
    """Value less the one before it, ``times`` times; null where there is none."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn(name, F.col(value))
    for _ in range(times):
        out = out.withColumn(name, F.col(name) - F.lag(name).over(w))
    return out


def lag_matrix(df: DataFrame, value: str, order: str, by: list[str], depth: int, prefix: str = "lag") -> DataFrame:
    """The ``depth`` values before each row; rows without all of them go."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.select("*", *[F.lag(value, k).over(w).alias(f"{prefix}{k}") for k in range(1, depth + 1)])
    return out.where(F.col(f"{prefix}{depth}").isNotNull()) if depth else out


def moving_average(df: DataFrame, value: str, order: str, by: list[str], k: int = 3, name: str = "average") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - k, 0)))


# -- look-ups --------------------------------------------------------------------------------------------------------


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """As-of look-up: to each left row the values of the latest right row of its key strictly before its time.

    Both sides are stacked and one running window carries the last right row forward, so a key's rows
    meet once, sorted, and never as pairs. Right rows of equal time count together; the last by value wins.
    """
    carried = [f"latest_{v}" for v in values]
    both = left.select("*", F.lit(0).alias("__side"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("__v"))
    other = right.select(key, time, F.lit(1).alias("__side"), F.struct(*values).alias("__v"))
    stacked = both.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "__side", "__v").rowsBetween(Window.unboundedPreceding, -1)
    out = stacked.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 0")
    return out.select(*left.columns, *[F.col(f"__last.{v}").alias(n) for v, n in zip(values, carried, strict=True)])


def last_rows(df: DataFrame, key: str, time: str, value: str, count: int) -> DataFrame:
    """To each row the sum and number of the ``count`` rows of its key before it."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-count, -1)
    return df.select("*", F.sum(value).over(w).alias("last_sum"), F.count(value).over(w).alias("last_n"))


def first_of_each(df: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= count).drop("__n")


def share_of_group_max(df: DataFrame, value: str, key: str, name: str = "share") -> DataFrame:
    """The value's share of its group's largest one, from a partial aggregate that joins back; a null key is a group of its own."""
    top = df.groupBy(F.col(key).alias("__key")).agg(F.max(value).alias("__top"))
    return df.join(top, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col(value) / F.col("__top")).drop("__key", "__top")


# -- shared dictionaries, odds, normalizing, samples -----------------------------------------------------------------


def shared_index(df: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """The sorted distinct values of all ``columns`` together become 0, 1, ...; each column gets its codes from that one dictionary."""
    words = None
    for c in columns:
        part = df.select(F.col(c).alias("__word"))
        words = part if words is None else words.union(part)
    words = row_numbers(words.where("__word IS NOT NULL").distinct(), "__word", "__code")
    for c in columns:
        df = df.join(words.select(F.col("__word").alias(c), F.col("__code").alias(f"{c}{suffix}")), c, "left")
    return df


def odds_to_probabilities(df: DataFrame, odds: list[str], prefix: str = "p_") -> DataFrame:
    """Decimal odds of the outcomes of one event as probabilities that sum to one: the bookmaker's margin is taken out."""
    total = sum((1 / F.col(c) for c in odds[1:]), 1 / F.col(odds[0]))
    return df.select("*", *[(1 / F.col(c) / total).alias(f"{prefix}{c}") for c in odds])


def last_of_either_side(df: DataFrame, sides: list[str], values: list[str], time: str, key: str, count: int) -> DataFrame:
    """To each row, for each of its two sides, the sum and number of that party's values in its last ``count`` rows, on whichever side it stood.

    The sides are stacked so that one window for each party sees all of its rows; ``key`` names the rows. (key, {side}_sum, {side}_n)
    """
    stacked = df.select(key, time, F.inline(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("party"), F.col(v).alias("value")) for i, (s, v) in enumerate(zip(sides, values, strict=True))])))
    w = Window.partitionBy("party").orderBy(time, key, "side").rowsBetween(-count, -1)
    each = stacked.select(key, "side", F.sum("value").over(w).alias("s"), F.count("value").over(w).alias("n"))
    wide = [c for i, s in enumerate(sides) for c in (F.max(F.when(F.col("side") == i, F.col("s"))).alias(f"{s}_sum"), F.max(F.when(F.col("side") == i, F.col("n"))).alias(f"{s}_n"))]
    return each.groupBy(key).agg(*wide)


def last_against_each_other(df: DataFrame, sides: list[str], values: list[str], time: str, key: str, count: int) -> DataFrame:
    """To each row, for each of its two sides, the sum of that party's values in the last ``count`` rows of the same two parties, and their number.

    The two parties in order name a pair, whichever side they stood on, so one window of each pair sees its rows; values are turned to the
    party first in order and back. Rows of one time count in order of ``key``, which names the rows. (key, {side}_sum, n)
    """
    a, b = (F.col(c) for c in sides)
    first = a <= b
    turned = df.select(key, time, F.least(a, b).alias("__low"), F.greatest(a, b).alias("__high"), first.alias("__first"), *[F.when(first, F.col(values[i])).otherwise(F.col(values[1 - i])).alias(f"__v{i}") for i in (0, 1)])
    w = Window.partitionBy("__low", "__high").orderBy(time, key).rowsBetween(-count, -1)
    sums = turned.select(key, "__first", *[F.sum(f"__v{i}").over(w).alias(f"__s{i}") for i in (0, 1)], F.count("*").over(w).alias("n"))
    return sums.select(key, *[F.when(F.col("__first"), F.col(f"__s{i}")).otherwise(F.col(f"__s{1 - i}")).alias(f"{side}_sum") for i, side in enumerate(sides)], "n")


def undifferenced(df: DataFrame, diff: str, first: Column, order: str, by: list[str], name: str = "value") -> DataFrame:
    """Values back from first differences: each series' ``first`` value (on its first row) plus the sum of its differences so far."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.first(first).over(upto) + F.coalesce(F.sum(F.col(diff)).over(upto), F.lit(0.0)))


def normalized_rows(df: DataFrame, column: str, name: str = "normal") -> DataFrame:
    """An array column at Euclidean length 1; rows of zeros stay."""
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn(name, F.transform(column, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))))


def stratified_split(df: DataFrame, stratum: str, key: str, valid: float = 0.2) -> DataFrame:
    """``df`` with ``is_valid``: in each stratum the floor(valid * n) rows that come first by a hash of the unique ``key``.

    The cut is the hash value of rank floor(valid * n), found by counting the hash's bins (1,024 a stratum) and ranking only the bin of the cut.
    """
    hashed = df.withColumn("__h", F.xxhash64(key)).withColumn("__bin", F.shiftrightunsigned("__h", 54))
    bins = hashed.groupBy(stratum, "__bin").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(stratum)
    upto = F.sum("__n").over(w.orderBy("__bin"))
    bins = bins.select(stratum, "__bin", (upto - F.col("__n")).alias("__before"), (F.floor(F.lit(valid) * F.sum("__n").over(w)) - (upto - F.col("__n"))).alias("__take"), "__n")
    marked = hashed.join(bins, [stratum, "__bin"])
    inside = F.when(F.col("__take") >= F.col("__n"), True).when(F.col("__take") <= 0, False)
    edge = marked.where((F.col("__take") > 0) & (F.col("__take") < F.col("__n"))).select(key, stratum, "__h", "__take")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))  # a thousandth of the stratum
    chosen = edge.select(F.col(key), (rank <= F.col("__take")).alias("__chosen"))
    return marked.withColumn("__in", inside).join(chosen, key, "left").withColumn("is_valid", F.coalesce("__in", "__chosen")).select(*df.columns, "is_valid")
