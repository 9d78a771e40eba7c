"""The business questions as plans with explicit definitions.

Facts are summed to one row per account before any join or ranking, quartiles
come from the distributed global order, and overall averages or maxima enter as
one-value subqueries instead of single-task windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions.dates import age_days, as_of_timestamp, whole_days
from dealscope.functions.numbers import count_if, money_sum, money_sum_double, ratio
from dealscope.functions.ordering import with_ntiles
from dealscope.operators.analytics import won


def dormant_accounts(accounts: DataFrame, activity: DataFrame, as_of: str, days: int = fv.DORMANT_DAYS) -> DataFrame:
    """Q3: accounts without activity in the last ``days`` days, or without any."""
    last = activity.groupBy("account_id").agg(F.max("ts").alias("last_seen"))
    idle = F.col("idle_days")
    return (
        accounts.select("account_id", "account_name")
        .join(last, "account_id", "left")
        .withColumn("idle_days", age_days(F.col("last_seen"), as_of))
        .filter(idle.isNull() | (idle >= days))
        .select("account_id", "account_name", "idle_days")
    )


def tenure_vs_volume(deals: DataFrame, as_of: str) -> DataFrame:
    """Q4: longest-standing quartile of accounts with the lowest quartile of deals."""
    per = deals.groupBy("account_id").agg(
        age_days(F.min("created"), as_of).alias("tenure_days"), F.count("*").alias("deals")
    )
    orders = [("tenure_days", "tenure_quartile", True), ("deals", "volume_quartile", False)]
    per = with_ntiles(per, orders, "account_id", 4)
    return per.filter((F.col("tenure_quartile") == 1) & (F.col("volume_quartile") == 1))


def size_class(value: Column) -> Column:
    """Q6: small below 100k, mid below 500k, large from 500k."""
    sizes = fv.BENCHMARKS["deal_size_brackets"]
    return (
        F.when(value < sizes["small"]["max"], "small")
        .when(value < sizes["mid"]["max"], "mid")
        .when(value.isNotNull(), "large")
    )


def stale_deals(deals: DataFrame, as_of: str, days: int = fv.STALE_DAYS) -> DataFrame:
    """Q8: open deals whose last stage change (creation) is ``days`` or more back."""
    return (
        deals.filter(~won())
        .withColumn("age_days", age_days(F.col("created"), as_of))
        .filter(F.col("age_days") >= days)
        .select("deal_id", "account_id", "stage", "age_days")
    )


def stage_drop_off(activity: DataFrame, stages: list[str]) -> DataFrame:
    """Q9: accounts and events per ordered stage and the loss to the next stage."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    per_account = (
        activity.filter(F.col("kind").isin(*stages))
        .groupBy("kind", "account_id")
        .agg(F.count("*").alias("_n"))
    )
    sized = per_account.groupBy("kind").agg(
        F.count("*").alias("accounts"), F.sum("_n").alias("events")
    )
    w = Window.orderBy("stage_no")
    previous = F.lag("events").over(w)
    out = sized.withColumn("stage_no", order[F.col("kind")].cast("bigint")).withColumn(
        "drop_pct", F.round((1 - ratio(F.col("events"), previous)) * 100, 4)
    )
    worst = F.max("drop_pct").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("highest_leak", F.coalesce(F.col("drop_pct") == worst, F.lit(False)))


def engagement(accounts: DataFrame, activity: DataFrame) -> DataFrame:
    per = activity.groupBy("account_id").agg(F.count("*").alias("events"))
    return accounts.select("account_id").join(per, "account_id", "left").fillna({"events": 0})


def won_despite_low_engagement(accounts: DataFrame, activity: DataFrame, deals: DataFrame) -> DataFrame:
    """Q10: lowest engagement quartile with at least one won deal."""
    wins = deals.filter(won()).groupBy("account_id").agg(F.count("*").alias("won"))
    quartile = with_ntiles(
        engagement(accounts, activity), [("events", "quartile", False)], "account_id", 4
    )
    return quartile.filter(F.col("quartile") == 1).join(wins, "account_id").drop("quartile")


def underexploited_accounts(accounts: DataFrame, deals: DataFrame) -> DataFrame:
    """Q11: top quartile by size with a bottom quartile of deal count."""
    per = deals.groupBy("account_id").agg(F.count("*").alias("deals"))
    base = (
        accounts.select("account_id", F.col("revenue").cast("decimal(18,2)").alias("_size"))
        .filter(F.col("_size").isNotNull())
        .join(per, "account_id", "left")
        .fillna({"deals": 0})
    )
    base = with_ntiles(base, [("_size", "_big", True), ("deals", "_few", False)], "account_id", 4)
    return base.filter((F.col("_big") == 1) & (F.col("_few") == 1)).select(
        "account_id", F.col("_size").cast("double").alias("revenue"), "deals"
    )


def underselling_lines(deals: DataFrame) -> DataFrame:
    """Q12: win rate above the mean of the lines, open value below it."""
    lines = (
        deals.filter(F.col("service_line").isNotNull())
        .groupBy("service_line")
        .agg(
            F.round(ratio(count_if(won()), F.count("*")) * 100, 4).alias("win_rate_pct"),
            money_sum_double(F.when(~won(), F.col("deal_value"))).alias("open_value"),
        )
    )
    means = lines.agg(
        F.round(F.avg("win_rate_pct"), 4).alias("mean_rate"),
        F.round(F.avg("open_value"), 2).alias("mean_open"),
    )
    return (
        lines.withColumn("mean_rate", means.select("mean_rate").scalar())
        .withColumn("mean_open", means.select("mean_open").scalar())
        .withColumn(
            "underselling",
            (F.col("win_rate_pct") > F.col("mean_rate")) & (F.col("open_value") < F.col("mean_open")),
        )
    )


def segments(accounts: DataFrame, activity: DataFrame, deals: DataFrame, as_of: str) -> DataFrame:
    """Q14: terciles of revenue, tenure and activity; accounts and revenue per cluster."""
    per = deals.groupBy("account_id").agg(
        money_sum("deal_value").alias("_rev"), age_days(F.min("created"), as_of).alias("_tenure")
    )
    base = engagement(accounts, activity).join(per, "account_id")
    tiers = [
        ("_rev", "revenue_tier", True),
        ("_tenure", "tenure_tier", True),
        ("events", "activity_tier", True),
    ]
    base = with_ntiles(base, tiers, "account_id", 3)
    return base.groupBy("revenue_tier", "tenure_tier", "activity_tier").agg(
        F.count("*").alias("accounts"), F.sum("_rev").cast("double").alias("revenue")
    )


def deal_health(
    deals: DataFrame,
    as_of: str,
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
    horizon_days: int = 365,
) -> DataFrame:
    """Q15: 0-100 score of each open deal from freshness, value and stage, by line."""
    open_deals = deals.filter(~won() & F.col("deal_value").isNotNull())
    largest = open_deals.agg(F.max("deal_value")).scalar()
    age = F.least(F.greatest(age_days(F.col("created"), as_of), F.lit(0)), F.lit(horizon_days))
    freshness = 1 - ratio(age, F.lit(horizon_days))
    stage = F.when(F.col("stage") == "Proposal", 0.6).otherwise(0.3)
    score = F.round(
        (freshness * weights[0] + ratio(F.col("deal_value"), largest) * weights[1] + stage * weights[2])
        * 100,
        2,
    )
    exact = F.col("score").cast("decimal(9,2)")
    return (
        open_deals.withColumn("score", score)
        .groupBy("service_line")
        .agg(
            F.count("*").alias("deals"),
            F.round(ratio(F.sum(exact), F.count("*")), 4).alias("avg_score"),
            F.max("score").alias("best"),
            F.min("score").alias("worst"),
        )
    )


def win_drivers(deals: DataFrame, features: list[str]) -> DataFrame:
    """Q16: correlation of winning with each numeric feature, one pass over the deals."""
    is_won = won().cast("double")
    one = deals.agg(*[F.corr(is_won, F.col(c).cast("double")).alias(c) for c in features])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 6).alias("corr")) for c in features]
    )
    return one.select(F.inline(pairs)).withColumn("strength", F.abs("corr")).orderBy(
        F.col("strength").desc()
    )


def driver_features(deals: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    per = lines.groupBy(F.col("l_orderkey").alias("deal_id")).agg(
        F.count("*").alias("items"), F.sum("l_quantity").alias("quantity")
    )
    return (
        deals.join(per, "deal_id", "left")
        .fillna({"items": 0, "quantity": 0.0})
        .withColumn("age_days", age_days(F.col("created"), as_of))
    )


def cross_sell(deals: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """Q17: won value per account and line; accounts served by a single line.

    ``lines`` names columns that must be there; lines of the data that it lacks are
    added, so no deal is left out. A deal without a line belongs to none.
    """
    found = deals.filter(won() & F.col("service_line").isNotNull())
    seen = {r[0] for r in found.select("service_line").distinct().collect()}  # one name per line of service
    lines = [*(lines or []), *sorted(seen - set(lines or []))]
    wide = (
        found
        .groupBy("account_id")
        .pivot("service_line", lines)
        .agg(money_sum("deal_value"))
    )
    served = sum((F.col(f"`{line}`").isNotNull().cast("int") for line in lines), F.lit(0))
    values = [
        F.coalesce(F.col(f"`{line}`").cast("double"), F.lit(0.0)).alias(line) for line in lines
    ]
    missing = F.concat_ws(
        ", ", *[F.when(F.col(f"`{line}`").isNull(), F.lit(line)) for line in lines]
    )
    return (
        wide.withColumn("lines_served", served)
        .filter(F.col("lines_served") == 1)
        .select("account_id", *values, missing.alias("missing_lines"))
    )


def incomplete_deals(deals: DataFrame) -> DataFrame:
    """Deals without a close date or a value, with the missing fields named."""
    missing = F.concat_ws(
        ", ",
        F.when(F.col("close_date").isNull(), F.lit("close_date")),
        F.when(F.col("deal_value").isNull(), F.lit("deal_value")),
    )
    return deals.select("deal_id", "account_id", missing.alias("missing")).filter(
        F.col("missing") != ""
    )


def name_key(name: Column) -> Column:
    """Account name reduced for matching: lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N}]", "")


def duplicate_accounts(accounts: DataFrame, key: Column) -> DataFrame:
    """Q20: normalised names held by more than one account, with counts, not lists; a name without any letter or digit matches none."""
    return (
        accounts.withColumn("name_key", key)
        .filter(F.col("name_key") != "")
        .groupBy("name_key")
        .agg(
            F.count("*").alias("accounts"),
            F.min("account_name").alias("first_name"),
            F.max("account_name").alias("last_name"),
        )
        .filter(F.col("accounts") > 1)
    )


#: edits between two spellings, and the name length up to which all deletions are listed
EDITS, LONG_NAME = 2, 40


def _deletions(name: Column) -> Column:
    """The name and what is left of it without one or two of its characters, each once."""
    without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
    places = lambda x: F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: i > 0)
    one = F.transform(places(name), lambda i: without(name, i))
    # the second character is one behind the first
    two = F.transform(one, lambda x, k: F.transform(F.filter(places(x), lambda i: i > k), lambda i: without(x, i)))
    return F.array_distinct(F.concat(F.array(name), one, F.flatten(two)))


def _segments(length: Column) -> Column:
    """Begin (from 0) and size of EDITS + 1 segments of a name of that length; two edits leave one of them whole."""
    n = EDITS + 1
    cut = lambda k: F.floor(length * k / n).cast("int")
    return F.array(*[F.struct(F.lit(k).alias("k"), cut(k).alias("begin"), (cut(k + 1) - cut(k)).alias("size")) for k in range(n)])


def _short_blocks(names: DataFrame) -> DataFrame:
    """(name, block): two short names within two edits become equal when at most two characters of each are left out."""
    return names.where(F.length("name") <= LONG_NAME + EDITS).select(
        "name", F.explode(F.transform(_deletions(F.col("name")), lambda d: F.xxhash64(F.lit("d"), d))).alias("block")
    )


def _long_blocks(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, block) of the segments that long names hold, and of those that they look for.

    Their deletions grow with the square of the length, so they share a segment that lies at most two places aside,
    and look under the lengths and places a partner may have.
    """
    length = F.length("name")
    long = names.where(length > LONG_NAME)
    key = lambda size, k, text: F.xxhash64(F.lit("s"), size, k, text)
    held = F.transform(_segments(length), lambda s: key(length, s["k"], F.substring("name", s["begin"] + 1, s["size"])))
    aside = F.sequence(F.lit(-EDITS), F.lit(EDITS))
    sizes = F.transform(aside, lambda d: length + d)
    asked = F.flatten(
        F.transform(
            sizes,
            lambda n: F.flatten(
                F.transform(
                    _segments(n),
                    lambda s: F.transform(
                        F.filter(aside, lambda d: s["begin"] + d >= 0),
                        lambda d: key(n, s["k"], F.substring("name", s["begin"] + d + 1, s["size"])),
                    ),
                )
            ),
        )
    )
    return long.select("name", F.explode(held).alias("block")), long.select("name", F.explode(F.array_distinct(asked)).alias("block"))


def _blocks_of(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, name) rows of every name, and the rows that look for partners among them."""
    short, (held, asked) = _short_blocks(names), _long_blocks(names)
    return short.unionByName(held), short.unionByName(asked)


def _met(asking: DataFrame, holding: DataFrame) -> DataFrame:
    """Names that meet in a block, the smaller first.

    The blocks are many times the names they come from, which Spark's size estimate does not see: the hint keeps
    them from being broadcast, and one exchange serves both sides where they are the same rows.
    """
    near = asking.alias("a").join(holding.alias("b").hint("merge"), F.expr("a.block = b.block AND a.name < b.name"))
    return near.select(F.col("a.name").alias("name"), F.col("b.name").alias("other"))


def similar_accounts(accounts: DataFrame, key: Column) -> DataFrame:
    """Q20: pairs of different normalised names within two edits (inserted, deleted or changed characters).

    Every such pair is found: distinct names meet in blocks that it cannot miss, and the edit distance decides. All
    names of a deletion block are within four edits of each other, so blocks are as large as the names are close;
    a block that many share is a join key that Spark splits.
    """
    names = accounts.withColumn("name", key).where(F.col("name") != "").groupBy("name").agg(F.count("*").alias("accounts"))
    # by number: adaptive execution would put the few bytes of the names, which make many blocks, into one task
    dealt = names.select("name").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))
    short, (held, asked) = _short_blocks(dealt), _long_blocks(dealt)
    pairs = _met(short, short).unionByName(_met(asked, held))
    near = pairs.withColumn("distance", F.levenshtein("name", "other", EDITS)).where(F.col("distance") >= 0)
    found = near.select("name", "other", "distance").distinct()
    sized = names.withColumnsRenamed({"name": "n", "accounts": "a"}).hint("merge")
    out = found.join(sized, F.col("name") == F.col("n")).select("name", "other", "distance", F.col("a").alias("accounts"))
    return out.join(sized, F.col("other") == F.col("n")).select("name", "other", "distance", "accounts", F.col("a").alias("other_accounts"))


def unclassified_share(deals: DataFrame) -> DataFrame:
    """Q21: share of open deals and of open value without a service line."""
    missing = F.col("service_line").isNull()
    return (
        deals.filter(~won())
        .agg(
            F.count("*").alias("open_deals"),
            count_if(missing).alias("unclassified"),
            money_sum_double(F.when(missing, F.col("deal_value"))).alias("unclassified_value"),
            money_sum_double("deal_value").alias("open_value"),
        )
        .withColumn("pct_deals", F.round(ratio(F.col("unclassified"), F.col("open_deals")) * 100, 4))
        .withColumn(
            "pct_value", F.round(ratio(F.col("unclassified_value"), F.col("open_value")) * 100, 4)
        )
    )


def days_open(deals: DataFrame, as_of: str) -> DataFrame:
    """Elapsed whole days from creation to the reference time."""
    return deals.withColumn("days_open", whole_days(F.col("created"), as_of_timestamp(as_of)))
