"""Joins and roll-ups around windows, entities, users, bills and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mentions_page(mentions: DataFrame, videos: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """The first ``most`` mentions of each entity in the videos (video_id, index_id) that are members (index_id, video_id, position) of their index."""
    rows = mentions.join(videos, "video_id").join(members, ["index_id", "video_id"])
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("position", "video_id", "segment_idx"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("index_id", "entity_id", "video_id", "segment_idx", "place")


def window_mentions(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Each entity found in a window (video_id, window_idx, entity_id) as mentioned in all of its segments, once."""
    rows = found.distinct().join(segments.select("video_id", "window_idx", "segment_idx").distinct(), ["video_id", "window_idx"])
    return rows.select("entity_id", "video_id", "segment_idx").distinct().withColumn("weight", F.lit(1.0))


def windows_of(segments: DataFrame) -> DataFrame:
    """Windows put together from their segments: bounds, segment ids in order, the first summary."""
    w = segments.groupBy("video_id", "window_idx").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.array_sort(F.collect_set("segment_idx")).alias("segment_ids"), F.min_by("window_summary", F.when(F.col("window_summary") != "", F.col("segment_idx"))).alias("summary"))
    return w.withColumn("summary", F.coalesce("summary", F.lit("")))


def with_window_summary(segments: DataFrame, summaries: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Segments with the number of their window and its summary, empty if there is none."""
    rows = segments.withColumn("window_idx", F.floor(F.col("t_start") / seconds).cast("long"))
    return rows.join(summaries.select("video_id", "window_idx", F.col("summary").alias("window_summary")), ["video_id", "window_idx"], "left").na.fill("", ["window_summary"])


def first_summaries(segments: DataFrame) -> DataFrame:
    """The first summary of each window that is not blank, with the begin of its segment."""
    rows = segments.where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    return rows.groupBy("video_id", "window_idx").agg(F.min_by(F.struct("t_start", "summary"), "ord").alias("s")).select("video_id", "window_idx", "s.t_start", "s.summary")


def daily_count(rows: DataFrame, at: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(at).cast("date").alias("day")).agg(F.count("*").alias(name))


def review_list(verdicts: DataFrame, videos: DataFrame, most: int) -> DataFrame:
    """Flagged videos, newest first: maxima, number of findings and of labels; a page of ``most``."""
    rows = verdicts.where("flagged").join(videos, "video_id")
    counts = [c for c in verdicts.columns if c.startswith("n_")]
    rows = rows.withColumn("flagged_count", reduce(lambda a, b: a + b, map(F.col, counts))).withColumn("n_labels", F.size(F.split("labels", ",")).cast("long"))
    return rows.na.fill(0.0, [c for c in verdicts.columns if c.startswith("max_")]).orderBy(F.desc("created_at"), "video_id").limit(most)


def breaches(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, value, least, breach): metrics of the one row that lie below their floor; nulls are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("least")) for k, v in floors.items())))
    rows = metrics.select(each.alias("m")).select("m.*").where("value < least")
    return rows.withColumn("breach", F.format_string("%s=%.3f < %.2f", "metric", "value", "least"))


def bill(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """What each user (user_id, item, quantity) owes at the rates (item, family, rate): per item, per family ('' for the item) and in all."""
    rows = usage.join(rates, "item").withColumn("amount", F.col("quantity") * F.col("rate"))
    rolled = rows.rollup("user_id", "family", "item").agg(F.sum("amount").alias("amount")).where("user_id is not null")
    return rolled.select("user_id", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("item", F.lit("")).alias("item"), "amount")


def invoices(plans: DataFrame, today: str, fee: float = 22.0, months: int = 2) -> DataFrame:
    """The calendar months before ``today`` as periods for every plan but the free one: first and last day, due a week in, a flat fee."""
    rows = plans.where("plan_id <> 'free'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(months))))
    start = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -F.col("k"))
    return rows.withColumn("period_start", start).withColumn("due", F.date_add("period_start", 7)).withColumn("period_end", F.last_day("period_start")).withColumn("total", F.lit(fee))


def within_caps(plans: DataFrame, used: DataFrame, caps: DataFrame) -> DataFrame:
    """Users with what they use and their plan's cap; without a cap everything is allowed."""
    rows = plans.join(used, "user_id", "left").na.fill(0, ["used"]).join(caps, "plan_id", "left")
    return rows.select("user_id", "plan_id", "used", "cap", (F.col("cap").isNull() | (F.col("used") <= F.col("cap"))).alias("allowed"))


def with_rollups(users: DataFrame, parts: list[DataFrame], zero: list[str], by: str = "user_id") -> DataFrame:
    """Users with roll-ups, each aggregated before the join; missing counts are 0."""
    return reduce(lambda a, b: a.join(b, by, "left"), parts, users).na.fill(0, zero)


def patch_refusal(role: Column, active: Column, self_change: Column, roles=("user", "admin")) -> Column:
    """The status with which a change of a user is refused, by the first rule that fails; null if none does."""
    return F.when(role.isNull() & active.isNull(), 400).when(role.isNotNull() & ~role.isin(*roles), 400).when(self_change, 403)


def arguments_fit(expected: Column, actual: Column, structural: tuple[str, ...]) -> Column:
    """Whether a call's arguments (a map) fit: ``structural`` ones are equal, any other that is expected is a text that is not blank."""
    own = lambda k: F.element_at(actual, k)
    fits = lambda e: F.when(e["key"].isin(*structural), own(e["key"]).eqNullSafe(e["value"])).otherwise(F.coalesce(F.trim(own(e["key"])) != "", F.lit(False)))
    return F.forall(F.map_entries(expected), fits)


def tiles(frames: DataFrame, grid: int) -> DataFrame:
    """Boxes of a grid over frames (frame_id, h, w); the last row and column take the rest. Frames too small for the grid have none."""
    n = F.sequence(F.lit(0), F.lit(grid - 1))
    rows = frames.withColumn("hs", F.expr(f"h div {grid}").cast("int")).withColumn("ws", F.expr(f"w div {grid}").cast("int")).where("hs > 0 and ws > 0").withColumn("r", F.explode(n)).withColumn("c", F.explode(n))
    past = lambda k, step, size: F.when(F.col(k) == grid - 1, F.col(size)).otherwise((F.col(k) + 1) * F.col(step))
    return rows.select("frame_id", F.concat(F.lit("r"), "r", F.lit("c"), "c").alias("region"), (F.col("r") * F.col("hs")).alias("y0"), past("r", "hs", "h").alias("y1"), (F.col("c") * F.col("ws")).alias("x0"), past("c", "ws", "w").alias("x1"))


def in_scope(rows: DataFrame, videos: DataFrame, user: int | None = None) -> DataFrame:
    """Rows of a user's ready videos (video_id, user_id, status); without a user, of anybody's."""
    own = videos.where(F.col("status") == "ready")
    own = own if user is None else own.where(F.col("user_id") == user)
    return rows.join(own.select("video_id").distinct(), "video_id", "left_semi")


def resolved_members(requests: DataFrame, members: DataFrame) -> DataFrame:
    """(request_id, index_id, video_id, known): the videos of a request (request_id, index_id, videos: an array), each known to the index or not; an empty request asks for all members."""
    named = requests.where("size(videos) > 0").select("request_id", "index_id", F.explode(F.array_distinct("videos")).alias("video_id")).join(members.select("index_id", "video_id", F.lit(True).alias("known")), ["index_id", "video_id"], "left")
    everything = requests.where("size(videos) <= 0 or videos is null").select("request_id", "index_id").join(members.select("index_id", "video_id"), "index_id").withColumn("known", F.lit(True))
    return named.select("request_id", "index_id", "video_id", F.coalesce("known", F.lit(False)).alias("known")).unionByName(everything.select("request_id", "index_id", "video_id", "known"))


def latest_subscription(events: DataFrame) -> DataFrame:
    """A user's subscription after all events (user_id, at, ord, type, status, customer, period_end): plan, status, customer, end of the period.

    Each field keeps the last value that an event gives it: checkout makes a developer plan active, created and updated set what they
    carry (the plan only when active or trialing), deleted ends it. Users start free and active.
    """
    t = F.col("type")
    changed = t.isin("customer.subscription.created", "customer.subscription.updated")
    plan = F.when(t == "checkout.session.completed", "developer").when(changed & F.col("status").isin("active", "trialing"), "developer").when(t == "customer.subscription.deleted", "free")
    status = F.when(t == "checkout.session.completed", "active").when(changed, F.nullif("status", F.lit(""))).when(t == "customer.subscription.deleted", "canceled")
    customer = F.when(t == "checkout.session.completed", F.nullif("customer", F.lit("")))
    end = F.when(changed, F.col("period_end"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct("at", "ord")))
    rows = events.groupBy("user_id").agg(last(plan).alias("plan_id"), last(status).alias("status"), last(customer).alias("customer"), last(end).alias("period_end"))
    return rows.withColumn("plan_id", F.coalesce("plan_id", F.lit("free"))).withColumn("status", F.coalesce("status", F.lit("active")))


#: Ways to order a list of videos.
SORTS = {"recent": ("created_at", False), "name": ("name", True), "duration": ("duration", False)}


def page_of(videos: DataFrame, asked: str = "", sort: str = "recent", number: int = 1, size: int = 20) -> DataFrame:
    """One page of the videos (video_id, name, created_at, duration) whose name holds ``asked``, numbered by place; pages have 1 to 100 rows."""
    size, number = max(1, min(100, size)), max(1, number)
    column, up = SORTS[sort]
    order = [F.asc(column) if up else F.desc(column), F.asc("video_id")]
    rows = videos.where(F.lower("name").contains(asked.lower())).orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) + (number - 1) * size)  # a page's rows


def library_totals(videos: DataFrame, by: str = "user_id") -> DataFrame:
    """Videos (``by``, status, duration) of each owner: how many, seconds in all (no duration counts 0), and a map of numbers by status."""
    kinds = videos.groupBy(by, F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("seconds"))
    return kinds.groupBy(by).agg(F.sum("n").alias("n_videos"), F.sum("seconds").alias("seconds"), F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("by_status"))
