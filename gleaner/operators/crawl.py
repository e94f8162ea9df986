"""The focused crawl as bulk-synchronous rounds over a table of pages.

A round takes the best of the frontier, fetches them (a join with the web's
table), judges, deduplicates, saves or rejects, scores the links and pushes what
passes.  The web is a table of pages or a function that fetches urls
(``sources.web.fetcher``).  Within a round, counters (host saturation, recently popped hosts) are
those of the round's start; a crawl that pops one page at a time updates them
after every pop.  The tables of a round are checkpointed, the loop itself holds
only counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import Frontier, LinkGate, PageGate, Topic
from gleaner.functions import scoring, urls
from gleaner.operators import dedup, html, links, pages
from gleaner.plans.shared import checkpoint_folder
from gleaner.sources import sinks

SEED_SCORE = 1_000_000.0


@dataclass
class Settings:
    per_round: int | None = 5  # None: all of the frontier that its hosts still allow
    rounds: int | None = None  # None: until the frontier is empty
    topic: Topic = field(default_factory=Topic)
    gate: PageGate = field(default_factory=PageGate)
    link_gate: LinkGate = field(default_factory=LinkGate)
    frontier: Frontier = field(default_factory=Frontier)


@dataclass
class State:
    """All tables of a crawl; save and load them to resume."""

    frontier: DataFrame  # url, seed, depth, score, priority, weight, seed_limit
    seen: DataFrame  # url
    saved: DataFrame
    rejected: DataFrame
    links: DataFrame
    statistics: DataFrame  # seed, discovered, fetched, failed, saved

    TABLES = ("frontier", "seen", "saved", "rejected", "links", "statistics")

    def write(self, folder: str) -> None:
        """All tables into a folder of their own below ``folder``, which replaces the last one when it is whole."""
        name = f"state-{uuid.uuid4().hex}"
        for t in self.TABLES:
            getattr(self, t).write.parquet(f"{folder}/{name}/{t}")
        sinks.point_to(self.frontier.sparkSession, folder, name)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> State | None:
        """The last whole state, None where there is none."""
        name = sinks.pointed_at(spark, folder)
        return name and State(*(spark.read.parquet(f"{folder}/{name}/{t}") for t in State.TABLES))


PAGE = "url string, seed string, host string, depth int, title string, language string, text string, status_code int, score double, relevance double, decision string, exclusion_reason string, fp long, round int"
LINK = "parent_url string, parent_host string, position int, target_url string, target_host string, anchor string, verdict_score double, frontier_score double, rejection_reason string, should_enqueue boolean, selected boolean, target_status string"


def start(seeds: DataFrame) -> State:
    """Fresh tables from seeds (url, round_robin_weight, max_pages_per_seed: below 0 for any number)."""
    spark = seeds.sparkSession
    most = F.col("max_pages_per_seed") if "max_pages_per_seed" in seeds.columns else F.lit(-1)
    first = seeds.select(F.col("url"), F.col("url").alias("seed"), F.lit(0).alias("depth"), F.lit(SEED_SCORE).alias("score"), F.lit(-SEED_SCORE).alias("priority"), F.col("round_robin_weight").alias("weight"), most.cast("int").alias("seed_limit"))
    return State(first, seeds.select("url").distinct(), spark.createDataFrame([], PAGE), spark.createDataFrame([], PAGE), spark.createDataFrame([], LINK), spark.createDataFrame([], STATISTICS))


STATISTICS = "seed string, discovered long, fetched long, failed long, saved long"


def active(state: State) -> DataFrame:
    """Rows of the frontier whose seed may still save pages (``room``, NULL without a limit)."""
    saved = state.saved.groupBy("seed").agg(F.count("*").alias("had"))
    room = F.when(F.col("seed_limit") >= 0, F.col("seed_limit") - F.coalesce("had", F.lit(0)))
    return state.frontier.join(F.broadcast(saved), "seed", "left").withColumn("room", room).where("room is null or room > 0").drop("had")


def pick(state: State, s: Settings) -> DataFrame:
    """This round's rows: ``per_round`` times the weight of each seed, best priority less what the host was just visited.

    Without ``per_round`` it is the whole frontier, of a host so many as can be
    saved before it is full, or rejected before it is given up; the others wait.
    Rows of a host that is full or given up are taken too, to be refused.  A seed
    gets no more rows than it may still save.
    """
    last = state.saved.unionByName(state.rejected).groupBy("host").agg(F.max("round").alias("visited"))
    f = active(state).withColumn("host", urls.host_of(F.col("url"))).join(last, "host", "left")
    latest = Window.partitionBy("seed")
    penalty = F.when(F.col("visited") == F.max("visited").over(latest), F.lit(s.frontier.recent_weight)).otherwise(0.0)
    if s.per_round is None:
        counts = lambda t, name: t.groupBy("host").agg(F.count("*").alias(name))
        f = f.join(counts(state.saved, "s"), "host", "left").join(counts(state.rejected, "r"), "host", "left").fillna(0, ["s", "r"])
        fresh, full = F.col("s") == 0, F.lit(s.frontier.max_pages_per_host) - F.col("s")
        room = F.when(fresh, F.least(full, F.lit(s.frontier.reject_cutoff) - F.col("r"))).otherwise(full)
        n = F.row_number().over(Window.partitionBy("host").orderBy("priority", "url", "seed"))
        f = f.withColumn("n", n).where((F.col("n") <= room) | (room <= 0))
        limited = F.row_number().over(Window.partitionBy("seed").orderBy("priority", "url"))
        few = f.where("room is not null").withColumn("n", limited).where("n <= room")
        return f.where("room is null").unionByName(few).drop("n", "visited", "s", "r", "room")
    w = Window.partitionBy("seed").orderBy(F.col("priority") + penalty, "url")
    most = F.least(s.per_round * F.col("weight"), "room")
    return f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n", "visited", "room")


Web = DataFrame | Callable[[DataFrame], DataFrame]


def fetched(picked: DataFrame, web: Web) -> DataFrame:
    """Picked rows with status_code, content_type and html of the web; what isn't there failed and leaves no row."""
    if callable(web):
        web = web(picked.select("url").distinct()).where("status_code is not null").checkpoint()
    return picked.join(web.select("url", "status_code", "content_type", "html"), "url")


def evaluated(got: DataFrame, saved: DataFrame, page_score: Callable[[], Column], s: Settings, number: int) -> DataFrame:
    """Every fetched page with its exclusion_reason, NULL for those to save, and the hrefs to follow."""
    kept = got.select(F.struct(*(c for c in got.columns if c != "html")).alias("row"), "html")
    parsed = html.parse_pages(kept, "row", fields=("title", "language", "description", "h1", "links", "text"))
    rows = parsed.select("row.*", *parsed.columns[1:]).withColumn("fp", dedup.fingerprint(F.col("text")))
    judged = pages.judged(rows, page_score(), s.topic, s.gate)
    bad = F.when(~F.col("status_code").between(200, 299), "bad_status").when(~F.coalesce(F.col("content_type").ilike("text/html%"), F.lit(True)), "non_html").when(F.trim("text") == "", "empty_text")
    judged = judged.withColumn("bad", bad).withColumn("order", F.struct(F.lit(number).alias("round"), F.col("priority").cast("double").alias("priority"), F.col("url").alias("at"))).checkpoint()
    # duplicates: the pages of earlier rounds come first, then those of this one in its order
    old = saved.select(F.struct("round", F.lit(0.0).alias("priority"), F.col("url").alias("at")).alias("id"), "fp")
    fresh = judged.where("bad is null and exclusion_reason is null").select(F.col("order").alias("id"), "fp")
    gone = dedup.greedy_keep(old.unionByName(fresh)).where("not kept").where(F.col("id.round") == number)
    copies = gone.select(F.col("id").alias("order"), F.lit("duplicate_text").alias("copy"))
    reason = F.coalesce("bad", "exclusion_reason", "copy")
    out = judged.join(copies, "order", "left").drop("order").withColumn("exclusion_reason", reason).withColumn("round", F.lit(number))
    return out.withColumn("follow", F.col("bad").isNull() & F.col("copy").isNull())


def followed(pages_: DataFrame, state: State, link_score: Callable[[], Column], s: Settings) -> DataFrame:
    """Decided links of the pages to follow, their targets unseen and canonical."""
    raw = pages_.where("follow").select(F.col("url").alias("parent_url"), F.col("host").alias("parent_host"), "depth", "seed", "weight", "seed_limit", F.posexplode("links").alias("position", "link"))
    targets = raw.withColumn("target_url", urls.canonical_url(F.col("link.href"), F.col("parent_url"))).where("target_url is not null")
    named = targets.select("parent_url", "parent_host", "depth", "seed", "weight", "seed_limit", "position", "target_url", urls.host_of(F.col("target_url")).alias("target_host"), F.col("link.anchor").alias("anchor"))
    count = lambda t: t.groupBy("host").agg(F.count("*").alias("n"))
    gated = links.gated(links.unseen(named, state.seen), link_score(), F.col("depth") + 1, count(state.saved), count(state.rejected), s.link_gate, s.frontier)
    return links.decided(links.budgeted(gated, s.link_gate))


def together(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and ``new`` checkpointed, in no more files than a shuffle has, however many rounds came before."""
    return old.unionByName(new).coalesce(int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))).checkpoint()


def step(state: State, web: Web, page_score: Callable[[], Column], link_score: Callable[[], Column], s: Settings, number: int) -> State:
    """One round."""
    picked = pick(state, s).checkpoint()
    counts = lambda t, name: t.groupBy("host").agg(F.count("*").alias(name))
    allowed = picked.join(counts(state.saved, "s"), "host", "left").join(counts(state.rejected, "r"), "host", "left").fillna(0, ["s", "r"])
    allowed = allowed.where((F.col("s") < s.frontier.max_pages_per_host) & ~((F.col("r") >= s.frontier.reject_cutoff) & (F.col("s") == 0)))
    allowed = allowed.drop("s", "r").checkpoint()
    done = evaluated(fetched(allowed, web), state.saved, page_score, s, number).checkpoint()
    names = [c.split()[0] for c in PAGE.split(", ")]
    saved = together(state.saved, done.where("exclusion_reason is null").select(*names))
    rejected = together(state.rejected, done.where("exclusion_reason is not null").select(*names))
    by_seed = lambda rows, **what: rows.groupBy("seed").agg(*(F.sum(v).alias(k) for k, v in what.items()))
    one, none = F.lit(1), F.lit(0).cast("long")
    parts = [by_seed(picked, discovered=one), by_seed(allowed, failed=one), by_seed(done, fetched=one, saved=F.col("exclusion_reason").isNull().cast("int"), failed=F.lit(-1))]
    statistics = state.statistics
    for p in parts:
        statistics = statistics.unionByName(p, allowMissingColumns=True)
    names = ("discovered", "fetched", "failed", "saved")
    statistics = statistics.groupBy("seed").agg(*(F.coalesce(F.sum(c), none).alias(c) for c in names)).checkpoint()
    out = followed(done, State(state.frontier, state.seen, saved, rejected, state.links, statistics), link_score, s).checkpoint()
    chosen = out.where("selected")
    queued = state.frontier.groupBy(urls.host_of(F.col("url")).alias("target_host")).agg(F.count("*").alias("q"))
    kept = saved.groupBy(F.col("host").alias("target_host")).agg(F.count("*").alias("k"))
    before = F.row_number().over(Window.partitionBy("target_host").orderBy(F.col("frontier_score").desc(), "parent_url", "position")) - 1
    pushed = chosen.join(queued, "target_host", "left").join(kept, "target_host", "left").fillna(0, ["q", "k"]).withColumn("b", before)
    priority = -scoring.push_priority(F.col("frontier_score"), F.col("depth") + 1, F.col("q") + F.col("b"), F.col("k"), s.frontier)
    pushed = pushed.select(F.col("target_url").alias("url"), "seed", (F.col("depth") + 1).alias("depth"), F.col("frontier_score").alias("score"), priority.alias("priority"), "weight", "seed_limit")
    frontier = state.frontier.join(picked.select("url", "seed").distinct(), ["url", "seed"], "left_anti").unionByName(pushed).checkpoint()
    seen = state.seen.union(pushed.select("url")).distinct().checkpoint()
    status = done.select(F.col("url").alias("target_url"), F.when(F.col("exclusion_reason").isNull(), "page").otherwise("rejected").alias("target_status")).dropDuplicates(["target_url"])
    known = state.links.unionByName(out.withColumn("target_status", F.lit(None).cast("string")).select(*state.links.columns))
    return State(frontier, seen, saved, rejected, pages.backfill(known, status).checkpoint(), statistics)


def crawl(seeds: DataFrame, web: Web, page_score: Callable[[], Column], link_score: Callable[[], Column], settings: Settings | None = None, state: State | None = None, folder: str | None = None, save_every: int = 1) -> State:
    """Rounds until no seed has anything left to do, or ``rounds`` of them where that is given.

    page_score and link_score give the score column from the columns of a page
    (title, url, text, ...) or link (target_url, anchor, ...).  With a ``folder``
    the state is read from there, if there is one, and written every
    ``save_every`` rounds and at the end, also when a round fails.
    """
    s = settings or Settings()
    checkpoint_folder(seeds.sparkSession)
    state = state or (folder and State.read(seeds.sparkSession, folder)) or start(seeds)
    at = max(state.saved.agg(F.max("round")).first()[0] or 0, state.rejected.agg(F.max("round")).first()[0] or 0)
    saved_at = at
    try:
        for number in count(at + 1) if s.rounds is None else range(at + 1, at + s.rounds + 1):
            if active(state).isEmpty():
                break
            state, at = step(state, web, page_score, link_score, s, number), number
            if folder and at - saved_at >= save_every:
                state.write(folder)
                saved_at = at
    finally:
        if folder and at != saved_at:
            state.write(folder)
    return state
