"""Mixing sources to target weights.

Every document gets a key from a hash of its doc_id.  Within a source the
documents are laid out in key order, epoch after epoch, and the source takes
from that sequence exactly its budget of tokens: budget(source) =
floor(total * weight / sum of weights), repeating the source as often as it
takes; the last document is taken in part.

The order by key is a range partition: keys are uniform, so equal slices of the
key range hold equal shares of a source and a hot source is spread over many
slices.  Prefix sums of the slices tell how often each is taken; only in the one
slice of a source that its budget cuts are the documents sorted and summed up, a
1024th of them.  So no document moves: the slices are sent to the documents (if
they are more than ``common.BROADCAST_IDS``, a join by source and slice).

Tokens are maximal runs of characters other than blank, tab, line feed, form
feed and carriage return.  Nulls, empties and ties: a NULL source is a source of
its own, with weight ``default_weight``; texts without tokens (NULL, empty) and
rows with a NULL doc_id are never taken; equal keys go by doc_id; of rows that
repeat a doc_id the one with the least text that isn't NULL counts.  A source
without tokens can't be repeated: its budget stays unused.  Very long texts are
counted whole; an empty table gives an empty result.  Other columns may have any
name and type: ``mix`` passes them on, and where the table has columns called
epoch or taken already its own are called mix_epoch and mix_taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, like, one_each, plain, slices, small_side

KEY_BITS = 48
SLICE_BITS = 10


def random_key(seed: int) -> Column:
    """48 bits of md5(seed:doc_id), the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 12, 13, 32]] = True


def count_tokens(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), np.int64)
    for at, end, data, base in slices(texts):
        inside = ~_BLANK[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = base[:-1][base[:-1] < len(data)]
        starts[edge] = inside[edge]
        out[at:end] = np.diff(np.append(0, np.cumsum(starts))[base])
    return pa.array(out)


def token_count() -> Column:
    # called nondeterministic so that it isn't pushed into a filter and computed twice
    return F.arrow_udf(count_tokens, "long").asNondeterministic()(F.col("text"))


class _Layout:
    """How often each slice is taken, and what is taken of the documents in the slices that are cut."""

    def __init__(self, unique: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, budget: int | None = None, seed: int = 17, slice_bits: int = SLICE_BITS) -> None:
        self.slice = F.shiftright(random_key(seed), KEY_BITS - slice_bits)
        sized = unique.select("doc_id", "source", random_key(seed).alias("key"), token_count().alias("tokens"))
        self.sized = cut(sized.where("tokens > 0").withColumn("slice", F.shiftright("key", KEY_BITS - slice_bits)))
        sums = self.sized.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"))
        before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = cut(sums.withColumn("slice_start", F.coalesce(F.sum("slice_tokens").over(before), F.lit(0))))
        weight = F.lit(default_weight)
        for name, w in (weights or {}).items():
            weight = F.when(F.col("source") == name, w).otherwise(weight)
        sources = cut(sums.groupBy("source").agg(F.sum("slice_tokens").alias("source_tokens")).withColumn("weight", weight.cast("long")))
        total = sources.agg(F.sum("source_tokens").alias("t"), F.sum("weight").alias("w")).first()
        goal = (total["t"] or 0) if budget is None else budget
        # exact whole numbers: the product may pass 2**63
        share = F.floor(F.lit(goal).cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)") / F.lit(total["w"] or 1).cast("decimal(18,0)"))
        goals = sources.select(F.col("source").alias("s"), "source_tokens", share.cast("long").alias("goal"))
        full, rest = F.expr("goal div source_tokens"), F.expr("goal % source_tokens")
        times = F.when(F.col("slice_start") + F.col("slice_tokens") <= rest, full + 1).when(F.col("slice_start") >= rest, full)
        self.slices = small_side(sums.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("slice").alias("p"), "slice_start", "source_tokens", "goal", times.alias("times")))
        running = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        inside = self.on(self.sized, F.col("slice")).where("times is null").withColumn("start", F.col("slice_start") + F.coalesce(F.sum("tokens").over(running), F.lit(0)))
        # epoch e of a document starts at start + e * source_tokens and counts while that is below the goal
        inside = inside.where("start < goal").withColumn("cut_times", F.expr("(goal - 1 - start) div source_tokens + 1"))
        last = F.least("tokens", F.col("goal") - F.col("start") - (F.col("cut_times") - 1) * F.col("source_tokens"))
        self.documents = small_side(inside.select(F.col("doc_id").alias("cut_id"), F.col("tokens").alias("cut_tokens"), F.col("cut_times").alias("n"), last.alias("last")))

    def on(self, rows: DataFrame, place: Column) -> DataFrame:
        return rows.join(self.slices, F.col("source").eqNullSafe(F.col("s")) & (place == F.col("p")))

    def place(self, rows: DataFrame, tokens: Column) -> DataFrame:
        """``rows`` (doc_id, source, slice, ...), one for each epoch, with tokens, epoch and taken."""
        rows = self.on(rows, F.col("slice"))
        whole = rows.where("times > 0").select("*", tokens.alias("tokens")).where("tokens > 0").select("*", F.col("times").alias("n"), F.col("tokens").alias("last"))
        part = rows.where("times is null").join(self.documents, F.col("doc_id") == F.col("cut_id")).select(*rows.columns, F.col("cut_tokens").alias("tokens"), "n", "last")
        each = whole.unionByName(part).withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        return each.withColumn("taken", F.when(F.col("epoch") == F.col("n") - 1, F.col("last")).otherwise(F.col("tokens")))


def selection(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, source, epoch, tokens, taken): what each source gives, with every repetition.

    budget: tokens in all, by default those of the corpus; weights by source, default_weight for the others.
    """
    layout = _Layout(one_each(plain(docs, "doc_id", "text", "source").select("doc_id", "text", "source")), **params)
    return layout.place(layout.sized.withColumnRenamed("tokens", "counted"), F.col("counted")).select("doc_id", "source", "epoch", "tokens", "taken")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` plus epoch and taken; a part of a text is cut to its taken tokens."""
    unique = one_each(plain(docs, "doc_id", "text", "source", "n_chars"))
    layout = _Layout(unique, **params)
    rows = layout.place(unique.withColumn("slice", layout.slice), token_count())
    tokens = F.expr("slice(regexp_extract_all(text, '(?s)[ \\t\\n\\f\\r]*[^ \\t\\n\\f\\r]+', 0), 1, int(taken))")
    part = F.col("taken") < F.col("tokens")
    text = F.when(part, F.array_join(tokens, "")).otherwise(F.col("text"))
    columns = {c: F.col(c) for c in unique.columns}
    columns["text"] = text.alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length(text).cast(unique.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return like(rows.select(*columns.values(), "epoch", "taken"), docs, "epoch", "taken")
