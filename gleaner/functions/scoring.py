"""Scores and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import Bm25, Frontier, LinkGate, PageGate


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column, idf: Column, p: Bm25 = Bm25()) -> Column:
    score = idf * tf * F.lit(p.k1 + 1) / (tf + F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * length / average))
    return F.when((tf > 0) & (average > 0), score).otherwise(0.0)


def relevance(score: Column, gate: PageGate = PageGate()) -> Column:
    strong, index = F.lit(gate.strong), F.lit(gate.index)
    return (
        F.when(score >= strong, 6 + 4 * (score - strong) / (1 - strong))
        .when(score >= index, 3 + 2 * (score - index) / (strong - index))
        .otherwise(2 * score / index)
    )


def decision(score: Column, indexed: Column, gate: PageGate = PageGate()) -> Column:
    return F.when(indexed & (score >= gate.strong), "index_strong").when(indexed, "index_cautious").otherwise("reject_follow")


def exclusion(score: Column, english: Column, topical: Column, gate: PageGate = PageGate()) -> Column:
    """Why a page isn't indexed, the first reason that holds; NULL where it is."""
    return F.when(~english, "non_english").when(score < gate.index, "low_pageverdict_score").when(~topical, "off_topic")


def enqueue(score: Column, depth: Column, skipped: Column, gate: LinkGate = LinkGate()) -> Column:
    return ~skipped & (score >= gate.min_score) & (depth <= gate.max_depth)


def push_priority(score: Column, depth: Column, queued: Column, saved: Column, p: Frontier = Frontier()) -> Column:
    return score - F.lit(p.depth_weight) * depth - F.lit(p.host_weight) * F.log1p(queued + saved)


def label_from_rating(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating == 3, "skip").when(rating > 3, "positive")
