"""Evidence for free-text questions: scoring, gating, and what they add up to.

Signals are scored by what they contain of a question. Containment has no join key, and common words are in most signals,
so pairs are neither joined nor shuffled: questions and signals are dealt over parts of bounded size that meet two by two,
and a task hands on the best of each question alone (``retrieve``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S


@dataclass(frozen=True)
class Config:
    """UX-02. ``block``: questions of ``TEXT_BYTES`` that meet up to four times as many signals in one task, about; fewer if
    they are longer."""

    min_score: float = 30.0
    strong: tuple[str, ...] = ("medium", "high")
    blocked: tuple[str, ...] = ("high",)
    freshness_days: int = 7
    block: int = 1 << 13


#: Bytes of a text that count as one.
TEXT_BYTES = 256


def evidence_flags(df: DataFrame, now: Column, config: Config = Config()) -> DataFrame:
    """FLT-07, FLT-08, ST-13."""
    stale = F.col("fresh_until") < now
    weak = ~F.col("confidence").isin(*config.strong)
    low = F.col("trend_score") < config.min_score
    blocked = F.col("risk_flag").isin(*config.blocked)
    reason = F.concat_ws(",", F.when(stale, "stale"), F.when(weak, "low_confidence"), F.when(low, "low_trend_score"), F.when(blocked, "high_risk_blocked"))
    return df.withColumns({"is_stale": stale, "usable": ~(stale | weak | low | blocked), "blocked_by_safety": blocked, "rejection_reason": F.nullif(reason, F.lit(""))})


def _holding(texts: list[bytes], needles: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """Each text's place and a needle that it holds. Needles of one length are looked for one by one or, where they are
    more than the text has places for them, looked up place by place."""
    by_size: dict[int, set[bytes]] = {}
    for needle in needles:
        by_size.setdefault(len(needle), set()).add(needle)
    sizes = sorted(by_size.items())
    for k, text in enumerate(texts):
        for size, own in sizes:
            places = len(text) - size + 1
            if places <= 0:
                break
            held = [x for x in own if x in text] if len(own) <= places else own.intersection(text[i : i + size] for i in range(places))
            for needle in held:
                yield k, needle


def _places(pairs: Iterable[tuple[int, bytes]]) -> dict[bytes, np.ndarray]:
    out: dict[bytes, list[int]] = {}
    for k, x in pairs:
        out.setdefault(x, []).append(k)
    return {x: np.array(ks) for x, ks in out.items()}


def _first(points: np.ndarray, trend: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` places with points in order of score, as Spark sorts it downward (NaN, numbers, null), then of place."""
    at = np.flatnonzero(points)
    score = points[at] * 100.0 + trend[at]
    kind = np.where(unknown[at], 2, np.where(np.isnan(score), 0, 1))
    down = np.where(kind == 1, -score, np.where(kind == 0, -np.inf, np.inf))
    if len(at) > k > 0:
        near = down <= np.partition(down, k - 1)[k - 1]
        at, kind, down = at[near], kind[near], down[near]
    return at[np.lexsort((at, kind, down))[:k]]


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For some questions and some signals: each question's ``k`` best of these."""

    def run(asked: pa.Table, stock: pa.Table) -> pa.Table:
        stock = stock.sort_by("pos")
        lows, words = asked["low"].to_pylist(), asked["words"].to_pylist()
        keys, texts = stock["key"].to_pylist(), stock["text"].to_pylist()
        unknown = stock["trend_score"].is_null().to_numpy()
        trend = stock["trend_score"].fill_null(0.0).to_numpy()
        of_word = _places(_holding(texts, {w for own in words for w in own}))
        of_key = _places((j, key) for j, key in enumerate(keys) if key)
        worth = np.array([2 if key == b"" else 0 for key in keys], np.int64)
        points_of: dict[int, list[tuple[bytes, int]]] = {}
        for q, key in _holding(lows, of_key):
            points_of.setdefault(q, []).append((key, 2))
        named = list(of_key)
        place = {low: q for q, low in enumerate(lows)}
        for j, low in _holding(named, (low for low in lows if low)):
            if low != named[j]:  # which counts two
                points_of.setdefault(place[low], []).append((named[j], 1))
        rows, at, overlap = [], [], []
        for q, own in enumerate(words):
            points = worth.copy()
            for word, n in Counter(own).items():
                if word in of_word:
                    points[of_word[word]] += n
            for key, n in points_of.get(q, ()):
                points[of_key[key]] += n
            best = _first(points, trend, unknown, k)
            rows.append(np.full(len(best), q))
            at.append(best)
            overlap.append(points[best])
        rows, at, overlap = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, at, overlap))
        score = pa.array(overlap * 100.0 + trend[at], mask=unknown[at])
        return pa.table([asked["low"].take(pa.array(rows)), stock["pos"].take(pa.array(at)), pa.array(overlap), score], ["low", "pos", "overlap", "match_score"])

    return run


def _parts(texts: DataFrame, text: str, block: int) -> Column:
    """Over how many parts texts are dealt, by their number or, if long, their bytes, counted in the same job."""
    size = F.greatest(F.count("*"), F.floor(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / TEXT_BYTES))
    return texts.agg((F.floor(size / block) + 1).alias("n")).scalar()


def retrieve(queries: DataFrame, signals: DataFrame, now: Column, k: int = 5, config: Config = Config()) -> DataFrame:
    """JOIN-10, TOP-04: per question the ``k`` best signals, ties in input order.

    A question's words that stand in a signal's text count one each, repeated ones again; its keyword in the question
    counts two, else the question in its keyword one. ``queries``: query_id, query. ``signals``: signal columns and
    ``pos``, their order, which is theirs alone. Equal questions are scored once. A signal without a keyword is in
    every question.

    Every part of the questions meets every part of the signals in one task, which hands on a question's ``k`` best of
    these: what is shuffled are the questions once for each part of the signals, the signals once for each part of the
    questions, and the best, never pairs.
    """
    asked = queries.withColumn("__low", F.lower(S.strip(F.col("query"))))
    low = asked.select("__low").distinct().where("__low is not null")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("normalized_keyword", "topic_cluster", "trend_type", "signal_summary", "signal_evidence")]))
    own = signals.select("pos", F.lower("normalized_keyword").alias("key"), text.alias("text"), F.col("trend_score").cast("double").alias("trend_score"))
    n_asked, n_own = _parts(low, "__low", config.block), _parts(own, "text", 4 * config.block)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    words = F.filter(F.split("__low", r"(?U)\s+"), lambda t: t != "").cast("array<binary>")
    left = low.select(F.pmod(F.xxhash64("__low"), n_asked).alias("asked"), each(n_own).alias("held"), F.col("__low").cast("binary").alias("low"), words.alias("words"))
    right = own.select(each(n_asked).alias("asked"), F.pmod(F.xxhash64("pos"), n_own).alias("held"), "pos", F.col("key").cast("binary"), F.col("text").cast("binary"), "trend_score")
    made = f"low binary, pos {signals.schema['pos'].dataType.simpleString()}, overlap long, match_score double"
    best = left.groupBy("asked", "held").cogroup(right.groupBy("asked", "held")).applyInArrow(_best(k), made)
    rank = Window.partitionBy("__low").orderBy(F.desc("match_score"), "pos")
    best = best.select(F.col("low").cast("string").alias("__low"), "pos", "overlap", "match_score").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    out = asked.join(best, "__low").drop("__low").join(signals, "pos")
    return evidence_flags(out, now, config)


def answer(queries: DataFrame, evidence: DataFrame, hook: Callable[[Column], Column] | None = None) -> DataFrame:
    """AGG-21, S-45, UX-01: behavior and summary per question; ``hook`` may add a policy output from them."""
    first = F.min(F.when(F.col("usable"), F.struct("rank", "signal_id", "normalized_keyword", "source_platform")))
    top = F.min(F.struct("rank", "signal_id", "rejection_reason"))
    found = evidence.groupBy("query_id").agg(first.alias("selected"), top.alias("top"), F.bool_or("blocked_by_safety").alias("high"), F.count("*").alias("n"))
    out = queries.join(found, "query_id", "left")
    behavior = F.when(F.col("selected").isNotNull(), "trend_supported").when(F.coalesce("high", F.lit(False)), "trend_filtered_for_safety").otherwise("trend_weak_or_missing")
    summary = (
        F.when(F.col("selected").isNotNull(), F.concat(F.lit("Selected "), F.col("selected.normalized_keyword"), F.lit(" trend evidence from "), F.col("selected.source_platform"), F.lit(".")))
        .when(F.coalesce("high", F.lit(False)), "Trend evidence was retrieved but filtered from the strong-evidence path.")
        .otherwise("No strong trend evidence was selected; downstream QA should degrade gracefully.")
    )
    out = out.select("query_id", "query", behavior.alias("behavior_flag"), summary.alias("summary"), F.coalesce("n", F.lit(0)).alias("n_evidence"), F.col("top.signal_id").alias("top_signal_id"), F.col("top.rejection_reason").alias("top_rejection_reason"), F.col("selected.signal_id").alias("selected_signal_id"))
    return out if hook is None else out.withColumn("policy_output", hook(F.struct("*")))


#: S-45: what a context block tells of a signal.
CONTEXT = "signal_id normalized_keyword topic_cluster trend_type signal_summary signal_evidence source_platform source_url confidence risk_flag trend_score fresh_until rejection_reason".split()


def context_blocks(queries: DataFrame, evidence: DataFrame, limit: int = 5) -> DataFrame:
    """S-45: what a question's answer rests on: ``query_id, query, behavior_flag, summary, items``, as JSON text, and
    ``block``, the same as Markdown; its first ``limit`` signals in order of rank, a few whatever the store holds."""
    items = evidence.where(F.col("rank") <= limit).withColumn("fresh_until", F.date_format("fresh_until", "yyyy-MM-dd'T'HH:mm:ss"))
    listed = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*CONTEXT).alias("item")))).alias("ranked"))
    out = answer(queries, evidence).select("query_id", "query", "behavior_flag", "summary").join(listed, "query_id", "left")
    held = F.coalesce(F.transform("ranked", lambda x: x["item"]), F.array().cast(listed.schema["ranked"].dataType.elementType["item"].dataType.simpleString().join(("array<", ">"))))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    line = lambda x: F.concat(F.lit("- "), text(x["normalized_keyword"]), F.lit(" ("), text(x["source_platform"]), F.lit(", "), text(x["confidence"]), F.lit("): "), text(x["signal_summary"]))
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("query", F.lit(""))), F.col("behavior_flag"), F.col("summary"), F.nullif(F.array_join(F.transform("items", line), "\n"), F.lit("")))
    return out.withColumn("items", held).select("query_id", "query", "behavior_flag", "summary", F.to_json("items").alias("items"), block.alias("block"))


def search(signals: DataFrame, now: Column, min_confidence: str | None = None, fresh_only: bool = False, min_score: float | None = None, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """FLT-17, D-08: optional filters of the signal store; with ``limit`` or ``offset`` a page, latest first, then by id."""
    level = {"low": 0, "medium": 1, "high": 2}
    for name, value in equal.items():
        signals = signals.where(F.col(name) == value) if value else signals
    if min_confidence:
        signals = signals.where(S.lookup(level, F.col("confidence")) >= level[min_confidence])
    signals = signals.where(F.col("fresh_until") >= now) if fresh_only else signals
    signals = signals if min_score is None else signals.where(F.col("trend_score") >= min_score)
    if limit is None and not offset:
        return signals
    page = signals.orderBy(F.desc("observed_at"), "signal_id").offset(offset)
    return page if limit is None else page.limit(limit)
