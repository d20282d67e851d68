"""What a caller can ask, in one place: each method returns a DataFrame; topics and events first collect the heat words of their
window's sample, the others start no job of their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import extract as X
from trendloom.operators import ingest as I
from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.sources import feeds


@dataclass
class TrendEngine:
    """Over articles (id, source_key, title, content, heat_value, prev_heat_value, published_at) and snapshots."""

    articles: DataFrame
    snapshots: DataFrame
    lexicon: X.Lexicon
    promoted: frozenset[str] = frozenset()
    blacklist: frozenset[str] = frozenset()
    pending: frozenset[str] = frozenset()  # words discovered in other windows and not yet promoted
    discovery: M.DiscoveryParams = field(default_factory=M.DiscoveryParams)

    def article_list(self, q: str | None = None, source: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return R.page(R.search(self.articles, (q or "")[:100], (source or "")[:64]), limit, offset)

    def article(self, id_: int) -> DataFrame:
        return self.articles.filter(F.col("id") == id_)

    def share(self, id_: int) -> DataFrame:
        return feeds.share_page(self.article(id_))

    def heat_history(self, id_: int, limit: int = 48) -> DataFrame:
        return R.heat_history(self.snapshots, id_, limit)

    def keywords(self, id_: int) -> DataFrame:
        return X.article_keywords(self._candidates(self.article(id_)))

    def surging(self, now: Column, limit: int = 20, hours: int = 6, min_heat: int = 5000) -> DataFrame:
        return R.surging(self.snapshots, now, hours if hours in (1, 6, 24) else 6, R.clamp(limit, 20, 50), min_heat)

    def hotlist(self, state: DataFrame, top: int = 15) -> DataFrame:
        return R.hotlist(state, R.clamp(top, 15, 30))

    def deltas(self, articles: DataFrame, now: Column, hours: int) -> DataFrame:
        current = articles.select(F.col("id").alias("article_id"), "heat_value")
        return R.window_deltas(current, self.snapshots, now - F.make_dt_interval(hours=F.lit(hours)))

    def _candidates(self, articles: DataFrame, discovered: frozenset[str] = frozenset()) -> DataFrame:
        return X.explode_candidates(articles, self.lexicon, discovered=discovered, promoted=self.promoted, blacklist=self.blacklist)

    def _words(self, words: Iterable[str]) -> DataFrame:
        return self.articles.sparkSession.createDataFrame([(w,) for w in sorted(words)], "word string")

    def dictionary(self) -> DataFrame:
        """word, freq of the lexicon's words."""
        return self.articles.sparkSession.createDataFrame([(w, f) for w, (f, _) in self.lexicon.words.items()], "word string, freq long")

    def heat_of(self, recent: DataFrame) -> DataFrame:
        """Heat words of a window's sample that no list or dictionary excludes (gram, n, articles, sources)."""
        support = M.ngram_support(X.segment_tokens(recent, self.lexicon), self.discovery, sorted(self.lexicon.stop) or None)
        known = self._words({*self.lexicon.stop, *self.lexicon.entries, *self.lexicon.generic, *self.blacklist})
        return M.heat_words(support, self.discovery, M.excluded_words(support, self.dictionary(), known), self.dictionary())

    def discovered(self, recent: DataFrame) -> frozenset[str]:
        """The heat words of a window's sample (a few hundred articles at most) and the pending ones, without the blacklist."""
        found = {r["gram"] for r in self.heat_of(recent).select("gram").collect()}
        return frozenset((found | self.pending) - self.blacklist)

    def topics(self, now: Column, hours: int = 24, limit: int = 12) -> DataFrame:
        hours = R.clamp(hours, 24, 168)
        recent = R.recent(self.articles, now, hours, R.sample_limit(hours))
        found = self._candidates(recent, self.discovered(recent))
        if self.lexicon.broad:
            found = found.filter(~F.col("label").isin(*self.lexicon.broad))
        t = M.accumulate_topics(found, recent, self.deltas(recent, now, hours))
        known = self._words({*self.lexicon.entries, *self.lexicon.places, *self.lexicon.verbs, *self.lexicon.topics, *self.promoted})
        t = M.drop_generic(t, self.dictionary(), self._words(self.blacklist), known)
        return M.rank_topics(M.absorb_labels(t), R.clamp(limit, 12, 30))

    def events(self, now: Column, hours: int = 24, limit: int = 8) -> DataFrame:
        recent = R.recent(self.articles, now, hours, R.sample_limit(hours))
        c = self._candidates(recent, self.discovered(recent))
        pick = lambda kind: c.filter(F.col("kind") == kind).select("id", F.col("label").alias("term"))
        tokens = X.segment_tokens(recent, self.lexicon)
        if self.lexicon.stop:  # stop words tell no titles apart
            tokens = tokens.join(self._words(self.lexicon.stop).withColumnRenamed("word", "token"), "token", "left_anti")
        return M.cluster_events(recent, pick("entity"), M.connectors(pick("keyword")), tokens, hours, limit, deltas=self.deltas(recent, now, hours))

    def storyline(self, term: str, now: Column, hours: int = 24) -> DataFrame:
        hours = 24 if hours < 0 else min(hours, 2160)
        label = self.lexicon.canonical(term)
        terms = [label, *self.lexicon.entries.get(label, ("", ()))[1]]
        found = R.drop_weak_content_matches(R.any_term(self.articles, terms, now, hours), terms)
        return M.storyline_summary(M.storyline(found, self.deltas(found, now, hours or 24)), term, hours)

    def related(self, term: str, now: Column, hours: int = 24, limit: int = 8) -> DataFrame:
        pool = R.recent(self.articles, now, hours, 300)
        matched = M.matching_articles(pool, [term])
        t = M.accumulate_topics(self._candidates(matched), matched).filter(F.lower("label") != term.lower())
        return M.rank_topics(M.absorb_labels(t), limit)

    def feed(self, q: str | None = None, source: str | None = None, limit: int = 50, site: str = "https://example.org") -> DataFrame:
        found = R.search(self.articles, q, source)
        if "url" not in found.columns:
            found = found.withColumn("url", F.concat(F.lit(f"{site}/articles/"), F.col("id")))
        if "heat" not in found.columns:
            found = found.withColumn("heat", F.col("heat_value"))
        return feeds.rss(found, "trends", site, limit)

    @staticmethod
    def heat_words(candidates: DataFrame, limit: int = 200) -> DataFrame:
        return candidates.orderBy(F.desc("total_hits"), F.desc("hit_days"), "word").limit(limit)

    @staticmethod
    def pending_words(candidates: DataFrame, blacklist: DataFrame, min_hits: int = 2) -> DataFrame:
        return candidates.filter(F.col("promoted_at").isNull() & (F.col("total_hits") >= min_hits)).join(blacklist.select("word"), "word", "left_anti")

    subscribe = staticmethod(I.add_subscription)
    unsubscribe = staticmethod(I.drop_subscription)
    announcements = staticmethod(R.active)


class CachedAnswers:
    """Answers of an engine that are kept for some seconds: the same question within that time reads the persisted rows."""

    def __init__(self, engine: TrendEngine, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.engine, self.seconds, self.clock = engine, seconds, clock
        self._kept: dict[tuple, tuple[DataFrame, float]] = {}

    def _ask(self, question: tuple, answer: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for q in [q for q, (_, at) in self._kept.items() if now - at >= self.seconds]:
            self._kept.pop(q)[0].unpersist()
        if question not in self._kept:
            self._kept[question] = (answer().persist(), now)
        return self._kept[question][0]

    def topics(self, now: Column, hours: int = 24, limit: int = 12) -> DataFrame:
        return self._ask(("topics", hours, limit), lambda: self.engine.topics(now, hours, limit))

    def events(self, now: Column, hours: int = 24, limit: int = 8) -> DataFrame:
        return self._ask(("events", hours, limit), lambda: self.engine.events(now, hours, limit))

    def forget(self) -> None:
        for df, _ in self._kept.values():
            df.unpersist()
        self._kept.clear()
