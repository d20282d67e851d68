"""Event clustering against a plain statement of its rules, on random headlines."""

import collections
import datetime as dt
import itertools
import math
import random

import pytest

from trendloom.operators import mining as M

T0 = dt.datetime(2024, 1, 1)


def cosine(a, b):
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if a and b else 0.0


def plain(articles, entities, keywords, hours, limit):
    """(ids, count, n_sources, title, score) of the groups in order."""
    words = {i: a["title"].split() for i, a in articles.items()}
    df = collections.Counter(t for w in words.values() for t in set(w))
    n = len(articles)
    vector = {i: {t: c / len(w) * ((math.log(n / df[t]) + 1) if n >= 5 else 1.0) for t, c in collections.Counter(w).items()} for i, w in words.items()}
    reach = collections.Counter(t for ts in entities.values() for t in ts)
    hub = {t for t, c in reach.items() if t in M.STATIC_HUBS or (n >= M.hub_least(hours) and c > 0.4 * n)}
    least = 0.28 if hours <= 3 else 0.30 if hours <= 6 else 0.35
    linked = collections.defaultdict(set)
    for a, b in itertools.combinations(sorted(articles), 2):
        e, k = (entities[a] & entities[b]) - hub, keywords[a] & keywords[b]
        if not e and not k:
            continue
        rest = [{t: w for t, w in vector[i].items() if not any(t in x.lower() for x in e)} for i in (a, b)]
        semantic = cosine(*rest) if min(map(len, rest)) > 1 else cosine(vector[a], vector[b])
        h = abs((articles[a]["at"] - articles[b]["at"]).total_seconds()) / 3600
        near = next((s for most, s in ((1, 1.0), (3, 0.8), (6, 0.6), (12, 0.4), (24, 0.2)) if h <= most), 0.05)
        weight = sum({0: 1.0, 1: 1.0, 2: 1.0, 3: 1.5, 4: 2.0}.get(len(x), 2.5) for x in e)
        score = 0.35 * min(weight / 2, 1) + 0.35 * semantic + 0.15 * min(len(k) / 2, 1) + 0.10 * near + 0.05 * (articles[a]["source"] != articles[b]["source"])
        if (e or semantic >= 0.14) and score >= least and semantic >= 0.05:
            linked[a].add(b)
            linked[b].add(a)
    groups, seen = [], set()
    for i in sorted(linked):
        if i in seen:
            continue
        todo, part = [i], set()
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += linked[x]
        seen |= part
        kept = []
        for x in sorted(part, key=lambda x: (-articles[x]["heat"], x)):
            own = set(words[x])
            same = [y for y in kept if articles[y]["source"] == articles[x]["source"]]
            if not any("".join(words[y]) == "".join(words[x]) or (len(own & set(words[y])) >= 2 and 4 * len(own & set(words[y])) >= 3 * min(len(own), len(set(words[y])))) for y in same):
                kept.append(x)
        if len(kept) < 2:
            continue
        sources = len({articles[x]["source"] for x in kept})
        base = sum(2 * articles[x]["heat"] if articles[x]["heat"] else 10_000 for x in kept)
        best = max(kept, key=lambda x: (articles[x]["heat"], -x))
        groups.append((sorted(kept), len(kept), sources, articles[best]["title"], base * {1: 1, 2: 2}.get(sources, 4), max(articles[x]["at"] for x in kept), i))
    order = (lambda g: (-g[2], -g[5].timestamp(), g[6])) if hours <= 3 else (lambda g: (-g[4], -g[1], g[6]))
    return [g[:5] for g in sorted(groups, key=order)[:limit]]


@pytest.mark.parametrize(("hours", "seed"), [(2, 1), (6, 2), (24, 3), (24, 4)])
def test_groups_equal_the_rules(spark, hours, seed):
    r = random.Random(seed)
    topics = [[f"{a}{b}" for b in ("storm", "coast", "rescue", "harbour", "night")] for a in ("al", "be", "ce", "de", "ef", "gi")]
    articles, entities, keywords = {}, {}, {}
    for i in range(45):
        own = r.choice(topics)
        title = r.sample(own, r.randrange(2, 5)) + ["of"] * r.randrange(2) + [r.choice(r.choice(topics))] * (r.random() < 0.3)
        if r.random() < 0.2 and articles:
            title = articles[r.choice(list(articles))]["title"].split()
        articles[i] = {"title": " ".join(title), "source": r.choice("abc"), "heat": r.choice([0, 10, 50, 50, 900]), "at": T0 + dt.timedelta(minutes=r.randrange(60 * hours))}
        entities[i] = {t for t in title if t.endswith(("storm", "coast"))} | ({"AI"} if r.random() < 0.5 else set()) | ({"wide"} if r.random() < 0.6 else set())
        keywords[i] = {t for t in title if t.endswith(("rescue", "harbour", "of"))}
    rows = [(i, a["source"], a["title"], a["heat"], 0, a["at"]) for i, a in articles.items()]
    df = spark.createDataFrame(rows, "id long, source_key string, title string, heat_value long, prev_heat_value long, published_at timestamp_ntz")
    terms = lambda d: spark.createDataFrame([(i, t) for i, ts in d.items() for t in ts], "id long, term string")
    got = M.cluster_events(df, terms(entities), terms(keywords), M.letter_tokens(df), hours, 8).collect()
    want = plain(articles, entities, keywords, hours, 8)
    assert len(want) >= 2
    assert [(g.ids, g["count"], g.n_sources, g.title, g.score) for g in got] == want
