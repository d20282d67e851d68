"""Mining across documents: emerging n-grams, topics, event clusters, storylines, parameter evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.scalar import article_score, diversity_boost, is_numeric_measure, momentum, term_weight, time_proximity, weighted_overlap
from trendloom.operators.graph import checkpoint, components

# fixed values: dictionary frequency up to which a word needs so many articles (absent: ABSENT_NEEDS)
NEEDS = ((500, 2), (2000, 3), (5000, 4), (8000, 8))
NEEDS_ELSE, ABSENT_NEEDS_SHORT, ABSENT_NEEDS_LONG = 12, 2, 1
GENERIC_FREQUENCY = 600
# fixed values: dictionary frequency above which a word is no discovery, by its length, and that of both halves of a four-character word
COMMON_WORDS, COMMON_WORDS_LONGER, COMMON_HALF = ((2, 200), (3, 400)), 300, 1000
# fixed values: entities that never link articles; documents from which on frequent entities do not either, by window hours
STATIC_HUBS = ("中国", "美国", "北京", "上海", "AI")
HUB_SHARE, HUB_LEAST, HUB_LEAST_ELSE = 0.4, ((3, 8), (6, 12)), 20
# fixed values: parts of a pair's score, and least scores by window hours
WEIGHTS = {"entity": 0.35, "semantic": 0.35, "keyword": 0.15, "time": 0.10, "source": 0.05}
LINK_SCORES = ((3, 0.28), (6, 0.30))
LINK_SCORE_ELSE, LEAST_SEMANTIC, LEAST_SEMANTIC_ALONE = 0.35, 0.05, 0.14


@dataclass(frozen=True)
class DiscoveryParams:
    min_articles: int = 2
    min_sources: int = 2
    min_len: int = 2
    max_len: int = 4
    max_ngram_len: int = 5


def letter_tokens(articles: DataFrame) -> DataFrame:
    """id, source_key, pos, token: runs of letters of the title in lower case."""
    return articles.select("id", "source_key", F.posexplode(F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("pos", "token"))


def ngram_support(tokens: DataFrame, params: DiscoveryParams, stop: list[str] | None = None) -> DataFrame:
    """gram, n, articles, sources of the admissible 1- to 3-grams of neighbouring tokens.

    Neighbours come from a window within the article, already one group; distinct (gram, id) first, so that the counts
    need no distinct aggregation over the text."""
    w = Window.partitionBy("id").orderBy("pos")
    t = tokens.withColumn("t2", F.lead("token", 1).over(w)).withColumn("t3", F.lead("token", 2).over(w))
    grams = F.array(
        F.struct(F.lit(1).alias("n"), F.col("token").alias("gram"), F.array("token").alias("parts")),
        F.struct(F.lit(2).alias("n"), F.concat("token", "t2").alias("gram"), F.array("token", "t2").alias("parts")),
        F.struct(F.lit(3).alias("n"), F.concat("token", "t2", "t3").alias("gram"), F.array("token", "t2", "t3").alias("parts")),
    )
    g = t.select("id", "source_key", F.explode(grams).alias("g")).select("id", "source_key", "g.n", "g.gram", "g.parts").filter("gram is not null")
    size = F.length("gram")
    fits = F.when(F.col("n") == 1, size.between(params.min_len, params.max_len)).when(F.col("n") == 2, size.between(params.min_len, params.max_ngram_len)).otherwise(size.between(3, params.max_ngram_len))
    g = g.filter(fits)
    if stop:
        g = g.filter((F.col("n") == 1) | ~F.arrays_overlap("parts", F.array(*map(F.lit, stop))))
    once = g.select("gram", "n", "id", "source_key").distinct()
    return once.groupBy("gram", "n").agg(F.count("*").alias("articles"), F.count_distinct("source_key").alias("sources"))


def required_articles(frequency: Column, size: Column) -> Column:
    """How many articles a word needs, by how common the dictionary has it."""
    out = F.when(frequency.isNull(), F.when(size >= 3, ABSENT_NEEDS_LONG).otherwise(ABSENT_NEEDS_SHORT))
    for most, need in NEEDS:
        out = out.when(frequency <= most, need)
    return out.otherwise(NEEDS_ELSE)


def heat_words(support: DataFrame, params: DiscoveryParams, excluded: DataFrame | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """Words that several articles of several sources have; n-grams take the place of their own fragments.

    ``excluded`` (word) leaves words out, ``dictionary`` (word, freq) sets how many articles a single word needs."""
    s = support
    if excluded is not None:
        s = s.join(excluded.select(F.col("word").alias("gram")), "gram", "left_anti")
    need = F.lit(params.min_articles)
    if dictionary is not None:
        s = s.join(dictionary.select(F.col("word").alias("gram"), "freq"), "gram", "left")
        need = F.when(F.col("n") == 1, required_articles(F.col("freq"), F.length("gram"))).otherwise(need)
    accepted = s.filter((F.col("articles") >= need) & (F.col("sources") >= params.min_sources)).select("gram", "n", "articles", "sources")
    merged = accepted.groupBy("gram").agg(F.max("n").alias("n"), F.max("articles").alias("articles"), F.max("sources").alias("sources"), F.max(F.when(F.col("n") == 1, F.col("articles"))).alias("own"))
    wide = merged.filter("n > 1").select(F.col("gram").alias("whole"), F.col("articles").alias("whole_articles"))
    # every shorter piece of an accepted n-gram; lengths are bounded by the parameters
    size = F.length("whole")
    pieces = wide.select("whole", "whole_articles", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda a: F.transform(F.sequence(F.lit(1), size - a + 1), lambda k: F.substring("whole", a, k))))).alias("gram")).filter("gram <> whole")
    absorbed = merged.join(pieces.groupBy("gram").agg(F.max("whole_articles").alias("by")), "gram").filter(F.coalesce("own", F.lit(0)) <= F.col("by"))
    return merged.drop("own").join(absorbed.select("gram"), "gram", "left_anti")


def excluded_words(words: DataFrame, dictionary: DataFrame, lists: DataFrame | None = None, column: str = "gram") -> DataFrame:
    """Which of the words (column gram) are no discoveries (column word): those on a list (word), numbers and measures,
    words that the dictionary (word, freq) has as common for their length, and four Han characters of two common halves.

    Words meet lists and dictionary by equality; nothing is collected."""
    w = words.select(F.col(column).alias("word")).distinct()
    d = dictionary.groupBy("word").agg(F.max("freq").alias("freq"))
    size = F.length("word")
    bound = F.when(size == COMMON_WORDS[0][0], COMMON_WORDS[0][1]).when(size == COMMON_WORDS[1][0], COMMON_WORDS[1][1]).when(size >= 4, COMMON_WORDS_LONGER)
    common = w.join(d, "word").filter(F.col("freq") > bound).select("word")
    number = w.filter(F.col("word").rlike(r"^\p{Nd}+$") | is_numeric_measure(F.col("word"))).select("word")
    halves = w.filter((size == 4) & F.col("word").rlike(r"^\p{IsHan}+$")).select("word", F.substring("word", 1, 2).alias("_1"), F.substring("word", 3, 2).alias("_2"))
    half = d.filter(F.col("freq") > COMMON_HALF)
    phrases = halves.join(half.select(F.col("word").alias("_1")), "_1", "left_semi").join(half.select(F.col("word").alias("_2")), "_2", "left_semi").select("word")
    out = common.union(number).union(phrases)
    if lists is not None:
        out = out.union(w.join(lists.select("word"), "word", "left_semi"))
    return out.distinct()


def drop_generic(topics: DataFrame, dictionary: DataFrame, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Topics without labels that are on the blacklist (word), or common in the dictionary (word, freq) and on no whitelist (word)."""
    common = dictionary.filter(F.col("freq") > GENERIC_FREQUENCY).select(F.col("word").alias("label")).distinct()
    if whitelist is not None:
        common = common.join(whitelist.select(F.col("word").alias("label")), "label", "left_anti")
    gone = common if blacklist is None else common.union(blacklist.select(F.col("word").alias("label")))
    return topics.join(gone.distinct(), "label", "left_anti").select(*topics.columns)


def accumulate_topics(candidates: DataFrame, articles: DataFrame, deltas: DataFrame | None = None, min_count: int = 2) -> DataFrame:
    """Topics by (kind, label): count, score, window delta, new articles, sources by count, related terms, sample.

    candidates: id, kind, label, related (array). Articles join once per candidate; the rest is one aggregation. Related
    terms go their own way, the first four of each topic being cut out before they meet, so that no topic gathers them all."""
    once = candidates.select("id", "kind", "label").distinct()
    terms = candidates.select("kind", "label", F.explode("related").alias("_t")).filter(F.col("_t") != F.col("label")).distinct()
    four = terms.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "label").orderBy("_t"))).filter("_n <= 4")
    near = four.groupBy("kind", "label").agg(F.array_sort(F.collect_list("_t")).alias("_r"))
    a = articles.select("id", "source_key", "title", "heat_value", "published_at", article_score(F.col("heat_value"), F.col("prev_heat_value")).alias("score"))
    j = once.join(a, "id")
    if deltas is not None:
        j = j.join(deltas.select(F.col("article_id").alias("id"), "delta", "is_new"), "id", "left")
    else:
        j = j.withColumn("delta", F.lit(0)).withColumn("is_new", F.lit(False))
    per = j.groupBy("kind", "label", "source_key").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), F.sum(F.coalesce("delta", F.lit(0))).alias("delta"), F.sum(F.when(F.col("is_new"), 1).otherwise(0)).alias("new"),
        F.max(F.struct("heat_value", F.negative("id").alias("nid"), "title")).alias("top"), F.max("published_at").alias("latest"),
    )
    topics = per.groupBy("kind", "label").agg(
        F.sum("n").alias("count"), F.sum("score").alias("score"), F.sum("delta").alias("score_delta"), F.sum("new").alias("count_delta"),
        F.array_sort(F.collect_list(F.struct(F.negative("n").alias("k"), "source_key"))).alias("_s"), F.max("top").alias("_t"), F.max("latest").alias("latest"),
    )
    return topics.filter((F.col("count") >= min_count) & (F.col("score") != 0)).join(near, ["kind", "label"], "left").select(
        "kind", "label", "count", "score", "score_delta", "count_delta", momentum(F.col("score_delta"), F.col("count_delta")).alias("momentum"),
        F.transform("_s", lambda x: F.struct(x["source_key"].alias("source_key"), (-x["k"]).alias("count"))).alias("sources"),
        F.coalesce("_r", F.array().cast("array<string>")).alias("related"), F.negative("_t.nid").alias("sample_id"), F.col("_t.title").alias("sample_title"), "latest",
    )


def absorb_labels(topics: DataFrame) -> DataFrame:
    """Topics without those whose label strictly contains another topic's label: pieces of labels, of the lengths that labels have, meet labels by equality."""
    labels = topics.select("label").distinct()
    size = F.length("label")
    # one row: a set of numbers, however many labels there are
    lengths = labels.agg(F.collect_set(size).alias("lengths"))
    starts = F.transform("lengths", lambda n: F.when(n <= size, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda a: F.substring("label", a, n))).otherwise(F.array().cast("array<string>")))
    pieces = labels.crossJoin(F.broadcast(lengths)).select(F.col("label").alias("whole"), F.explode(F.flatten(starts)).alias("label")).filter("label <> whole").distinct()
    over = pieces.join(labels, "label", "left_semi").select(F.col("whole").alias("label")).distinct()
    return topics.join(over, "label", "left_anti")


def rank_topics(topics: DataFrame, limit: int) -> DataFrame:
    return topics.orderBy(F.desc("count"), F.desc("score"), "label", "kind").limit(limit)


def term_vectors(tokens: DataFrame, least_docs: int = 5) -> DataFrame:
    """id, token, weight: term frequency by kept tokens times ln(N / df) + 1; plain frequency for few documents."""
    tf = tokens.groupBy("id", "token").agg(F.count("*").alias("c"))
    total = tokens.groupBy("id").agg(F.count("*").alias("total"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = tokens.agg(F.count_distinct("id").alias("docs"))
    idf = F.when(F.col("docs") >= least_docs, F.log(F.col("docs") / F.col("df")) + 1).otherwise(1.0)
    return tf.join(total, "id").join(df, "token").crossJoin(F.broadcast(n)).select("id", "token", (F.col("c") / F.col("total") * idf).alias("weight"), "df")


def hub_least(window_hours: int) -> int:
    """Documents that a window must have for its frequent entities to count as hubs."""
    return next((n for h, n in HUB_LEAST if window_hours <= h), HUB_LEAST_ELSE)


def hubs(terms: DataFrame, share: float = HUB_SHARE, least_docs: int = HUB_LEAST_ELSE, docs: DataFrame | None = None, static: tuple[str, ...] = STATIC_HUBS) -> DataFrame:
    """Terms (id, term) that do not tell documents apart: the static ones, and those that more than a share of all
    documents have (``docs``: id; those with terms by default), if there are enough documents."""
    df = terms.select("id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = (terms if docs is None else docs).agg(F.count_distinct("id").alias("docs"))
    frequent = (F.col("docs") >= least_docs) & (F.col("df") > F.col("docs") * share)
    return df.crossJoin(F.broadcast(n)).filter(frequent | F.col("term").isin(*static)).select("term", "df")


def candidate_pairs(terms: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of documents that share a connecting term (id, term), of which hubs should be left out before."""
    t = terms.select("id", "term").distinct()
    pairs = t.select("term", F.col("id").alias("a")).join(t.select("term", F.col("id").alias("b")), "term").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("term")).alias("shared"))


def cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b) with the cosine of their term vectors."""
    norm = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    va = vectors.select(F.col("id").alias("a"), "token", F.col("weight").alias("wa"))
    vb = vectors.select(F.col("id").alias("b"), "token", F.col("weight").alias("wb"))
    dot = pairs.select("a", "b").join(va, "a").join(vb, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    n = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col("id").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("id").alias("b"), F.col("norm").alias("nb")), "b", "left")
    return n.withColumn("semantic", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))).drop("dot", "na", "nb")


def residual_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b, entities) with ``semantic``: the cosine of their vectors without the terms within shared entities;
    the plain cosine where that leaves a side one term or none."""
    plain = cosine(pairs, vectors)
    v = vectors.select("id", "token", "weight")
    sides = pairs.select("a", "b", "entities")

    def rest(end: str, weight: str) -> DataFrame:
        own = sides.join(v.select(F.col("id").alias(end), "token", F.col("weight").alias(weight)), end)
        return own.filter(~F.exists("entities", lambda e: F.contains(F.lower(e), F.col("token")))).drop("entities")

    ra, rb = rest("a", "wa"), rest("b", "wb")
    na = ra.groupBy("a", "b").agg(F.sqrt(F.sum(F.col("wa") * F.col("wa"))).alias("na"), F.count("*").alias("ca"))
    nb = rb.groupBy("a", "b").agg(F.sqrt(F.sum(F.col("wb") * F.col("wb"))).alias("nb"), F.count("*").alias("cb"))
    dot = ra.join(rb, ["a", "b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    j = plain.join(na, ["a", "b"], "left").join(nb, ["a", "b"], "left").join(dot, ["a", "b"], "left")
    left = (F.coalesce("ca", F.lit(0)) > 1) & (F.coalesce("cb", F.lit(0)) > 1)
    value = F.when(left, F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))).otherwise(F.col("semantic"))
    return j.withColumn("semantic", value).drop("na", "nb", "ca", "cb", "dot")


def title_words(title: Column) -> Column:
    """Distinct words of a title without punctuation around them."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")))


def repeated_titles(titles: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): pairs of titles (keys, id, _bare, _words, _order) of one group, a first in order, that nearly repeat each other: the
    same letters and digits, or two words and three quarters of the shorter title's words in common.

    A pair shares two of the shorter title's rarest words, of so many that the others alone were too few; each title offers
    the couples of these few to the couples of those that are no shorter."""
    freq = titles.select(*keys, F.explode("_words").alias("_w")).groupBy(*keys, "_w").agg(F.count("*").alias("_f"))
    words = titles.select(*keys, "id", F.explode("_words").alias("_w")).join(freq, [*keys, "_w"])
    ranked = words.groupBy(*keys, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_w"))), lambda x: x["_w"]).alias("_r"))  # words of a title
    size = F.size("_r")
    few = size - F.greatest(F.lit(2), F.ceil(size * 0.75).cast("int")) + 2

    def couples(r: Column) -> Column:
        return F.explode(F.flatten(F.transform(r, lambda x, i: F.transform(F.slice(r, i + 2, F.size(r)), lambda y: F.xxhash64(x, y)))))

    offered = ranked.filter(size >= 2).select(*keys, F.col("id").alias("x"), size.alias("_sx"), couples(F.slice("_r", F.lit(1), few)).alias("_c"))
    held = ranked.filter(size >= 2).select(*keys, F.col("id").alias("y"), size.alias("_sy"), couples(F.col("_r")).alias("_c"))
    met = offered.join(held, [*keys, "_c"]).filter((F.col("_sx") <= F.col("_sy")) & (F.col("x") != F.col("y"))).select(*keys, "x", "y").distinct()
    side = lambda end: titles.select(*keys, F.col("id").alias(end), F.col("_words").alias(f"_w{end}"), F.col("_order").alias(f"_o{end}"))
    both = met.join(side("x"), [*keys, "x"]).join(side("y"), [*keys, "y"])
    n = F.size(F.array_intersect("_wx", "_wy"))
    near = both.filter((n >= 2) & (4 * n >= 3 * F.least(F.size("_wx"), F.size("_wy"))))
    same = side("x").join(titles.select(*keys, F.col("id").alias("x"), "_bare"), [*keys, "x"]).join(side("y").join(titles.select(*keys, F.col("id").alias("y"), "_bare"), [*keys, "y"]), [*keys, "_bare"]).filter("x <> y")
    pairs = near.select(*keys, "x", "y", "_ox", "_oy").unionByName(same.select(*keys, "x", "y", "_ox", "_oy"))
    first = F.col("_ox") < F.col("_oy")
    return pairs.select(*keys, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()


def collapse_same_source(members: DataFrame) -> DataFrame:
    """Members (component, source_key, id, title, heat_value, ...) without those whose title nearly repeats a hotter one of the
    same component and source that stays; ids are unique.

    Of titles with the same words and letters the hottest stands for all. Then rounds: a title without an undecided hotter neighbour
    stays, its neighbours go and take their links with them, until no link is left."""
    keys = ["component", "source_key"]
    bare = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]", "")
    order = F.struct(F.coalesce(-F.col("heat_value"), F.lit(float("inf"))).cast("double").alias("h"), "id")
    # groups may be null: they meet like others
    t = members.select(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys), "id", bare.alias("_bare"), title_words(F.col("title")).alias("_words"), order.alias("_order"))
    first = checkpoint(t.groupBy(*keys, "_bare", F.array_sort("_words").alias("_sorted")).agg(F.min_by(F.struct("id", "_words", "_order"), "_order").alias("_t")).select(*keys, "_bare", "_t.*"))
    links = checkpoint(repeated_titles(first, keys).select("a", "b"))
    gone: DataFrame | None = None
    while links.limit(1).count():
        stay = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        drop = checkpoint(links.join(stay, "a", "left_semi").select("b").distinct())
        gone = drop if gone is None else gone.unionByName(drop)
        links = checkpoint(links.join(drop, "b", "left_anti").join(drop.select(F.col("b").alias("a")), "a", "left_anti"))
    kept = first.select("id") if gone is None else first.select("id").join(gone.select(F.col("b").alias("id")), "id", "left_anti")
    return members.join(kept, "id", "left_semi").select(*members.columns)


#: Titles of one term that a task compares with the others of the term.
POSTING = 2_000


def similar_titles(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of term vectors (id, token, weight >= 0): (id, class) with the smallest id of equal vectors, and (a, b, semantic), a < b: the
    classes whose cosine is at least ``least``. Exact, for any number of titles.

    Terms are ordered by how few titles have them. Two titles that are similar by one shared term alone both have most of their
    length in it and meet by it. Others share two terms or more: each title offers couples of its terms, where the first with all
    from the second on has at least ``least`` of its length, as the first two shared terms of a similar pair always have on both
    sides. Long lists of titles of one couple are split over tasks."""
    whole = vectors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", F.col("weight").cast("double").alias("weight")))).alias("_v"))
    groups = checkpoint(whole.groupBy("_v").agg(F.min("id").alias("class")))
    member = whole.join(groups, "_v").select("id", "class")
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["weight"] * x["weight"])
    norm = F.sqrt(square(F.col("_v")))
    unit = checkpoint(groups.withColumn("_norm", norm).filter("_norm > 0").select("class", F.transform(F.filter("_v", lambda x: x["weight"] > 0), lambda x: F.struct(x["token"].alias("token"), (x["weight"] / F.col("_norm")).alias("weight"))).alias("_v")))
    terms = unit.select("class", F.explode("_v").alias("t")).select("class", "t.token", "t.weight")
    df = terms.groupBy("token").agg(F.count("*").alias("df"))
    ordered = checkpoint(terms.join(df, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token", "weight"))).alias("_o")))  # terms of a title
    o, low = F.col("_o"), least - 1e-9

    def couples(x: Column, i: Column) -> Column:
        after = F.slice(o, i + 2, F.size(o))
        some = F.transform(after, lambda y, k: F.struct(F.xxhash64(x["token"], y["token"]).alias("key"), x["weight"].alias("w1"), y["weight"].alias("w2"), F.sqrt(square(F.slice(o, i + k + 3, F.size(o)))).alias("later"), x["df"].alias("df")))
        return F.filter(some, lambda c: c["w1"] * c["w1"] + c["w2"] * c["w2"] + c["later"] * c["later"] >= low * low)

    single = F.transform(F.filter(o, lambda x: x["weight"] >= low), lambda x: F.struct(F.xxhash64(x["token"]).alias("key"), x["weight"].alias("w1"), F.lit(0.0).alias("w2"), F.lit(0.0).alias("later"), x["df"].alias("df")))
    offered = ordered.select("class", F.explode(F.concat(single, F.flatten(F.transform(o, couples)))).alias("c")).select("class", "c.*")
    parts = F.ceil(F.col("df") / POSTING).cast("int")
    left = offered.select(F.col("class").alias("a"), "key", "w1", "w2", "later", F.pmod(F.xxhash64("class"), parts).cast("int").alias("_part"))
    right = offered.select(F.col("class").alias("b"), "key", F.col("w1").alias("v1"), F.col("w2").alias("v2"), F.col("later").alias("_rest"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    reach = F.col("w1") * F.col("v1") + F.col("w2") * F.col("v2") + F.col("later") * F.col("_rest")
    met = left.join(right, ["key", "_part"]).filter((F.col("a") < F.col("b")) & (reach >= low)).select("a", "b").distinct()
    side = lambda end: unit.select(F.col("class").alias(end), F.col("_v").alias(f"_v{end}"))
    both = met.join(side("a"), "a").join(side("b"), "b").withColumn("_m", F.map_from_entries("_vb"))
    dot = F.aggregate("_va", F.lit(0.0), lambda acc, x: acc + x["weight"] * F.coalesce(F.try_element_at("_m", x["token"]), F.lit(0.0)))
    return member, both.select("a", "b", dot.alias("semantic")).filter(F.col("semantic") >= least)


def similar_links(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class, links): each title with its class and the number of other titles at least so similar, those of its class included."""
    size = member.groupBy("class").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    far = both.join(size.select(F.col("class").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("class")).agg(F.sum("m").alias("m"))
    links = size.join(far, "class", "left").select("class", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).cast("bigint").alias("links"))
    return member.join(links, "class").select("id", "class", "links")


def connectors(keywords: DataFrame, least_len: int = 3, stop: list[str] | None = None) -> DataFrame:
    """Keywords (id, term) that may link articles: long enough, no number, not a stop word."""
    k = keywords.filter((F.length("term") >= least_len) & ~F.col("term").rlike(r"^[\p{Nd}.%]+$"))
    return k.filter(~F.lower("term").isin(*stop)) if stop else k


def score_pairs(pairs: DataFrame, articles: DataFrame, window_hours: int = 24) -> DataFrame:
    """Pairs with their score and whether they link (pairs: a, b, entities, keywords, semantic)."""
    info = articles.select("id", "source_key", "published_at")
    p = pairs.join(info.select(F.col("id").alias("a"), F.col("source_key").alias("sa"), F.col("published_at").alias("ta")), "a").join(info.select(F.col("id").alias("b"), F.col("source_key").alias("sb"), F.col("published_at").alias("tb")), "b")
    score = (
        WEIGHTS["entity"] * weighted_overlap(F.col("entities")) + WEIGHTS["semantic"] * F.col("semantic") + WEIGHTS["keyword"] * F.least(F.size("keywords") / 2.0, F.lit(1.0))
        + WEIGHTS["time"] * time_proximity(F.col("ta"), F.col("tb")) + F.when(F.col("sa") != F.col("sb"), WEIGHTS["source"]).otherwise(0.0)
    )
    least = next((s for h, s in LINK_SCORES if window_hours <= h), LINK_SCORE_ELSE)
    rejected = (F.size("entities") == 0) & (F.col("semantic") < LEAST_SEMANTIC_ALONE)
    return p.withColumn("score", score).withColumn("linked", ~rejected & (F.col("score") >= least) & (F.col("semantic") >= LEAST_SEMANTIC)).select("a", "b", "entities", "keywords", "semantic", "score", "linked")


def cluster_events(articles: DataFrame, entities: DataFrame, keywords: DataFrame, tokens: DataFrame, window_hours: int = 24, limit: int = 8, hub_share: float = HUB_SHARE, deltas: DataFrame | None = None) -> DataFrame:
    """Event groups of articles linked by shared entities or keywords (id, term) and similar titles (id, token).

    Entities that are hubs do not link. The articles are a window's sample, which bounds the pairs."""
    hub = hubs(entities, hub_share, hub_least(window_hours), articles)
    e = entities.select("id", "term").distinct().join(hub.select("term"), "term", "left_anti")
    pe = candidate_pairs(e).withColumnRenamed("shared", "entities")
    pk = candidate_pairs(keywords).withColumnRenamed("shared", "keywords")
    none = F.array().cast("array<string>")
    pairs = checkpoint(pe.join(pk, ["a", "b"], "full").withColumn("entities", F.coalesce("entities", none)).withColumn("keywords", F.coalesce("keywords", none)))
    scored = score_pairs(residual_cosine(pairs, term_vectors(tokens)), articles, window_hours)
    member = components(scored.filter("linked"))
    m = member.select(F.col("node").alias("id"), "component").join(articles, "id")
    if deltas is not None:
        m = m.join(deltas.select(F.col("article_id").alias("id"), "delta", "is_new"), "id", "left")
    else:
        m = m.withColumn("delta", F.lit(0)).withColumn("is_new", F.lit(False))
    one = collapse_same_source(m.select("component", "source_key", "id", "title", "heat_value", "published_at", "delta", "is_new"))
    groups = one.groupBy("component").agg(
        F.count("*").alias("count"), F.count_distinct("source_key").alias("n_sources"), F.sum(article_score(F.col("heat_value"), F.lit(0))).alias("_score"), F.max_by("title", F.struct("heat_value", F.negative("id"))).alias("title"),
        F.max("published_at").alias("latest"), F.sum(F.coalesce("delta", F.lit(0))).alias("score_delta"), F.sum(F.when(F.col("is_new"), 1).otherwise(0)).alias("count_delta"), F.array_sort(F.collect_list("id")).alias("ids"),
    ).filter("count >= 2")
    out = groups.withColumn("score", diversity_boost(F.col("_score"), F.col("n_sources"))).withColumn("momentum", momentum(F.col("score_delta"), F.col("count_delta"))).drop("_score")
    order = [F.desc("n_sources"), F.desc("latest"), F.asc("component")] if window_hours <= 3 else [F.desc("score"), F.desc("count"), F.asc("component")]
    return out.orderBy(*order).limit(limit)


def matching_articles(articles: DataFrame, terms: list[str], most: int = 20) -> DataFrame:
    """The articles that match any of the terms best."""
    weight = sum((term_weight(F.col("title"), F.col("content"), F.lit(t)) for t in terms), F.lit(0))
    return articles.withColumn("weight", weight).filter("weight > 0").orderBy(F.desc("weight"), F.desc("published_at"), F.desc("heat_value"), "id").limit(most)


def storyline(articles: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """One row: totals, sources by count, momentum, latest and hottest article of a set of articles."""
    a = articles
    a = a.join(deltas.select(F.col("article_id").alias("id"), "delta", "is_new"), "id", "left") if deltas is not None else a.withColumn("delta", F.lit(0)).withColumn("is_new", F.lit(False))
    total = a.agg(
        F.count("*").alias("total_articles"), F.coalesce(F.sum("delta"), F.lit(0)).alias("score_delta"), F.coalesce(F.sum(F.when(F.col("is_new"), 1).otherwise(0)), F.lit(0)).alias("new_count"),
        F.max_by("title", F.struct("published_at", "id")).alias("latest_title"), F.max_by("title", F.struct("heat_value", "published_at", "id")).alias("hottest_title"), F.max("heat_value").alias("hottest_heat"), F.count_distinct("source_key").alias("n_sources"),
    )
    return total.withColumn("momentum", momentum(F.col("score_delta"), F.col("new_count")))


def storyline_summary(story: DataFrame, term: str, hours: int) -> DataFrame:
    """Up to three sentences on a storyline row."""
    first = F.format_string(f"%d articles on {term} within {hours} hours; latest: %s.", F.col("total_articles"), F.col("latest_title"))
    second = F.when(F.col("n_sources") > 1, F.format_string("Spread to %d sources.", F.col("n_sources")))
    third = F.when(F.col("hottest_heat") > 0, F.format_string("Hottest: %s (%d).", F.col("hottest_title"), F.col("hottest_heat")))
    return story.withColumn("summary", F.when(F.col("total_articles") == 0, F.array(F.lit(f"No articles on {term} in this window."))).otherwise(F.array_compact(F.array(first, second, third))))


def evaluate_grid(support: DataFrame, blacklist: DataFrame, base: DiscoveryParams | None = None) -> DataFrame:
    """Precision and score of the baseline and of the eight variants around it.

    Variants meet the supports by one join on thresholds of a nine-row table. precision = 1 - blacklisted / found
    (0 without any), score = precision * ln(1 + found)."""
    base = base or DiscoveryParams()
    grid = [(f"a{base.min_articles + i}s{base.min_sources + j}", max(1, base.min_articles + i), max(1, base.min_sources + j), i == j == 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    params = support.sparkSession.createDataFrame(grid, "variant string, min_articles int, min_sources int, baseline boolean")
    marked = support.join(blacklist.select(F.col("word").alias("gram"), F.lit(1).alias("bad")), "gram", "left")
    hit = (F.col("articles") >= F.col("min_articles")) & (F.col("sources") >= F.col("min_sources"))
    counted = marked.join(F.broadcast(params), hit).groupBy("variant").agg(F.count("*").alias("found"), F.coalesce(F.sum("bad"), F.lit(0)).alias("blacklisted"))
    out = params.join(counted, "variant", "left").fillna(0, ["found", "blacklisted"])
    precision = F.when(F.col("found") == 0, 0.0).otherwise(1 - F.col("blacklisted") / F.greatest("found", F.lit(1)))
    return out.withColumn("precision", precision).withColumn("score", F.col("precision") * F.log1p("found"))


def suggest_variant(grid: DataFrame, margin: float = 1.05) -> DataFrame:
    """The best variant, if it beats the baseline by the margin."""
    best = grid.agg(F.max_by("variant", F.struct("score", F.col("baseline"), F.negative("min_articles"), F.negative("min_sources"))).alias("best"), F.max("score").alias("best_score"), F.max(F.when(F.col("baseline"), F.col("score"))).alias("baseline_score"))
    return best.withColumn("suggested", F.when(F.col("best_score") > margin * F.col("baseline_score"), F.col("best")))


def discovery_round(candidates: DataFrame, words: DataFrame, blacklist: DataFrame, now: Column, gap_hours: int = 36, min_days: int = 2, min_hits: int = 5) -> DataFrame:
    """Candidate state (word, hit_days, total_hits, last_hit_at, promoted_at) after a round of discovered words (gram, articles).

    A word hit again within the gap lengthens its streak, else begins anew; promoted words stay as they are; words whose
    streak and hits suffice and that are not blacklisted are promoted."""
    w = words.groupBy(F.col("gram").alias("word")).agg(F.max("articles").alias("_h"))
    j = candidates.join(w, "word", "full")
    hit = F.col("_h").isNotNull() & F.col("promoted_at").isNull()
    close = F.coalesce(F.col("last_hit_at") > now - F.make_dt_interval(hours=F.lit(gap_hours)), F.lit(False))
    days = F.when(~hit, F.col("hit_days")).when(close, F.col("hit_days") + 1).otherwise(1)
    out = j.select("word", days.alias("hit_days"), (F.coalesce("total_hits", F.lit(0)) + F.when(hit, F.col("_h")).otherwise(0)).alias("total_hits"), F.when(hit, now).otherwise(F.col("last_hit_at")).alias("last_hit_at"), "promoted_at")
    bad = blacklist.select("word", F.lit(True).alias("_b")).distinct()
    due = F.col("promoted_at").isNull() & F.col("_b").isNull() & (F.col("hit_days") >= min_days) & (F.col("total_hits") >= min_hits)
    return out.join(bad, "word", "left").withColumn("promoted_at", F.when(due, now).otherwise(F.col("promoted_at"))).drop("_b")


def daily_summary(stats: DataFrame, excluded: list[str] | None = None, width: int = 22) -> DataFrame:
    """One row of text from per-source statistics (source_key, n, top_title): totals, and each source's leading title."""
    s = stats.filter(~F.col("source_key").isin(*excluded)) if excluded else stats
    title = F.when(F.length("top_title") > width, F.concat(F.substring("top_title", 1, width), F.lit("…"))).otherwise(F.col("top_title"))
    rows = F.sort_array(F.collect_list(F.struct(F.negative("n").alias("k"), "source_key", title.alias("t"))))
    parts = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), rows.alias("r"))
    counts = F.array_join(F.transform("r", lambda x: F.concat(x["source_key"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    head = F.when(F.size("r") > 1, F.format_string("Today: %d articles (%s)", F.col("total"), counts)).otherwise(F.format_string("Today: %d articles", F.col("total")))
    lead = F.array_join(F.transform(F.filter("r", lambda x: x["t"].isNotNull()), lambda x: F.concat(x["source_key"], F.lit(": "), x["t"])), "\n")
    return parts.select(F.concat_ws("\n", head, F.when(lead != "", lead)).alias("summary"))
