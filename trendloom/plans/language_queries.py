"""Dictionary matches, segmentation, parts of speech and the rest of the title rules as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import extract as X
from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.operators.patterns import dictionary_hits as hits_of
from trendloom.operators.segmentation import CharacterModel, Segmenter, TagModel, kind_of, tagged_words
from trendloom.plans.text_queries import TOKENS, query
from trendloom.sources.adapters import ARTICLES, articles, table

#: A dictionary whose labels nest and overlap: the pieces of three to six letters of the words of parts and nations; pieces that
#: overlap themselves are left out, as SQL counts by replacement.
PIECES_SQL = """wd as (select distinct unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) w from part union select distinct unnest(regexp_extract_all(lower(n_name), '[a-z]+')) from nation),
 pc as (select distinct substr(w, i, n) p from wd, unnest(range(1, 21)) a(i), unnest(range(3, 7)) b(n) where i + n - 1 <= length(w)),
 di as (select p from pc where left(p, 1) <> right(p, 1) and (length(p) < 4 or left(p, 2) <> right(p, 2)) and (length(p) < 6 or left(p, 3) <> right(p, 3)))"""


def _pieces(spark, d):
    w = table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    w = w.union(table(spark, d, "nation").select(F.explode(F.regexp_extract_all(F.lower("n_name"), F.lit("[a-z]+"), F.lit(0))))).distinct()
    p = w.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"), F.lit(None)).select("w", "i", F.explode(F.sequence(F.lit(3), F.lit(6))).alias("n"))
    p = p.filter(F.col("i") + F.col("n") - 1 <= F.length("w")).select(F.substring("w", F.col("i"), F.col("n")).alias("p")).distinct()
    same = lambda n: F.left("p", F.lit(n)) == F.right("p", F.lit(n))
    return p.filter(~same(1) & ((F.length("p") < 4) | ~same(2)) & ((F.length("p") < 6) | ~same(3)))


@query(f"""with {PIECES_SQL}, t as (select doc_id, lower(text) t from documents where text is not null),
 h as (select doc_id, p label, length(p) <= 3 short, t from t, di where contains(t, p))
 select doc_id, label, cast(n as bigint) n, cast(first_start as bigint) first_start from (
  select doc_id, label, (length(t) - length(replace(t, label, ''))) // length(label) n, strpos(t, label) - 1 first_start from h where not short
  union all select doc_id, label, len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x = label)) n, strpos(' ' || regexp_replace(t, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || label || ' ') - 1 from h where short) where n > 0""")
def dictionary_matches(spark, d):
    """How often, and where first, each label of a dictionary of nested and overlapping labels occurs in each document."""
    words = _pieces(spark, d).select(F.col("p").alias("pattern"), F.col("p").alias("label"))
    found = hits_of(table(spark, d, "documents").select("doc_id", "text"), words, "doc_id", "text")
    return found.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


#: The character model of ``segmented_names`` and its best path, by trying every way to cut each unknown word.
CUTS_SQL = """t as (select p_partkey k, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) n from part),
 st as (select n w, i, substr(n, i, 1) c, case when length(n) = 1 then 3 when i = 1 then 0 when i = length(n) then 2 else 1 end s from t, unnest(range(1, 20)) r(i) where k % 2 = 0 and i <= length(n)),
 sg as (select unnest([0, 1, 2, 3]) s), ch as (select distinct c from st),
 sn as (select s, (s in (0, 3))::int + (select count(*) from st where i = 1 and st.s = sg.s) n from sg), sp as (select s, ln(n / (select sum(n) from sn)) p from sn where n > 0),
 al as (select unnest([0, 0, 1, 1, 2, 2, 3, 3]) a, unnest([1, 2, 1, 2, 0, 3, 0, 3]) b), mc as (select s a, case when i + 1 = length(w) then 2 else 1 end b, count(*) n from st where i < length(w) group by 1, 2),
 mn as (select a, b, 1 + coalesce(n, 0) n from al left join mc using (a, b)), mp as (select a, b, ln(n / sum(n) over (partition by a)) p from mn),
 ec as (select c, s, count(*) n from st group by 1, 2), en as (select c, s, 1 + coalesce(n, 0) n from ch cross join sg left join ec using (c, s)), et as (select s, 1 + sum(n) total from en group by 1), ep as (select c, s, ln(n / total) p from en join et using (s)),
 ms as (select w, m, i, substr(w, i, 1) c, case when b and e then 3 when b then 0 when e then 2 else 1 end s from (select w, m, i, i = 1 or (m >> (i - 2)) % 2 = 1 b, i = length(w) or (m >> (i - 1)) % 2 = 1 e from (select distinct n w from t) x, unnest(range(0, 1024)) y(m), unnest(range(1, 12)) z(i) where m < (1 << (length(w) - 1)) and i <= length(w))),
 nx as (select *, lead(s) over (partition by w, m order by i) b from ms),
 sc as (select nx.w, nx.m, sum(coalesce(ep.p, ln(1 / et.total)) + coalesce(mp.p, 0) + case when i = 1 then sp.p else 0 end) score from nx join et on et.s = nx.s left join ep on ep.c = nx.c and ep.s = nx.s left join mp on mp.a = nx.s and mp.b = nx.b left join sp on sp.s = nx.s group by 1, 2),
 bm as (select w, arg_max(m, score) m from sc group by 1),
 pc as (select w, i, lead(i, 1, length(w) + 1) over (partition by w order by i) j from (select w, i from bm, unnest(range(1, 12)) z(i) where i <= length(w) and (i = 1 or (m >> (i - 2)) % 2 = 1)))"""


@query(f"""with {CUTS_SQL} select k id, cast(0 as bigint) pos, a word from t
 union all select k, row_number() over (partition by k order by i), substr(w, i, j - i) from t join pc on pc.w = t.n""")
def segmented_names(spark, d):
    """Names of parts written without spaces, cut by a dictionary of their first words; the nouns are unknown words, which
    the character model, counted on half of the parts, cuts."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    first = {r["w"]: r["n"] for r in parts.groupBy(F.get("words", F.lit(0)).alias("w")).agg(F.count("*").alias("n")).collect()}  # a few adjectives
    s = Segmenter(first, CharacterModel.fit(parts.filter(F.col("id") % 2 == 0).withColumn("words", F.slice("words", 2, 1))), run="[a-z]+")
    return tagged_words(parts.select("id", F.array_join("words", "").alias("title")), s).select("id", F.col("pos").cast("bigint").alias("pos"), "word")


#: Words that are verbs where they lead, nouns elsewhere.
VERBS = ("ring", "plate", "bolt")


@query(f"""with p as (select p_partkey k, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) n from part)
 select k id, cast(0 as bigint) pos, case when k % 2 = 0 then a else n end word, case when k % 2 = 1 and n not in {VERBS} then 'entity' else 'keyword' end kind from p
 union all select k, 1, case when k % 2 = 0 then n else a end, case when k % 2 = 0 then 'entity' else 'keyword' end from p""")
def word_kinds(spark, d):
    """Kinds of words by their tags in the sentence: nouns are entities; a word may be a noun here and a verb there."""
    k = F.col("p_partkey")
    adjective, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    s = table(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, F.array(adjective, noun)).otherwise(F.array(noun, adjective)).alias("words"))
    tags = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("n"))).otherwise(F.array(F.when(F.get("words", F.lit(0)).isin(*VERBS), "v").otherwise("n"), F.lit("a")))
    model = TagModel.fit(s.filter(F.col("id") % 5 != 0).withColumn("tags", tags))
    words = Segmenter({}, tags=model, run="(?!)", other="[a-z]+")
    found = tagged_words(s.select("id", F.array_join("words", " ").alias("title")), words)
    return found.select("id", F.col("pos").cast("bigint").alias("pos"), "word", kind_of(F.col("tag")).alias("kind"))


#: Headlines for the rules that need more than a dictionary: quotes, product models, promoted and discovered words, the blacklist,
#: overlapping labels; what is found in each with its related terms, by hand.
RULE_HEADLINES = (
    ("走进「星火大学」{k}", (("星火大学", "entity", ""),)),
    ("问界M9交付{k}台", (("问界M9", "entity", ""),)),
    ("今天糯叽叽{k}", (("糯叽叽", "keyword", ""),)),
    ("脆哨子 好吃{k}次", (("脆哨子", "keyword", ""),)),
    ("暴雨 门票 {k}", (("暴雨", "keyword", ""),)),
    ("星火大学城 {k}", (("星火大学", "entity", "大学城"), ("大学城", "entity", "星火大学"))),
    ("英伟达 {k}", (("英伟达", "entity", "Nvidia"),)),
    ("《长路{k}》在北京", (("长路{k}", "entity", "北京"), ("北京", "entity", ""))),
)


def _rule_sql() -> str:
    text = lambda x: "'" + x.replace("{k}", "' || k || '") + "'"
    rows = [f"select k id, {text(a)} label, '{kind}' kind, {text(rel)} related from p where k % {len(RULE_HEADLINES)} = {i}" for i, (_, found) in enumerate(RULE_HEADLINES) for a, kind, rel in found]
    return "with p as (select p_partkey k from part) " + " union all ".join(rows)


@query(_rule_sql())
def ruled_headlines(spark, d):
    """Candidates of built headlines with promoted, discovered and blacklisted words, and what each is related to."""
    k = F.col("p_partkey")
    title = F.lit(None).cast("string")
    for i, (text, _) in enumerate(RULE_HEADLINES):
        title = F.when(k % len(RULE_HEADLINES) == i, F.replace(F.lit(text), F.lit("{k}"), k.cast("string"))).otherwise(title)
    lx = X.seed_lexicon()
    lx = X.Lexicon(**{f: getattr(lx, f) for f in X.fields_of(lx)} | {"entries": lx.entries | {"星火大学": ("school", ()), "大学城": ("place", ())}})
    found = X.explode_candidates(table(spark, d, "part").select(k.alias("id"), title.alias("title")), lx, promoted={"糯叽叽"}, discovered={"脆哨子"}, blacklist={"门票"})
    return found.select("id", "label", "kind", F.array_join("related", ",").alias("related"))


@query("with c as (select c_custkey k, lower(substr(c_name, 16, 3)) w from customer), g as (select w, count(*) n from c group by 1), l as (select a.w, cast(sum(b.n) as bigint) - 1 links from g a join g b on a.w <> '' and b.w <> '' and (a.w = b.w or contains(a.w, b.w) or contains(b.w, a.w) or levenshtein(a.w, b.w) <= 1) group by 1) select k, w, coalesce(links, 0) links from c left join l using (w)")
def near_equal_links(spark, d):
    """Customers with the number of others of nearly equal name: counts of distinct names, no pairs of rows."""
    return R.near_equal_links(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lower(F.substring("c_name", 16, 3)).alias("w")))


@query(f"""with recursive {ARTICLES}, w as (select id, source_key, heat_value, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> ''), lambda x: trim(x, '.,!?;:'))) ws, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') bare from ar where title is not null),
 o as (select *, row_number() over (partition by source_key order by heat_value desc, id) n from w),
 nr as (select a.source_key, b.n, list(a.n) early from o a join o b on a.source_key = b.source_key and a.n < b.n and (a.bare = b.bare or (len(list_intersect(a.ws, b.ws)) >= 2 and 4 * len(list_intersect(a.ws, b.ws)) >= 3 * least(len(a.ws), len(b.ws)))) group by 1, 2),
 oe as (select o.source_key, o.n, o.id, early from o left join nr using (source_key, n)),
 r as (select distinct source_key, cast(0 as bigint) n, cast(null as bigint) id, cast([] as bigint[]) kept, false stays from o
  union all select source_key, n, id, case when stays then list_append(kept, n) else kept end, stays from (select oe.source_key, oe.n, oe.id, r.kept, not coalesce(list_has_any(r.kept, oe.early), false) stays from r join oe on oe.source_key = r.source_key and oe.n = r.n + 1) x)
 select source_key, id from r where stays""")
def collapsed_titles(spark, d):
    """Articles of each source without those whose title nearly repeats a hotter one that stays."""
    a = articles(spark, d).filter("title is not null").withColumn("component", F.lit(0))
    return M.collapse_same_source(a.select("component", "source_key", "id", "title", "heat_value")).select("source_key", "id")


#: Cosine from which on titles are similar.
SIMILAR = 0.7


@query(f"""with {TOKENS}, tf as (select id, token, count(*) c from tk group by 1, 2), tt as (select id, sum(c) total from tf group by 1), df as (select token, count(*) df from tf group by 1), n as (select count(*) docs from tt),
 v as (select id, token, c / total * case when docs >= 5 then ln(docs / df) + 1 else 1.0 end w from tf join tt using (id) join df using (token), n),
 u as (select id, sqrt(sum(w * w)) norm, list(token || ':' || w order by token) k from v group by 1), cl as (select id, min(id) over (partition by k) class, norm from u),
 rp as (select v.id, token, w / norm w from v join cl on cl.id = v.id and cl.class = cl.id),
 pr as (select a.id a, b.id b from rp a join rp b on a.token = b.token and a.id <> b.id group by 1, 2 having sum(a.w * b.w) >= {SIMILAR}), sz as (select class, count(*) n from cl group by 1),
 lk as (select a, sum(n) m from pr join sz on sz.class = pr.b group by 1)
 select id, cl.class "class", cast(n - 1 + coalesce(m, 0) as bigint) links from cl join sz on sz.class = cl.class left join lk on lk.a = cl.class""")
def similar_titles(spark, d):
    """Each title with the class of equal ones and how many others are similar, over the whole table."""
    tokens = M.letter_tokens(articles(spark, d))
    return M.similar_links(*M.similar_titles(M.term_vectors(tokens), SIMILAR))


@query("""with b as (select distinct p_brand b from part), t as (select p_partkey id, p_brand || ' ' || p_name || ' 大' || p_size || '学' t, p_size from part)
 select id, b label, 'entity' kind from t, b where contains(lower(t), lower(b)) union all select id, 'Brand', 'entity' from t union all select id, '尺寸' || (p_size % 9), 'entity' from t where p_size in (1, 2, 3)""")
def candidates_of_tables(spark, d):
    """Candidates by a lexicon that lies in tables: brands, nested ones too, and what cues in titles stand for."""
    p = table(spark, d, "part")
    entries = p.select(F.col("p_brand").alias("label"), F.lit("brand").alias("category"), F.array(F.lower("p_brand")).alias("aliases")).distinct()
    cue = p.filter(F.col("p_size").isin(1, 2, 3)).select(F.lit("pairs").alias("kind"), F.concat(F.lit("大"), F.col("p_size"), F.lit("学")).alias("cue"), F.concat(F.lit("尺寸"), F.col("p_size") % 9).alias("label")).distinct()
    sizes = cue.select("label", F.lit("size").alias("category"), F.array().cast("array<string>").alias("aliases"))
    lx = X.lexicon_of_tables(entries.unionByName(sizes), cues=cue)
    title = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" 大"), F.col("p_size"), F.lit("学"))
    return X.explode_candidates(p.select(F.col("p_partkey").alias("id"), title.alias("title")), lx).select("id", "label", "kind")
