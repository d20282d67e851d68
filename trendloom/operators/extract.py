"""Titles to typed candidates: patterns, dictionary matches, segmentation, keep and kind rules, substring dedup.

The rules work on one title at a time and loop until nothing changes, so they run in Arrow batches; dictionaries are a
``Lexicon`` that callers supply or extend (the seed here is small and its own)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators.patterns import MOST_CHARS, Automaton, lowered
from trendloom.operators.segmentation import CharacterModel, Segmenter, TagModel, spread

HAN = "㐀-鿿"
_work, _quote = re.compile("《([^》]{1,40})》"), re.compile("[「『]([^」』]{1,40})[」』]")
_model = re.compile("^[A-Z][A-Z0-9]{0,4}$")
_token = re.compile(f"[{HAN}]{{2,}}|[A-Za-z][A-Za-z0-9+.-]*")
_split = re.compile(r"[\s,，。！？!?:：;；|/、]+")
_trim = "#.,!?:;，。！？：；（）()[]【】《》\"'“”‘’·-、"  # fixed values: punctuation around tokens


def han(x: str) -> int:
    return len(re.findall(f"[{HAN}]", x))


def pure_han(x: str) -> bool:
    return bool(re.fullmatch(f"[{HAN}]+", x))


@dataclass
class Lexicon:
    """Dictionaries of the rules. ``entries``: label -> (category, aliases); ``words``: word -> (frequency, part of speech)."""

    entries: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    words: dict[str, tuple[int, str]] = field(default_factory=dict)
    stop: set[str] = field(default_factory=set)
    places: set[str] = field(default_factory=set)
    verbs: set[str] = field(default_factory=set)
    topics: set[str] = field(default_factory=set)
    honorifics: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    entity_suffixes: tuple[str, ...] = ()
    entity_prefixes: tuple[str, ...] = ()
    topic_suffixes: tuple[str, ...] = ()
    pairs: dict[str, tuple[str, ...]] = field(default_factory=dict)  # abbreviations, visits, persons -> entities
    compounds: set[str] = field(default_factory=set)
    generic: set[str] = field(default_factory=set)
    cues: tuple[str, ...] = ()
    question_tails: tuple[str, ...] = ()
    speakers: tuple[str, ...] = ()  # who speaks, or what a remark points at
    judgements: tuple[str, ...] = ()
    leading_verbs: tuple[str, ...] = ()
    adjective_tails: tuple[str, ...] = ()
    broad: set[str] = field(default_factory=set)
    affiliations: dict[str, tuple[str, ...]] = field(default_factory=dict)  # persons -> what they stand for
    channel_suffixes: tuple[str, ...] = ()
    characters: CharacterModel | None = None  # cuts what ``words`` lacks
    tag_model: TagModel | None = None

    def __post_init__(self) -> None:
        self.alias = {a.lower(): label for label, (_, aliases) in self.entries.items() for a in (label, *aliases)}
        self.automaton = Automaton.build(self.alias.items())
        # what a title is scanned for as it stands: compounds, and cues of pairs and affiliations
        self.cue_words = plain_automaton({*self.compounds, *self.pairs, *self.affiliations})
        self.honorific = re.compile(f"[{HAN}]{{1,5}}(?:{'|'.join(map(re.escape, self.honorifics))})") if self.honorifics else None
        self.segmenter = Segmenter({w: f for w, (f, _) in self.words.items()})

    def canonical(self, token: str) -> str:
        return self.alias.get(token.lower(), token)

    def matches(self, title: str) -> list[str]:
        return self.automaton.labels_of([lowered(title)])[0]


def fields_of(lexicon: Lexicon) -> list[str]:
    return [f.name for f in fields(lexicon)]


#: Rows of a dictionary table that a lexicon takes at most: it travels with every task.
MOST_ROWS = 1_000_000


def lexicon_of_tables(entries: DataFrame | None = None, words: DataFrame | None = None, lists: DataFrame | None = None, cues: DataFrame | None = None, base: Lexicon | None = None) -> Lexicon:
    """A lexicon from tables, on top of another one: entries (label, category, aliases), words (word, freq, pos), lists (list, word) with
    the names of the lexicon's sets and tuples, and cues (kind, cue, label) of pairs and affiliations.

    Of a label's rows the aliases are united and the first category counts, of a word's rows the most frequent; null labels and
    words are left out. A table of more than MOST_ROWS rows is an error."""

    def rows(df: DataFrame | None, *columns: str) -> list:
        if df is None:
            return []
        found = df.select(*columns).filter(F.col(columns[0]).isNotNull()).limit(MOST_ROWS + 1).collect()
        if len(found) > MOST_ROWS:
            raise ValueError(f"a dictionary of more than {MOST_ROWS} rows")
        return sorted(found, key=str)

    new = {f: getattr(base, f) for f in fields_of(base)} if base else {}
    kept = dict(new.get("entries", {}))
    for r in rows(entries, "label", "category", "aliases"):
        category, aliases = kept.get(r["label"], (r["category"] or "", ()))
        kept[r["label"]] = category, tuple(dict.fromkeys([*aliases, *(a for a in r["aliases"] or () if a)]))
    known = dict(new.get("words", {}))
    for r in rows(words, "word", "freq", "pos"):
        if r["word"] not in known or (r["freq"] or 0) > known[r["word"]][0]:
            known[r["word"]] = r["freq"] or 0, r["pos"] or ""
    new |= {"entries": kept, "words": known}
    for r in rows(lists, "list", "word"):
        own = new.get(r["list"], getattr(Lexicon(), r["list"]))
        if r["word"] is not None:
            new[r["list"]] = own | {r["word"]} if isinstance(own, set) else tuple(dict.fromkeys([*own, r["word"]]))
    for r in rows(cues, "kind", "cue", "label"):
        if r["cue"] is not None and r["label"] is not None:
            table = dict(new.get(r["kind"], {}))
            table[r["cue"]] = tuple(dict.fromkeys([*table.get(r["cue"], ()), r["label"]]))
            new[r["kind"]] = table
    return Lexicon(**new)


def segment_all(titles: list[str], lexicon: Lexicon) -> list[list[str]]:
    """Words of titles: runs of letters and digits stay whole; Han runs take the most probable dictionary words, and of what
    these leave the most probable words of the character model."""
    lexicon.segmenter.characters = lexicon.characters
    return lexicon.segmenter.segment(titles)


def segment(title: str, lexicon: Lexicon) -> list[str]:
    return segment_all([title], lexicon)[0]


def numeric_measure(x: str) -> bool:
    digits = sum(c.isdigit() for c in x)
    units = "元块万亿千百年月日号天时分秒岁人名次个条件家例米吨度倍%％"
    return (digits * 2 >= len(x) and digits > 0 and any(c in units for c in x)) or bool(re.match(f"^[0-9.]*[万亿千百兆]+[{units}]$", x))


def normalise(token: str, lx: Lexicon) -> str:
    """A token without punctuation, trimmed prefixes and suffixes; empty where it is no candidate."""
    t = " ".join(token.strip().strip(_trim).split())
    while True:
        before = t
        for p in lx.prefixes:
            if t.startswith(p) and len(t) > len(p) + 1:
                t = t[len(p) :].strip()
        for s in lx.suffixes:
            if t.endswith(s) and len(t) > len(s) + 1:
                t = t[: -len(s)].strip()
        t = t.strip(_trim)
        if t == before:
            break
    bad = not 2 <= len(t) <= 20 or t in lx.stop or "http" in t.lower() or t[0].isdigit() or numeric_measure(t) or not re.search(f"[{HAN}A-Za-z]", t)
    return "" if bad else lx.canonical(t)


def sentence_like(t: str, lx: Lexicon) -> bool:
    """A piece of a sentence: too long, a predicate within, a question's or attribute's tail, a speaker's or a verb's head, a judgement,
    "from ... to ...", or a verb with a preposition by the tags of its words."""
    n = han(t)
    if n > 10 or len(t) > 14 or t.endswith(("的", *lx.question_tails)) or (n > 4 and any(c in t[1:-1] for c in lx.cues)):
        return True
    if any(c in t for c in lx.judgements) or re.match("从.{1,5}到.", t):
        return True
    return n >= 4 and (t.startswith((*lx.speakers, *lx.leading_verbs)) or verb_with_preposition(t, lx))


def verb_with_preposition(t: str, lx: Lexicon) -> bool:
    """Whether three or more words hold a verb and a preposition."""
    if lx.tag_model is None:
        return False
    words = segment(t, lx)
    tags = lx.tag_model.decode([words])[0] if len(words) >= 3 else []
    return "p" in tags and any(x.startswith("v") for x in tags)


def data_like(t: str) -> bool:
    return numeric_measure(t) or bool(re.search(r"第[0-9一二三四五六七八九十]+[集期季名]|[sS]\d+[eE]\d+|\d{4}年|^[Vv]?\d", t))


def channel_tag(t: str, lx: Lexicon) -> bool:
    """A column or category of a channel, not a subject."""
    return han(t) >= 3 and t.endswith(lx.channel_suffixes)


def is_entity(t: str, lx: Lexicon) -> bool:
    if t in lx.entries or t in lx.places:
        return True
    if channel_tag(t, lx):
        return False
    if t in lx.stop or t.lower() in lx.generic or re.fullmatch(r"[A-Za-z]{1,2}\d{1,3}", t) or sentence_like(t, lx) or data_like(t):
        return False
    if re.search("[A-Z]", t):
        if re.fullmatch("[A-Z]{1,3}", t) or han(t) > 4 or han(t) == 1:
            return False
        return not (han(t) >= 2 and any(v in t for v in lx.verbs))
    if "·" in t or any(t.endswith(s) and len(t) > len(s) for s in lx.entity_suffixes) or any(t.startswith(p) and 1 <= len(t) - len(p) <= 3 for p in lx.entity_prefixes):
        return True
    return pure_han(t) and 2 <= len(t) <= 4 and lx.words.get(t, (0, ""))[1] == "nr"


def word_kind(word: str, lx: Lexicon) -> str:
    """The kind of a discovered word by the part of speech of the word, or of its first piece: nouns and Latin words are entities."""
    pieces = [word] if word in lx.words else segment(word, lx) or [word]
    tag = lx.tag_model.decode([pieces])[0][0] if lx.tag_model else lx.words.get(pieces[0], (0, ""))[1]
    noun = tag.startswith("n") or bool(re.fullmatch("[A-Za-z][A-Za-z0-9+.]*", pieces[0]))
    return "entity" if noun else "keyword"


def keeps(t: str, lx: Lexicon, promoted: set[str]) -> bool:
    if t in lx.entries or t in promoted:
        return True
    if t in lx.stop or t.lower() in lx.generic or channel_tag(t, lx):
        return False
    if is_entity(t, lx) or t in lx.topics:
        return True
    if data_like(t) or sentence_like(t, lx):
        return False
    return any(t.endswith(s) and len(t) > len(s) for s in lx.topic_suffixes)


@dataclass
class Scan:
    """What a batch finds in a title at once: words, dictionary labels, cues (compounds, pairs, affiliations), promoted words."""

    words: list[str]
    labels: list[str]
    cues: list[str]
    promoted: list[str]


def scans(titles: list[str], lx: Lexicon, promoted: Automaton | None) -> list[Scan]:
    parts = (segment_all(titles, lx), lx.automaton.labels_of([lowered(t) for t in titles]), lx.cue_words.labels_of(titles), promoted.labels_of(titles) if promoted else [[] for _ in titles])
    return [Scan(*p) for p in zip(*parts, strict=True)]


class Terms:
    """What the rules say of terms, each asked once: a batch's titles share most of their terms."""

    def __init__(self, lx: Lexicon, promoted: set[str]):
        self.measure = cache(numeric_measure)
        self.normalise = cache(lambda t: normalise(t, lx))
        self.is_entity = cache(lambda t: is_entity(t, lx))
        self.keeps = cache(lambda t: keeps(t, lx, promoted))


def plain_automaton(words: Iterable[str]) -> Automaton:
    """An automaton of words as they stand, without the rule for short ones."""
    out = Automaton.build((w, w) for w in sorted(words))
    out.bounded[:] = False
    return out


def candidates(
    title: str | None, lx: Lexicon, discovered: set[str] = frozenset(), promoted: set[str] = frozenset(), blacklist: set[str] = frozenset(), most: int = 6, scan: Scan | None = None, terms: Terms | None = None
) -> list[tuple[str, str, list[str]]]:
    """At most ``most`` (label, kind, related) of a title, in order of evidence."""
    title = (title or "").strip()
    if not title:
        return []
    scan = scan or scans([title], lx, plain_automaton(promoted) if promoted else None)[0]
    terms = terms or Terms(lx, promoted)
    pool: dict[str, None] = {}
    forced: set[str] = set()
    for m in _work.findall(title):
        t = lx.canonical(m.strip())
        if t and t not in lx.stop and t.lower() not in lx.generic:
            forced.add(t)
            pool.setdefault(t)
    for m in _quote.findall(title):
        if m.strip():
            pool.setdefault(lx.canonical(m.strip()))
    for m in lx.honorific.findall(title) if lx.honorific else ():
        forced.add(lx.canonical(m))
        pool.setdefault(lx.canonical(m))
    for table in (lx.pairs, lx.affiliations):
        for cue in sorted(scan.cues):
            for t in table.get(cue, ()):
                pool.setdefault(t)
    for t in (*sorted(c for c in scan.cues if c in lx.compounds), *sorted(scan.promoted), *scan.labels):
        pool.setdefault(t)
    words = scan.words
    for a, b in zip(words, words[1:]):
        if 2 <= len(a) <= 4 and pure_han(a) and _model.match(b):
            forced.add(a + b)
            pool.setdefault(a + b)
    light = [lx.canonical(w.strip(_trim)) for w in words]
    repeated = {w for w in light if len(w) >= 2 and light.count(w) >= 2}
    for w, bare in zip(words, light):
        t = terms.normalise(w)
        if t:
            pool.setdefault(t)
        elif len(bare) >= 2 and (bare in repeated or bare in discovered):
            pool.setdefault(bare)
    for part in _split.split(title):
        for x in (part, *_token.findall(part)):
            if t := terms.normalise(x):
                pool.setdefault(t)
    out: list[tuple[str, str, list[str]]] = []
    for t in pool:
        weak = t in lx.stop or t.isdigit() or terms.measure(t)
        strong = t in forced or t in lx.compounds or (not weak and (t in repeated or t in discovered))
        if not strong and not terms.keeps(t):
            continue
        kind = "entity" if t in forced or terms.is_entity(t) else "keyword"
        related = related_terms(pool, t, lx, terms, blacklist) if kind == "entity" else []
        out.append((t, kind, related))
        if len(out) >= most + 2:
            break
    out = drop_substrings(out, lx)
    out = [c for c in out if not adjunct(title, c[0], lx) and c[0] not in blacklist]
    return out[:most]


def related_terms(pool: Iterable[str], label: str, lx: Lexicon, terms: Terms, blacklist: set[str]) -> list[str]:
    """At most four other terms of the title that would be kept; without any, at most two of the label's own aliases."""
    others = dict.fromkeys(lx.canonical(x) for x in pool)
    found = [x for x in others if x and x != label and x not in blacklist and terms.keeps(x)][:4]
    if found:
        return found
    aliases = [a.strip(_trim) for a in lx.entries.get(label, ("", ()))[1]]
    return [a for a in aliases if a and a.lower() != label.lower() and lx.canonical(a) == label and (terms.keeps(a) or re.match("[ -/:-@\\[-`{-~]*[A-Za-z0-9]", a))][:2]


def drop_substrings(found: list[tuple[str, str, list[str]]], lx: Lexicon) -> list[tuple[str, str, list[str]]]:
    """Without long entities around another entity, keywords around an entity, longer keywords around shorter ones, parts of compounds."""
    entities = [c[0] for c in found if c[1] == "entity"]
    keywords = [c[0] for c in found if c[1] == "keyword"]

    def gone(c: tuple[str, str, list[str]]) -> bool:
        t, kind, _ = c
        if kind == "entity":
            return han(t) > 8 and any(e != t and e in t for e in entities)
        if t in lx.compounds:
            return False
        return any(e != t and e in t for e in entities) or any(k != t and k in t for k in keywords) or any(k != t and t in k and k in lx.compounds for k in keywords)

    return [c for c in found if not gone(c)]


def adjunct(title: str, label: str, lx: Lexicon) -> bool:
    """A place, or AI, that only stands before a noun."""
    tails = "|".join(map(re.escape, lx.adjective_tails))
    if not tails or (label not in lx.places and label != "AI"):
        return False
    every = re.findall(re.escape(label), title)
    return bool(every) and len(re.findall(f"{re.escape(label)}(?:{tails})", title)) == len(every)


def segment_tokens(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """id, source_key, pos, token: words of the titles in canonical form, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(titles: pd.Series) -> pd.Series:
        return pd.Series([[lexicon.canonical(w) for w in words] for words in segment_all([t or "" for t in titles], lexicon)])

    return spread(articles.select("id", "source_key", "title")).select("id", "source_key", F.posexplode(run("title")).alias("pos", "token"))


KIND = "array<struct<label: string, kind: string, related: array<string>>>"


def candidate_column(title: Column, lexicon: Lexicon, discovered: Iterable[str] = (), promoted: Iterable[str] = (), blacklist: Iterable[str] = ()) -> Column:
    """The candidates of a title as an array column, in Arrow batches."""
    d, p, b = set(discovered), set(promoted), set(blacklist)
    if sum(map(len, d | p | b)) > MOST_CHARS:
        raise ValueError(f"word lists of more than {MOST_CHARS} characters travel with no task: filter them first")
    words = plain_automaton(p) if p else None

    @F.pandas_udf(KIND)
    def run(titles: pd.Series) -> pd.Series:
        bare = [(t or "").strip() for t in titles]
        distinct, terms = list(dict.fromkeys(bare)), Terms(lexicon, p)
        found = {t: [{"label": x, "kind": k, "related": r} for x, k, r in candidates(t, lexicon, d, p, b, scan=s, terms=terms)] for t, s in zip(distinct, scans(distinct, lexicon, words), strict=True)}
        return pd.Series([found[t] for t in bare])

    return run(title)


def explode_candidates(articles: DataFrame, lexicon: Lexicon, **more) -> DataFrame:
    """id, label, kind, related, pos. A small table of titles is many tasks' work."""
    return spread(articles.select("id", "title")).select("id", F.posexplode(candidate_column(F.col("title"), lexicon, **more)).alias("pos", "c")).select("id", "pos", "c.label", "c.kind", "c.related")


def article_keywords(candidates_: DataFrame, most: int = 5) -> DataFrame:
    """id, keywords: entities first, each kind in order."""
    c = candidates_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "entity", 0).otherwise(1).alias("o"), "pos", "label"))).alias("c"))
    return c.select("id", F.slice(F.transform("c", lambda x: x["label"]), 1, most).alias("keywords"))


def split_terms(terms: Column, promoted: Iterable[str], known: Iterable[str]) -> tuple[Column, Column]:
    """Promoted terms, and those that no dictionary knows."""
    p, k = F.array(*map(F.lit, sorted(promoted))).cast("array<string>"), F.array(*map(F.lit, sorted(known))).cast("array<string>")
    return F.array_intersect(terms, p), F.array_except(F.array_except(terms, p), k)


def rule_entities(articles: DataFrame, places: Iterable[str], bad_first: str = "") -> DataFrame:
    """id, name, type: works in title marks, actors by role words, places."""
    t = F.col("title")
    actor = f"(?:主演|导演|演员|歌手)([{HAN}]{{2,4}})"
    works = F.transform(F.regexp_extract_all(t, F.lit("《([^》]+)》"), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit("work").alias("type")))
    people = F.transform(F.filter(F.regexp_extract_all(t, F.lit(actor), F.lit(1)), lambda x: ~F.contains(F.lit(bad_first), F.substring(x, 1, 1)) if bad_first else F.lit(True)), lambda x: F.struct(x.alias("name"), F.lit("person").alias("type")))
    where = F.transform(F.filter(F.array(*map(F.lit, sorted(places))).cast("array<string>"), lambda p: F.contains(t, p)), lambda x: F.struct(x.alias("name"), F.lit("location").alias("type")))
    return articles.select("id", F.explode(F.array_distinct(F.concat(works, people, where))).alias("e")).select("id", "e.name", "e.type")


# fixed values: suffixes of channel columns
CHANNEL_SUFFIXES = ("调查", "测评", "锐评", "开箱", "评测", "实验", "合集版", "合集", "栏目", "专栏", "深扒", "探店")
# countries by the character that stands for them in headlines
COUNTRIES = {"中": "中国", "美": "美国", "日": "日本", "俄": "俄罗斯", "韩": "韩国", "朝": "朝鲜", "英": "英国", "法": "法国", "德": "德国", "印": "印度", "欧": "欧盟", "乌": "乌克兰"}


def country_pairs(first: str = "中美日俄欧") -> dict[str, tuple[str, ...]]:
    """Headline pairs of countries, the leading one among ``first``, and visits to each country."""
    pairs = {a + b: (COUNTRIES[a], COUNTRIES[b]) for a in first for b in COUNTRIES if a != b}
    return pairs | {f"访{c}": (name,) for c, name in COUNTRIES.items()}


def seed_lexicon() -> Lexicon:
    """A small dictionary of our own for tests and as a pattern for larger ones."""
    countries = {name: ("country", ()) for name in COUNTRIES.values()}
    firms = {"特斯拉": ("company", ("Tesla",)), "英伟达": ("company", ("Nvidia",)), "比亚迪": ("company", ("BYD",)), "微软": ("company", ("Microsoft",))}
    return Lexicon(
        entries={"华为": ("company", ("Huawei",)), "苹果公司": ("company", ("Apple",)), "人工智能": ("event", ("AI",)), "世界杯": ("event", ()), "国家队": ("team", ())} | countries | firms,
        words={"发布": (900, "v"), "新品": (120, "n"), "手机": (700, "n"), "北京": (800, "ns"), "上海": (780, "ns"), "李明": (3, "nr"), "降雨": (60, "n"), "预警": (50, "n"), "演唱会": (90, "n"), "今天": (5000, "t"), "问界": (5, "nz"), "访问": (300, "v"), "门票": (40, "n"), "暴雨": (70, "n")},
        stop={"今天", "最新", "回应", "网友", "视频", "记者"}, places={"北京", "上海", "广东"}, verbs={"发布", "访问", "回应"}, topics={"降雨", "演唱会", "暴雨", "门票"},
        honorifics=("先生", "教授", "主席", "总统"), prefixes=("关于", "今日"), suffixes=("最新消息", "视频"), entity_suffixes=("大学", "集团", "公司", "银行"), entity_prefixes=("小米",), topic_suffixes=("预警", "改革", "政策"),
        pairs=country_pairs() | {"访华": ("中国",)}, affiliations={"马斯克": ("特斯拉",), "黄仁勋": ("英伟达",), "王传福": ("比亚迪",), "纳德拉": ("微软",), "任正非": ("华为",), "库克": ("苹果公司",)},
        channel_suffixes=CHANNEL_SUFFIXES, compounds={"暴雨预警", "台风预警", "高温预警", "房贷利率", "出口管制", "退休年龄", "新能源汽车", "医保改革"}, generic={"the", "and", "new", "video"}, cues=("是否", "为什么", "怎么"), adjective_tails=("女子", "男子", "助手"), broad={"中国", "美国"},
    )
