"""Hot-list payloads to observations, and observations to feeds, pages and JSON.

Payload tables have (source_key, body, fetched_at). Each parser is a projection and an explode: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from trendloom.functions.scalar import format_heat, nearly_equal, parse_heat, squeeze
from trendloom.operators.relational import near_words

# fixed values: shapes of the payloads
NESTED = "data array<struct<target: struct<id: string, title: string, url: string, created: bigint, excerpt: string, author_name: string>, detail_text: string>>"
VIDEOS = "code int, message string, data struct<list: array<struct<bvid: string, title: string, `desc`: string, pubdate: bigint, owner: struct<name: string>, stat: struct<view: bigint>>>>"
_CARD = "array<struct<index: int, word: string, hotScore: string, `desc`: string, rawUrl: string>>"
CARDS = f"success boolean, data struct<cards: array<struct<updateTime: string, content: {_CARD}, topContent: {_CARD}>>>"
RANKED = "data array<struct<id: string, attributes: struct<title: string, flag: string, num: bigint, rank: int>>>"
HTML_ENTRY = r'<a\s+href="(/weibo\?q=[^"]*band_rank=(\d+)[^"]*)"[^>]*target="_blank">([^<]+)</a>\s*<span[^>]*>\s*([^<]*)</span>'

COLUMNS = ["source_key", "url", "title", "content", "author", "heat", "heat_value", "source_rank", "published_at", "fetched_at"]


def classify(status: Column, code: Column, items: Column) -> Column:
    """The error class of a poll: banned, rate_limited, cookie_expired, empty, other; null when it went well."""
    return F.when(status == 403, "banned").when((status == 429) | (code == -412), "rate_limited").when(status == 401, "cookie_expired").when(status >= 400, "other").when(items == 0, "empty")


def nested_list(payloads: DataFrame, url_base: str = "https://www.zhihu.com/question/") -> DataFrame:
    """A JSON list with nested targets; the rank is the place in the list."""
    p = payloads.withColumn("j", F.from_json("body", NESTED)).select("source_key", "fetched_at", F.posexplode("j.data").alias("pos", "x")).filter("x.target.title <> ''")
    t = F.col("x.target")
    return p.select(
        "source_key", F.when(t["id"] != "", F.concat(F.lit(url_base), t["id"])).otherwise(t["url"]).alias("url"), t["title"].alias("title"), t["excerpt"].alias("content"), t["author_name"].alias("author"),
        F.col("x.detail_text").alias("heat"), parse_heat(F.col("x.detail_text")).alias("heat_value"), (F.col("pos") + 1).alias("source_rank"),
        F.when(t["created"] > 0, F.timestamp_seconds(t["created"])).otherwise(F.col("fetched_at").cast("timestamp")).alias("published_at"), "fetched_at",
    )


def video_list(payloads: DataFrame, url_base: str = "https://www.bilibili.com/video/") -> DataFrame:
    """A JSON list of videos without ranks; only payloads with code 0."""
    p = payloads.withColumn("j", F.from_json("body", VIDEOS)).filter("j.code = 0").select("source_key", "fetched_at", F.explode("j.data.list").alias("x")).filter("x.title <> ''")
    view = F.coalesce(F.col("x.stat.view"), F.lit(0))
    return p.select(
        "source_key", F.concat(F.lit(url_base), F.col("x.bvid")).alias("url"), F.col("x.title").alias("title"), F.col("x.desc").alias("content"), F.col("x.owner.name").alias("author"),
        format_heat(view, "播放").alias("heat"), view.alias("heat_value"), F.lit(None).cast("int").alias("source_rank"), F.timestamp_seconds("x.pubdate").alias("published_at"), "fetched_at",
    )


def card_list(payloads: DataFrame, url_base: str = "https://www.baidu.com/s?wd=") -> DataFrame:
    """JSON cards: pinned entries, then the others; near-equal words of one payload once; ranks from the order of index."""
    p = payloads.withColumn("j", F.from_json("body", CARDS)).filter("j.success").withColumn("_p", F.monotonically_increasing_id())
    none = F.array().cast(_CARD)
    both = F.flatten(F.transform("j.data.cards", lambda c: F.concat(F.coalesce(c["topContent"], none), F.coalesce(c["content"], none))))
    x = p.select("_p", "source_key", "fetched_at", F.posexplode(both).alias("pos", "x")).filter("trim(x.word) <> ''").withColumn("word", squeeze(F.col("x.word")))
    dropped = in_batch_duplicates(x, ["_p"], "pos", "word")
    kept = x.join(dropped, ["_p", "pos"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("x.index", "pos"))
    score = F.coalesce(F.col("x.hotScore").try_cast("bigint"), F.lit(0))
    return kept.select(
        "source_key", F.concat(F.lit(url_base), F.url_encode("word")).alias("url"), F.col("x.word").alias("title"), F.col("x.desc").alias("content"), F.lit("").alias("author"),
        format_heat(score, "热搜").alias("heat"), score.alias("heat_value"), rank.alias("source_rank"), F.col("fetched_at").cast("timestamp").alias("published_at"), "fetched_at",
    )


def in_batch_duplicates(rows: DataFrame, keys: list[str], pos: str, word: str) -> DataFrame:
    """(keys, pos) of words nearly equal to an earlier one of the same batch: batches are single short payloads."""
    a = rows.select(*keys, F.col(pos).alias("_i"), F.col(word).alias("_a"))
    b = rows.select(*keys, F.col(pos), F.col(word).alias("_b"))
    return a.join(b, keys).filter((F.col("_i") < F.col(pos)) & nearly_equal(F.col("_a"), F.col("_b"))).select(*keys, pos).distinct()


def ranked_list(payloads: DataFrame, url_base: str = "https://www.sogou.com/web?query=") -> DataFrame:
    """A JSON list with official ranks, renumbered from one."""
    p = payloads.withColumn("j", F.from_json("body", RANKED)).withColumn("_p", F.monotonically_increasing_id()).select("_p", "source_key", "fetched_at", F.posexplode("j.data").alias("pos", "x")).filter("trim(x.attributes.title) <> ''")
    a = F.col("x.attributes")
    return p.select(
        "source_key", F.concat(F.lit(url_base), F.url_encode(squeeze(a["title"]))).alias("url"), a["title"].alias("title"), F.lit("").alias("content"), F.lit("").alias("author"),
        format_heat(a["num"], wan_rounds=True, gap=False).alias("heat"), a["num"].alias("heat_value"), F.row_number().over(Window.partitionBy("_p").orderBy(a["rank"], "pos")).alias("source_rank"),
        F.col("fetched_at").cast("timestamp").alias("published_at"), "fetched_at",
    )


def html_list(payloads: DataFrame, url_base: str = "https://s.weibo.com/weibo?q=") -> DataFrame:
    """Entries of a hot-list page by pattern; advertisements left out; the query parameter alone is the key."""
    entry = F.regexp_extract_all("body", F.lit(HTML_ENTRY), F.lit(0))
    x = payloads.select("source_key", "fetched_at", F.explode(entry).alias("e"))

    def group(k: int) -> Column:
        return F.regexp_extract("e", HTML_ENTRY, k)

    digits = F.regexp_extract(group(4), r"(\d+)\s*$", 1)
    value = F.coalesce(digits.try_cast("bigint"), F.lit(0))
    return x.filter(~F.contains(group(1), F.lit("topic_ad=1"))).select(
        "source_key", F.concat(F.lit(url_base), F.regexp_extract(group(1), r"q=([^&]*)", 1)).alias("url"), F.trim(group(3)).alias("title"), F.lit("").alias("content"), F.lit("").alias("author"),
        format_heat(value, wan_rounds=True, gap=False).alias("heat"), value.alias("heat_value"), group(2).cast("int").alias("source_rank"), F.col("fetched_at").cast("timestamp").alias("published_at"), "fetched_at",
    )


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, text of the plain links of HTML pages."""
    link = r'<a href="([^"]*)">([^<]*)</a>'
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(link), F.lit(0))).alias("pos", "e")).select("page_id", "pos", F.regexp_extract("e", link, 1).alias("href"), F.regexp_extract("e", link, 2).alias("text"))


def jsonp_field(body: Column, name: str) -> Column:
    """A string field of a JSONP answer."""
    return F.regexp_extract(body, f'"{name}"\\s*:\\s*"([^"]*)"', 1)


def visitor_cookie(body: Column) -> Column:
    """The cookie of a visitor answer from its fields ``sub`` and, where it has one, ``subp``; null without the first."""
    sub, subp = jsonp_field(body, "sub"), jsonp_field(body, "subp")
    return F.when(sub != "", F.concat(F.lit("SUB="), sub, F.when(subp != "", F.concat(F.lit("; SUBP="), subp)).otherwise("")))


def replace_url_of_near_title(new: DataFrame, recent: DataFrame) -> DataFrame:
    """New rows of fuzzy sources take the url of a recent row of their source whose title is equal, else nearly equal.

    Distinct titles of a source meet by equality of heads and pieces or of forms with one character deleted, never all with all."""
    n = new.withColumn("_n", squeeze(F.col("title")))
    known = recent.select("source_key", squeeze(F.col("title")).alias("w"), F.col("url").alias("_u")).groupBy("source_key", "w").agg(F.min("_u").alias("_u"))
    near = near_words(n.select("source_key", F.col("_n").alias("w")), known, ("source_key",))
    hit = near.join(known.withColumnRenamed("w", "y"), ["source_key", "y"])
    best = hit.groupBy("source_key", F.col("x").alias("_n")).agg(F.min_by("_u", F.struct((F.col("x") != F.col("y")).cast("int"), "_u")).alias("_u"))
    return n.join(best, ["source_key", "_n"], "left").withColumn("url", F.coalesce("_u", "url")).drop("_u", "_n").select(*new.columns).dropDuplicates(["source_key", "url"])


def escape_xml(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rss_items(articles: DataFrame) -> DataFrame:
    """id, item: RSS 2.0 items."""
    cdata = F.replace(F.concat(F.lit("["), F.coalesce(F.col("heat").cast("string"), F.lit("")), F.lit("] "), F.coalesce("content", F.lit(""))), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    date = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(F.col("url")), F.lit("</link><description><![CDATA["), cdata, F.lit("]]></description><guid>"), escape_xml(F.col("url")), F.lit("</guid><pubDate>"), date, F.lit("</pubDate></item>"))
    return articles.select("id", "published_at", item.alias("item"))


def rss(articles: DataFrame, title: str, link: str, limit: int = 50) -> DataFrame:
    """One row with a feed of the newest articles (at most 100)."""
    newest = articles.orderBy(F.desc("published_at"), F.desc("id")).limit(min(max(1, limit), 100))
    body = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("published_at", "id", "item")), asc=False), lambda x: x["item"]))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    return rss_items(newest).agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("xml"))


def share_page(articles: DataFrame, width: int = 100) -> DataFrame:
    """id, html: a page with the article's title and excerpt for link previews."""
    text = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("…"))).otherwise(F.coalesce("content", F.lit("")))
    quoted = [F.replace(escape_xml(x), F.lit('"'), F.lit("&quot;")) for x in (F.col("title"), text)]
    return articles.select("id", F.concat(F.lit('<html><head><meta property="og:title" content="'), quoted[0], F.lit('"><meta property="og:description" content="'), quoted[1], F.lit('"></head><body></body></html>')).alias("html"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def mail_body(hits: DataFrame) -> DataFrame:
    """One row: the alert mail's text from hits by keyword (keyword, ids, n)."""
    line = F.format_string("%s: %d new", F.col("keyword"), F.col("n"))
    return hits.agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("body"))


class PayloadFiles(DataSource):
    """A plug-in source: one row (source_key, body) for each payload file ``<source_key>.<anything>`` of a folder."""

    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return "source_key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PayloadReader(self.options["path"])


class _PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import os

        from pyspark.sql.datasource import InputPartition

        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path))]

    def read(self, partition):
        import os

        with open(partition.value, encoding="utf-8") as f:
            yield os.path.basename(partition.value).split(".")[0], f.read()
