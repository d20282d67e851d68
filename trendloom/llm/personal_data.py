"""Personal data with DataFrame functions only: patterns, and terms that reveal what the patterns protect.

Emails, IP addresses, card and phone numbers (the protected entities) are found by patterns; a document's text is cut at
its matches, so that offsets are running sums of lengths. Around each mention the words of CONTEXT characters on either
side are its context. Over the corpus the rows that hold a term, those that hold an entity and those that hold
the term in a context of the entity give the pointwise mutual information of both; divided by the information
content of the entity it is the term's disclosure: 1 where the term occurs with the entity only, 0 where both are
independent. A term is trusted from ``least_contexts`` different contexts with one entity on, so that copies of one text
prove nothing. Terms from ``generalise`` on are generalised (their first letter, digits to zeros), those from ``remove`` on
removed, wherever they stand outside the patterns' matches.

All counts are grouped sums with partial sums before the shuffle: of entities, terms and pairs of both within contexts
of bounded length, never of all terms of a document by its entities. What is broadcast was counted first; beyond the bound
the same joins shuffle, with terms salted by document.

Defined results: a null text is empty and has no spans; null ids stay null; repeated ids are judged row by row, and rows
that agree in id and text count as one where they hold an entity; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint

#: Kinds in the order of the results. The patterns match what the plain ones do ([A-Za-z0-9._%+-]+@..., digits and dots, digits
#: with single separators, + and digits) but never try a run of characters twice: a run whose head fails fails everywhere.
LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
#: Characters of context on either side; terms and documents that are broadcast at most (under 100 bytes each); salts.
CONTEXT, BROADCAST, SALTS = 80, 100_000, 32
#: Places whose running sums are appended one by one.
RUN = 512
LEAST_CONTEXTS, GENERALISE, REMOVE = 3, 0.9, 0.97


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Sums of what lies before each place of an array of bigint."""

    def sums(of: Column, start: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(of, F.struct(start.alias("at"), none.alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def parts(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda j: F.slice(v, j * RUN + 1, F.lit(RUN)))
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.expr("0L"), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(chunks, sums(totals, F.expr("0L")), sums))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_let(values, parts))


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, end, value, left, right) of the matches of a pattern, which were found before."""
    pieces = F.split(text, pattern, -1)

    def build(p: Column) -> Column:
        lengths = F.zip_with(F.slice(p, F.lit(1), F.size(matches)), matches, lambda x, m: (F.length(x) + F.length(m)).cast("bigint"))
        return F.zip_with(
            running(lengths),
            F.transform(matches, lambda m, i: F.struct(m.alias("value"), F.get(p, i).alias("left"), F.get(p, i + 1).alias("right"))),
            lambda at, x: F.struct((at + F.length(x["left"])).alias("start"), (at + F.length(x["left"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.substring(x["left"], -CONTEXT, CONTEXT).alias("left"), F.substring(x["right"], 1, CONTEXT).alias("right")),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>")
    return F.when(F.size(matches) == 0, none).otherwise(_let(pieces, build))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """What a mention stands for: addresses whatever their case, numbers whatever their separators."""
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(value, "[^0-9]", "") if kind in ("card", "phone") else F.lower(value))


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Documents with arrays of the valid matches of each kind, in columns named by kind."""
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        need = NEEDS[kind]
        docs = docs.withColumn(f"_m_{kind}", F.when(F.col(text).contains(need), found).otherwise(F.array().cast("array<string>")) if need else found)
    for kind, pattern in KINDS.items():
        docs = docs.withColumn(kind, F.filter(located(F.col(text), pattern, F.col(f"_m_{kind}")), lambda s: _valid(kind, s["value"])))
    return docs.drop(*(f"_m_{k}" for k in KINDS))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def context_terms(left: Column, right: Column) -> Column:
    """The distinct terms of a context without the words that its edges cut."""
    left = F.when(F.length(left) == CONTEXT, F.regexp_replace(left, rf"^{TERM}", "")).otherwise(left)
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, rf"{TERM}$", "")).otherwise(right)
    return F.array_distinct(F.concat(terms(left), terms(right)))


def _small(df: DataFrame, n: int) -> DataFrame:
    """The rows as a broadcast where their counted number is small."""
    return F.broadcast(df) if n <= BROADCAST else df


def _words_of_rows(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(h1, h2, term, ...) of the wanted terms, once for each row that has them; where the wanted are many, salted by row."""
    words = docs.select("h1", "h2", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if n_wanted <= BROADCAST:
        return words.join(F.broadcast(wanted), "term")
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.withColumn("_salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


def disclosing_terms(base: DataFrame, docs: DataFrame, least_contexts: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, disclosure, action) of the terms that reveal some entity; ``base`` has the mentions, ``docs`` h1, h2 and text of all rows."""
    mentions = F.flatten(F.array(*(F.transform(k, lambda s: F.struct(entity(k, s["value"]).alias("entity"), context_terms(s["left"], s["right"]).alias("terms"))) for k in KINDS)))
    found = base.select("h1", "h2", F.explode(mentions).alias("_m")).select("h1", "h2", "_m.entity", F.xxhash64("_m.terms").alias("context"), "_m.terms")
    holding = found.groupBy("h1", "h2", "entity").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = found.select("h1", "h2", "entity", "context", F.explode("terms").alias("term")).filter(F.col("term").rlike(r"\p{L}|[0-9]{3}"))
    rows = pairs.groupBy("entity", "term", "h1", "h2").agg(F.min("context").alias("context"))
    both = rows.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")).filter(F.col("contexts") >= least_contexts)
    both = checkpoint(both.join(holding, "entity"))
    wanted = both.select("term").distinct()
    n_wanted, n_rows = wanted.count(), base.count()
    # counted before they meet: a frequent word is one row of each task, not one of each document
    held = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).join(_small(wanted, n_wanted), "term")
    known = F.log(F.lit(n_rows) / F.col("n_entity"))
    information = F.log(F.col("n_both") * F.lit(float(n_rows)) / (F.col("n_entity") * F.col("n_term")))
    judged = both.join(_small(held, n_wanted), "term").withColumn("disclosure", F.when(known > 0, information / known).otherwise(0.0))
    worst = judged.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= generalise)
    return checkpoint(worst.withColumn("action", F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")))


def _inside(span: Column, kinds: list[Column]) -> Column:
    """Whether a term lies in a match of the patterns."""
    out = F.lit(False)
    for k in kinds:
        out = out | F.exists(k, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_contexts: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row: id, key of the row (h1, h2), arrays of (start, end, value) of each kind, ``generalised`` and ``removed`` alike."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("_id", "text"), "h2": F.xxhash64("text", "_id", F.lit(1))})
    base = checkpoint(with_base_spans(rows, "text").drop("text"))
    found = disclosing_terms(base, rows, least_contexts, generalise, remove)
    n_terms = found.count()
    flagged = checkpoint(_words_of_rows(rows, found.select("term", "action"), n_terms).groupBy("h1", "h2").agg(F.collect_set(F.struct("term", "action")).alias("_terms")))
    n_rows = flagged.count()
    held = rows.join(_small(flagged, n_rows), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    places = located(F.col("text"), TERM, F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    actions = F.map_from_entries("_terms")
    spans = held.select("h1", "h2", "_terms", F.filter(places, lambda s: F.array_contains(F.transform("_terms", lambda t: t["term"]), F.lower(s["value"]))).alias("_all"))
    spans = spans.select("h1", "h2", *(F.filter("_all", lambda s: F.get(F.map_values(F.map_filter(actions, lambda k, v: k == F.lower(s["value"]))), F.lit(0)) == a).alias(a) for a in ("generalised", "removed")))
    joined = base.join(_small(spans, n_rows), ["h1", "h2"], "left")
    plain = "array<struct<start:bigint,end:bigint,value:string>>"
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    kinds = [F.col(k) for k in KINDS]
    added = {a: F.coalesce(F.filter(short(F.col(a)), lambda s: ~_inside(s, kinds)), F.array().cast(plain)) for a in ("generalised", "removed")}
    return joined.select(F.col("_id").alias(id_col), "h1", "h2", *(short(F.col(k)).alias(k) for k in KINDS), *(v.alias(a) for a, v in added.items()))


def _joined(kinds: list[str]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    parts = [F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_generalised, n_removed."""
    found = find_personal_data(docs, id_col, text_col, **thresholds)
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(list(KINDS)), 256).alias("base_sha256"), _joined([*KINDS, "generalised", "removed"]).alias("spans"), F.size("generalised").cast("bigint").alias("n_generalised"), F.size("removed").cast("bigint").alias("n_removed"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """Documents with ``text`` in which matches are their kind in brackets, generalised terms their first letter (digits: zeros),
    removed terms nothing. Where matches overlap, the one that begins first counts (of these the longer) and the others' rest goes."""
    spans = find_personal_data(docs, id_col, text_col, **thresholds).dropDuplicates(["h1", "h2"])
    general = lambda v: F.when(v.rlike(r"^[0-9]"), F.regexp_replace(v, "[0-9]", "0")).otherwise(F.concat(F.substring(v, 1, 1), F.lit(".")))
    parts = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(f"[{k.upper()}]").alias("new"))) for k in KINDS]
    parts.append(F.transform("generalised", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), general(s["value"]).alias("new"))))
    parts.append(F.transform("removed", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit("").alias("new"))))
    edits = spans.select("h1", "h2", F.sort_array(F.concat(*parts)).alias("_edits"))
    rows = docs.withColumns({"h1": F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))), "h2": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), id_col, F.lit(1))})
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cut(acc: Column, e: Column) -> Column:
        before = F.when(e["start"] >= acc["at"], F.concat(F.substring(text, acc["at"].cast("int") + 1, (e["start"] - acc["at"]).cast("int")), e["new"])).otherwise("")
        return F.struct(F.greatest(acc["at"], -e["end"]).alias("at"), F.array_append(acc["out"], before).alias("out"))

    start = F.struct(F.expr("0L").alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate("_edits", start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return rows.join(edits, ["h1", "h2"]).withColumn(text_col, new).select(*docs.columns)
