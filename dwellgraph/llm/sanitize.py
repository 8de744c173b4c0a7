"""Personal data: patterns, and terms of the corpus that give protected entities away. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Every distinct value of them is a protected entity. Its contexts are the
CONTEXT code points on either side of each occurrence. How much a term t tells of an entity e is estimated from
the whole corpus: PMI(t, e) = log(N * joint(t, e) / (df(t) * df(e))), where all four count distinct texts: all, those with the term in a context of the entity,
those with the term anywhere, those with the entity. So exact copies count once everywhere, and a term that is only ever beside an entity tells all of it.
Its share of the entity's information content -log(df(e) / N) is the disclosure. A term that is in the contexts of an entity is
generalised if its disclosure exceeds GENERALISE, and removed if it exceeds REMOVE, wherever it stands in a context of that entity. What is beside an entity
in fewer than LEAST_JOINT texts may be there by chance, so such a term counts only if it is rare enough to exceed REMOVE: with one text, df(t) <= N^(1 - REMOVE).

Positions come from splitting a text at a pattern's matches: matches and the pieces between them alternate, so their lengths add up to the offsets.
The patterns are written so that Java's matcher takes linear time; they match what the plain ones do.

Defined cases: null is an empty text without spans; overlapping spans of different kinds all count, and in the sanitised text the first one's
replacement stands for them; repeated rows get the same spans; rows of one id with different texts are kept apart by a hash of the text; an empty table
gives an empty result; columns other than the ones named are passed through by `sanitised` and ignored by `spans`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
WORD = r"\p{L}{2,}"
CONTEXT = 80
LEAST_JOINT = 2
GENERALISE = 0.5
REMOVE = 0.9
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(p.rlike("^0+$"), 0), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern with their code point offsets."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """array of SPAN, by start and kind. Matches that fail their test are dropped, not tried again."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.coalesce(text, F.lit(""))
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        found.append(F.when(text.rlike(HINTS[kind]), F.filter(_located(text, pattern, number), _test(kind))).otherwise(none))
    return F.array_sort(F.concat(*found))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column, begin: Column) -> Column:
    """The words of a window with their offsets in the whole text."""
    return F.transform(_located(text, WORD, KINDS.index("term")), lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"), F.lower(s["value"]).alias("term")))


def occurrences(base: DataFrame) -> DataFrame:
    """(row, copy, entity, words) of every base span of (row, text, spans), copy being a hash of the text; a word that the window cuts is left out."""
    each = base.select("row", "text", F.explode("spans").alias("s"))
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), F.when(F.col("s.kind") == 0, F.lower("s.value")).otherwise(_digits(F.col("s.value"))))
    left_at = F.greatest(F.col("s.start") - CONTEXT, F.lit(0))
    left = F.substring(F.col("text"), left_at + 1, F.col("s.start") - left_at)
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(CONTEXT))
    whole_left = F.when(left_at > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    whole_right = F.when(F.length("text") > F.col("s.end") + CONTEXT, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    cutoff = each.select("row", entity.alias("entity"), F.xxhash64("text").alias("copy"), whole_left.alias("l"), whole_right.alias("r"), (F.col("s.start") - F.length(whole_left)).alias("l_at"), F.col("s.end").alias("r_at"))
    return cutoff.select("row", "copy", "entity", F.concat(_words(F.col("l"), F.col("l_at")), _words(F.col("r"), F.col("r_at"))).alias("words"))


def disclosing(docs: DataFrame, contexts: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the terms that give entities away; all counts are of distinct texts."""
    copy = F.xxhash64(text)
    n = docs.select(copy.alias("copy")).distinct().count()
    entities = contexts.select("entity", "copy").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    joint = contexts.select("entity", "copy", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")).distinct()
    joint = joint.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint"))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    once = docs.select(copy.alias("copy"), F.col(text).alias(text)).dropDuplicates(["copy"])
    df = once.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    known = joint.join(df, "term").join(entities, "entity")
    pmi = F.log(F.lit(float(n)) * F.col("joint") / (F.col("df_t") * F.col("df_e")))
    content = -F.log(F.col("df_e") / F.lit(float(n)))
    least = F.when(F.col("joint") >= LEAST_JOINT, F.lit(GENERALISE)).otherwise(F.lit(REMOVE))
    told = known.filter(F.col("df_e") < n).withColumn("disclosure", pmi / content)
    return told.filter(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, base, terms) of every row: base spans, and term spans whose value says whether the term is removed or generalised.

    row is a hash of key and text, by which spans and texts can be joined again.
    """
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    found = rows.select("key", F.xxhash64("key", "text").alias("row"), "text", base_spans(F.col("text")).alias("spans"))
    base = cut(found.select("key", "row", "spans"))
    # Contexts of the rows that have spans, made in the same way again: only they carry words on.
    contexts = cut(occurrences(found.filter(F.size("spans") > 0).dropDuplicates(["row"])))
    telling = disclosing(rows, contexts)
    placed = contexts.select("row", "entity", F.explode("words").alias("w")).select("row", "entity", F.col("w.term").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    action = F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    flagged = placed.join(telling, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    span = F.struct(F.col("start"), F.lit(KINDS.index("term")).alias("kind"), F.col("end"), action.alias("value")).cast(SPAN)
    terms = flagged.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("terms"))  # at most a text's words near its base spans
    none = F.array().cast(f"array<{SPAN}>")
    return base.join(terms, "row", "left").select(F.col("key").alias(key), "row", F.col("spans").alias("base"), F.coalesce("terms", none).alias("terms"))


def replaced(text: Column, all_spans: Column) -> Column:
    """The text with base spans as [KIND], generalised terms as [TERM] and removed ones left out."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["value"] == "remove", F.lit("")).otherwise(F.element_at(marks, s["kind"] + 1))
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = F.concat(acc["out"], before, F.when(s["start"] >= acc["at"], mark).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(all_spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the sanitised text in place of the text; a null text stays null."""
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    row, all_spans = free("_row"), free("_spans")
    found = spans(docs, key, text).select(F.col("row").alias(row), F.array_sort(F.concat("base", "terms")).alias(all_spans)).filter(F.size(all_spans) > 0).dropDuplicates([row])
    joined = docs.withColumn(row, F.xxhash64(docs[key], F.coalesce(docs[text], F.lit("")))).join(found, row, "left")
    fresh = F.when(F.col(all_spans).isNotNull(), replaced(F.col(text), F.col(all_spans))).otherwise(F.col(text))
    return joined.select(*[fresh.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
