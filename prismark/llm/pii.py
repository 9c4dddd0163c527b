"""Personal data: fixed patterns, and terms whose co-occurrence with protected entities gives these away.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm.common import SPACE, cut, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that none is tried again inside what it has scanned: a match starts where the run of its first
#: characters starts or where the last match ended, and repeats give nothing back. They find what the plain
#: patterns find, in time proportional to the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "%@%", "phone": "%+%"}
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Disclosure:
    """When a term gives an entity away. strength: 1 means that it is met only with the entity, 0 that it tells nothing."""

    window: int = 5  # words on either side of an entity
    min_contexts: int = 2  # different surroundings, so that copies of one text are one witness
    generalise: float = 0.7
    remove: float = 0.9
    min_chars: int = 3


#: Up to so many terms (a few hundred kB) are sent to all tasks.
FEW = 10_000


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the end, every second digit doubled, its digits added."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda mentions besides its arguments is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column, chunk: int = 256) -> Column:
    """Sums of an array up to each place, that place included; chunk by chunk, so that no long array is copied for each place."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))

    def up(part: Column) -> Column:
        return F.aggregate(part, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + x)).alias("sums")), lambda a: a["sums"])

    def parts(a: Column) -> Column:
        n = F.size(a)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda k: F.slice(a, k * chunk + 1, chunk))).otherwise(F.array().cast("array<array<bigint>>"))

    def joined(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), up(F.transform(inner, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda p, s: F.transform(p, lambda x: x + s)))

    return let(sizes, lambda a: let(F.transform(parts(a), up), joined))


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of all matches, leftmost first, in code points.

    The text is split at the matches; what lies between them and the matches themselves add up to the places.
    """

    def places(b: Column) -> Column:
        sizes = F.zip_with(F.slice(b["gaps"], 1, F.size(b["values"])), b["values"], lambda g, v: (F.length(g) + F.length(v)).cast("long"))
        return F.zip_with(b["values"], running(sizes), lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), places)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def with_base_spans(df: DataFrame, text: str = "text", name: str = "base_spans") -> DataFrame:
    """df with an array of (kind, start, end, value): by kind as listed, then start. Null text: none."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPANS)
    parts = []
    for kind in KINDS:
        hint = t.like(HINT[kind]) if kind in HINT else t.rlike("[0-9]")
        if kind == "ip":
            hint = t.rlike(r"[0-9]\.[0-9]")
        if kind == "card":
            hint = t.rlike(r"(?:[0-9][\x20-]?+){12}[0-9]")
        found = F.filter(spans_of(t, PATTERNS[kind], kind), _check(kind))
        parts.append(F.when(hint, found).otherwise(none).cast(SPANS))
    return df.withColumn(name, F.concat(*parts))


def entity(span: Column) -> Column:
    """What a span stands for, however it is written: the address in lower case, or the digits."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", "")))


#: What a word is stripped of, and lower-cased, to make a term.
def term_of(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", ""))


#: What lies between two terms: a run without letters and figures that holds white space. A run is tried at its start only.
BETWEEN = r"(?<![^A-Za-z0-9\p{L}\p{N}])[^A-Za-z0-9\x20\x09-\x0D\p{L}\p{N}]*+[\x20\x09-\x0D][^A-Za-z0-9\p{L}\p{N}]*+"


def terms_in(text: Column) -> Column:
    """The different term_of() of a text's words, by one split of the whole text; also the empty term."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.array_distinct(F.transform(F.array_distinct(F.split(padded, BETWEEN, -1)), F.lower))


def _word_rows(held: DataFrame) -> DataFrame:
    """(key, at, start, end, term) of every word of the texts in held(key, t): start and end in code points."""
    spans = held.select("key", F.posexplode(spans_of(F.col("t"), WORD, "word")).alias("at", "s"))
    return spans.select("key", "at", F.col("s.start").alias("start"), F.col("s.end").alias("end"), term_of(F.col("s.value")).alias("term"))


WORD = r"[^\x20\x09-\x0D]++"


def word_places(starts: Column, spans: Column) -> Column:
    """For each of spans (start, end), sorted by start: (first, last), the numbers of the words it covers, of which starts has the places.

    The words' places and both ends of all spans are sorted together (two sorted lists, so one merge): as many words
    begin before an end as its place in that list, less the ends before it. So the time is that of a merge, however
    many spans a text has. Spans must begin and end inside words.
    """

    def at(place: Column, kind: int, k: Column) -> Column:
        return F.struct(place.cast("long").alias("place"), F.lit(kind).alias("kind"), k.cast("int").alias("k"))

    def ends(x: Column) -> Column:  # words before ends at the same place; an end's own last character counts
        first, last = F.transform(x["spans"], lambda s, k: at(s["start"], 1, k)), F.transform(x["spans"], lambda s, k: at(s["end"] - 1, 2, k))
        return F.struct(F.transform(x["starts"], lambda p, k: at(p, 0, k)).alias("words"), F.transform(F.array_sort(F.concat(first, last)), lambda e, n: F.struct(e["place"].alias("place"), e["kind"].alias("kind"), e["k"].alias("k"), n.alias("n"))).alias("ends"))

    def merged(x: Column) -> Column:
        wide = F.transform(x["words"], lambda w: F.struct(w["place"].alias("place"), w["kind"].alias("kind"), w["k"].alias("k"), F.lit(0).alias("n")))
        return F.array_sort(F.concat(wide, x["ends"]))

    def counted(all_: Column) -> Column:
        placed = F.transform(all_, lambda e, p: F.struct(e["k"].alias("k"), e["kind"].alias("kind"), (p - e["n"] - 1).cast("int").alias("word")))
        return F.array_sort(F.filter(placed, lambda e: e["kind"] > 0))

    def paired(e: Column) -> Column:
        return F.transform(F.filter(e, lambda x: x["kind"] == 1), lambda x, k: F.struct(x["word"].alias("first"), F.get(e, 2 * k + 1)["word"].alias("last")))

    return let(let(let(F.struct(starts.alias("starts"), spans.alias("spans")), ends), merged), lambda all_: let(counted(all_), paired))


def surroundings(held: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, entity, first, at, term) of the words within `window` words of an entity, and (key, at) of the words that entities
    cover, for the texts held(key, t, spans, n). Only these words become rows; all others stay in their text's row."""

    def of_words(w: Column) -> Column:
        return F.struct(F.transform(w, lambda x: x["start"]).alias("starts"), F.transform(w, lambda x: x["value"]).alias("values"))

    def one(x: Column) -> Column:
        near = F.concat(*[F.sequence(F.lit(a), F.lit(b)) for a, b in ((-window, -1), (1, window))])

        def around(e: Column, c: Column) -> Column:
            places = F.transform(near, lambda d: F.when(d < 0, c["first"] + d).otherwise(c["last"] + d))
            return F.filter(F.transform(places, lambda p: F.struct(p.alias("at"), F.get(x["values"], p).alias("word"))), lambda w: w["word"].isNotNull())

        return F.zip_with(x["spans"], x["covers"], lambda e, c: F.struct(e["entity"].alias("entity"), c["first"].alias("first"), c["last"].alias("last"), around(e, c).alias("near")))

    def placed(x: Column) -> Column:
        return let(F.struct(x["spans"].alias("spans"), x["w"]["values"].alias("values"), word_places(x["w"]["starts"], x["spans"]).alias("covers")), one)

    named = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), entity(s).alias("entity"))))
    words = let(spans_of(F.col("t"), WORD, "word"), of_words)
    ents = cut(held.select("key", "n", F.explode(let(F.struct(named.alias("spans"), words.alias("w")), placed)).alias("e")).select("key", "n", "e.*"), "entities")
    covered = ents.select("key", F.explode(F.sequence("first", "last")).alias("at")).distinct()
    near = ents.select("key", "n", "entity", "first", F.explode("near").alias("w")).select("key", "n", "entity", "first", F.col("w.at").alias("at"), term_of(F.col("w.word")).alias("term"))
    return near, covered


def disclosures(held: DataFrame, n_docs: int, docs_terms: Callable[[DataFrame], DataFrame], rule: Disclosure, few: int = FEW) -> DataFrame:
    """(key, extra) of the words to generalise or remove in the texts held(key, t, spans, n), one row for each different text
    with entities and n, how often it occurs; extra lists (start, end, action, term).

    For an entity e and a term t near it: strength = PMI(e; t) / -log2 P(e) = 1 + log2(co / df(t)) / log2(N / df(e)), of
    N documents, df those that hold them, co those that hold t near e. Near means within rule.window words.
    """
    near, covered = surroundings(held, rule.window)
    around = near.where(F.length("term") >= rule.min_chars).join(covered, ["key", "at"], "left_anti")
    context = around.groupBy("key", "n", "entity", "first").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # 2 x window terms at most
    pairs = context.select("key", "n", "entity", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
    # one row for each text that holds the term near the entity in a context; texts are counted once, contexts over all texts
    seen = cut(pairs.distinct(), "near")
    strong = seen.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= rule.min_contexts).select("entity", "term")
    counts = seen.select("entity", "term", "key", "n").distinct().groupBy("entity", "term").agg(F.sum("n").alias("co"))
    df_e = held.select("n", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).groupBy("entity").agg(F.sum("n").alias("df_e"))

    def strength(df_t: str) -> Column:
        return F.round(1 + F.log2(F.col("co") / F.col(df_t)) / F.greatest(F.log2(F.lit(float(max(2, n_docs))) / F.col("df_e")), F.lit(1e-9)), 9)

    # the texts at hand alone bound df(t) from below, hence strength from above: common words need not be counted in all others.
    # Words are counted before they are joined: most open terms occur in many texts
    open_pairs = cut(strong.join(counts, ["entity", "term"]).join(df_e, "entity"), "open")
    here = count_terms(held.select(F.col("t").alias("text"), "n"), open_pairs.select("term").distinct(), -1).withColumnRenamed("df_t", "df_here")
    asked = cut(open_pairs.join(here, "term").where(strength("df_here") >= rule.generalise).select("entity", "term", "co", "df_e"), "asked")
    df_t = docs_terms(asked.select("term").distinct())
    told = asked.join(df_t, "term").withColumn("strength", strength("df_t")).where(F.col("strength") >= rule.generalise)
    action = F.when(F.col("strength") >= rule.remove, F.lit("remove")).otherwise(F.lit("generalise"))
    told = cut(told.select("entity", "term", action.alias("action")), "told")
    in_text = held.select("key", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).join(told, "entity").groupBy("key", "term").agg(F.max("action").alias("action"))  # remove sorts after generalise
    in_text = cut(in_text, "in_text")
    # only texts that hold what is told are taken apart word by word
    open_texts = held.join(in_text.select("key").distinct(), "key", "left_semi")
    words = _word_rows(open_texts).join(in_text, ["key", "term"]).join(covered, ["key", "at"], "left_anti")
    return words.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action", "term"))).alias("extra"))


def count_terms(docs: DataFrame, asked: DataFrame, few: int = FEW) -> DataFrame:
    """(term, df_t): how many of docs(text, n), n times each, hold each of the different terms asked for. Null texts hold none.

    Up to `few` terms go to all tasks, so that no other word is shuffled; more are met after words have been counted
    (combined before the shuffle). The counts are the same either way."""
    asked = cut(asked, "terms")
    each = docs.select("n", F.explode(terms_in(F.col("text"))).alias("term"))
    if asked.count() <= few:
        return each.join(F.broadcast(asked), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df_t"))
    # an inner join: a semi join would be pushed below the aggregation, where every word is a row
    return each.groupBy("term").agg(F.sum("n").alias("df_t")).join(asked, "term")


def find(df: DataFrame, text: str = "text", rule: Disclosure = Disclosure(), few: int = FEW) -> DataFrame:
    """df with base_spans (kind, start, end, value) and extra (start, end, action, term), places in code points.

    base_spans are e-mail addresses, IP addresses, card and phone numbers. extra are words of texts with such an
    entity that give the entity away, by how they occur with it over the whole corpus (Disclosure).

    Equal texts are met once, with their count, so that copies fill no task. In texts with entities only the words near
    these become rows; all texts are counted for the terms in question (count_terms; `few` chooses its plan only). Null
    and empty texts have no spans; a very long text is one row, met in time in proportion to its length, however many
    entities it holds; terms that tie at a threshold are all taken; repeated rows have equal spans; an empty table
    stays empty. Columns of df pass through; base_spans, extra and names that start with __ are replaced.
    """
    df = df.drop("base_spans", "extra", "__key")
    based = with_base_spans(df, text).withColumn("__key", F.when(F.size("base_spans") > 0, F.sha2(F.col(text), 256)))
    holders = based.where("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("n"), F.any_value(F.col(text)).alias("t"))
    held = cut(with_base_spans(holders, "t", "spans"), "held")
    n_docs = df.count()

    def docs_terms(asked: DataFrame) -> DataFrame:
        """In how many of all documents each term asked for occurs."""
        return count_terms(df.select(F.col(text).alias("text"), F.lit(1).cast("long").alias("n")), asked, few)

    extra = disclosures(held, n_docs, docs_terms, rule, few)
    # texts without an entity are dealt out by a hash of their own, not all to one task
    keyed = based.withColumn("__key", F.coalesce("__key", F.concat(F.lit("-"), F.xxhash64(F.col(text)).cast("string"), F.monotonically_increasing_id().cast("string"))))
    out = keyed.join(extra.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    return out.withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<start:bigint,end:bigint,action:string,term:string>>")))


def kind_of(word: Column) -> Column:
    """The class a word is generalised to: figures, letters with figures, a capitalised word, any other."""
    figures, letters = word.rlike(r"\p{N}"), word.rlike(r"\p{L}")
    return F.when(figures & ~letters, "[NUMBER]").when(figures, "[CODE]").when(word.rlike(r"^[^\p{L}]*\p{Lu}"), "[NAME]").otherwise("[WORD]")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """find()'s rows with the text cleaned: entities become [EMAIL], [IP], [CARD] or [PHONE]; terms to generalise become what
    kind of word they are ([NUMBER], [CODE], [NAME] or [WORD], see kind_of), terms to remove nothing.

    Overlapping spans are replaced once, from the leftmost, the longest first. Null texts stay null. base_spans
    and extra are dropped.
    """
    marks = F.concat(
        F.transform("base_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))),
        F.transform("extra", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.when(s["action"] == "remove", F.lit("")).otherwise(kind_of(F.substring(F.col(text), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("mark"))),
    )
    t = F.col(text)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, m: Column) -> Column:
        skip = m["start"] < a["at"]
        piece = F.substring(t, (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int"))
        return F.when(skip, a).otherwise(F.struct((-m["neg"]).alias("at"), F.concat(a["out"], F.array(piece, m["mark"])).alias("out")))

    cleaned = F.aggregate(F.array_sort(marks), begin, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return found.withColumn(text, F.when((F.size("base_spans") > 0) | (F.size("extra") > 0), cleaned).otherwise(t)).drop("base_spans", "extra")


def op6_term_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base_spans", written)
    extra = F.transform("extra", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, extra), ",").alias("spans"), F.size("extra").cast("long").alias("n_term"))
