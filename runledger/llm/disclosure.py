"""Personal data, and the words that would give it away, found and replaced with SQL functions alone.

Base spans are e-mail and IP addresses, payment cards and telephone numbers, by pattern and check.
On top of them the method is information-theoretic sanitisation (after Sanchez and Batet's
C-sanitised model): the values found are the protected entities, and the corpus tells how strongly a
word of a text that holds one of them reveals it. With probabilities counted over all documents, a
word discloses an entity by

    PMI(word, entity) / IC(entity) = 1 + ln(together / word) / -ln(p(entity)),

which is 1 for a word that occurs only with it. Words above ``GENERALISE`` are generalised, above
``REMOVE`` removed, wherever they stand in a text that holds the entity, if at least ``SUPPORT``
different texts show them together. Words are runs of letters outside e-mail addresses (no other
kind of value has letters), of any length, and equal if they are so in lower case.

Patterns and positions: ``split`` gives the texts between matches and ``regexp_extract_all`` the
matches; their lengths, summed by a window over the matches of one text, are positions in code
points. The patterns are the stated ones, written so that they cannot go back over long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import KeyMap, Scratch

SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.95


@dataclass(frozen=True)
class Kind:
    name: str
    rank: int
    pattern: str
    hint: str


# The kinds with their patterns, and a cheap test that a text may hold one.
KINDS = (
    Kind("email", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", 1, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    Kind("card", 2, r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
TERM, TERM_RANK = "term", 4
_NO_LETTERS = r"[^\p{L}]+"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    count = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return (
        F.when(kind == "ip", F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)))
        .when(kind == "card", F.when(count.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .otherwise(True)
    )


def base_spans(texts: DataFrame) -> DataFrame:
    """``(k1, k2, kind, rank, begin, end, value)`` of all matches that pass their check.

    ``texts`` (k1, k2, text) holds one row for each different text.
    """
    found = None
    for kind in KINDS:
        some = texts.where(F.col("text").rlike(kind.hint)).select(
            "k1", "k2", F.regexp_extract_all("text", F.lit(f"({kind.pattern})"), F.lit(1)).alias("m"), F.split("text", kind.pattern, -1).alias("p")
        )
        rows = some.select(
            "k1", "k2", F.lit(kind.name).alias("kind"), F.lit(kind.rank).alias("rank"), "p", F.posexplode("m").alias("i", "value")
        ).select(
            "k1", "k2", "kind", "rank", "i", "value",
            F.length(F.get("p", F.col("i"))).alias("gap"),
        )
        found = rows if found is None else found.unionAll(rows)
    order = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = found.withColumn("end", end).withColumn("begin", F.col("end") - size)
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("k1", "k2", "kind", "rank", "begin", "end", "value")


def _entity() -> Column:
    """The protected value of a base span, by its kind."""
    normal = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    return F.concat_ws(":", "kind", normal)


def _words() -> Column:
    """All different words of a text as they are written, e-mail addresses left out."""
    email = KINDS[0]
    rest = F.when(F.col("text").rlike(email.hint), F.regexp_replace("text", email.pattern, " ")).otherwise(F.col("text"))
    return F.filter(F.array_distinct(F.split(rest, _NO_LETTERS)), lambda w: w != "")


def _terms() -> Column:
    return F.array_distinct(F.transform(_words(), F.lower))


def disclosing_terms(hits: DataFrame, own: DataFrame, copies: DataFrame, rows: DataFrame) -> DataFrame:
    """``(entity, term, strength)`` of words that reveal an entity, by counts over all documents.

    ``hits`` (k1, k2, text) has each different text that holds an entity, ``own`` (k1, k2, entity)
    its entities; ``copies`` (k1, k2, n) tells how many documents have a text; ``rows`` holds every
    document.
    """
    # An entity in fewer texts has no word with enough of them.
    entities = (
        own.join(copies, ["k1", "k2"]).groupBy("entity").agg(F.sum("n").alias("entity_docs"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT).drop("texts")
    )
    some = own.join(entities, "entity").groupBy("k1", "k2").agg(F.collect_list("entity").alias("entities")).join(copies, ["k1", "k2"])
    together = (
        hits.join(some, ["k1", "k2"]).select("n", "entities", F.explode(_terms()).alias("term"))
        .select("n", "term", F.explode("entities").alias("entity"))
        .groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    )
    frequency = rows.select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    documents = copies.agg(F.sum("n")).first()[0] or 0
    surprise = F.log(F.lit(documents) / F.col("entity_docs"))
    strength = F.when(surprise > 0, 1 + F.log(F.least(F.col("together") / F.col("term_docs"), F.lit(1.0))) / surprise)
    return (
        together.join(frequency, "term").join(entities, "entity")
        .select("entity", "term", strength.alias("strength")).where(F.col("strength") >= GENERALISE)
    )


def _term_spans(hits: DataFrame, own: DataFrame, terms: DataFrame) -> DataFrame:
    """``(k1, k2, kind, rank, begin, end, strength)`` of every place of a term in the texts that hold its entity."""
    entities = own.join(terms.select("entity").distinct(), "entity").groupBy("k1", "k2").agg(F.collect_list("entity").alias("entities"))
    told = (
        hits.join(entities, ["k1", "k2"]).select("k1", "k2", "entities", F.explode(_words()).alias("word"))
        .select("k1", "k2", "word", F.lower("word").alias("term"), F.explode("entities").alias("entity"))
        .join(terms, ["entity", "term"]).groupBy("k1", "k2", "word").agg(F.max("strength").alias("strength"))
        .groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("word", "strength"))).alias("words"))
    )
    # Words are letters alone, so they need no quoting.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("words"), "|"), F.lit(r")(?!\p{L})"))
    found = (
        hits.join(told, ["k1", "k2"]).withColumn("pattern", pattern)
        .select("k1", "k2", "words", F.regexp_extract_all("text", "pattern", F.lit(0)).alias("m"), F.split("text", F.col("pattern"), -1).alias("p"))
        .select("k1", "k2", "words", "p", F.posexplode("m").alias("i", "value"))
        .select("k1", "k2", "i", F.length("value").alias("size"), F.length(F.get("p", F.col("i"))).alias("gap"), F.element_at("words", F.col("value")).alias("strength"))
    )
    order = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    return placed.select("k1", "k2", F.lit(TERM).alias("kind"), F.lit(TERM_RANK).alias("rank"), (F.col("end") - F.col("size")).alias("begin"), "end", "strength")


def _listed(spans: Column, keep=None) -> Column:
    """``kind:begin:end`` of sorted spans, joined by commas."""
    some = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def _number(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts are known by 128 bits of hash; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__text": text, "__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text)})


def _spans_by_text(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(k1, k2, spans)``: sorted spans of each different text that has any; the strength of terms."""
    hint = "|".join(k.hint for k in KINDS)
    hits = scratch.keep(rows.where(F.col("text").rlike(hint)).dropDuplicates(["k1", "k2"]), "hits")
    base = scratch.keep(base_spans(hits), "base")
    own = scratch.keep(base.select("k1", "k2", _entity().alias("entity")).distinct(), "own")
    copies = scratch.keep(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")), "copies")
    terms = scratch.keep(disclosing_terms(hits, own, copies, rows), "terms")
    extra = _term_spans(hits, own, terms)
    spans = base.select("k1", "k2", "kind", "rank", "begin", "end", F.lit(None).cast("double").alias("strength")).unionByName(extra)
    # A term inside a value goes with the value.
    order = Window.partitionBy("k1", "k2").orderBy("begin", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("rank") < TERM_RANK, F.col("end"))).over(order)
    spans = spans.withColumn("reach", reach).where((F.col("rank") < TERM_RANK) | F.col("reach").isNull() | (F.col("reach") <= F.col("begin")))
    fields = F.struct("begin", "rank", "end", "kind", "strength")
    found = scratch.keep(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(fields)).alias("spans")), "spans")
    scratch.drop(hits, base, own, copies, terms)
    return found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms)`` for each row of ``docs``.

    Null texts count as empty. Repeated rows are each returned, ids may be null. Equal texts have
    equal spans. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    keyed = _keyed(docs.select(F.col(id_col), F.col(text_col).alias("__t")), "__t")
    rows = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    by_text = _spans_by_text(rows, scratch)
    brief = keyed.select(id_col, F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    spans = F.coalesce("spans", F.array().cast(by_text.schema["spans"].dataType))
    out = brief.join(by_text, ["k1", "k2"], "left").withColumn("spans", spans)
    counts = [_number(k.rank).alias(f"n_{k.name}") for k in KINDS]
    return out.select(
        id_col, *counts,
        F.sha2(_listed(F.col("spans"), lambda s: s["rank"] < TERM_RANK), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        _number(TERM_RANK).alias("n_terms"),
    )


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced: values by their kind, terms by ``[WORD]`` or by nothing.

    Where spans overlap, the first one's replacement stands for all of them. Rows without spans,
    null texts included, are returned as they are; so are all other columns.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    keyed = _keyed(docs, text_col)
    rows = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__text").alias("text"))
    by_text = _spans_by_text(rows, scratch)
    # Drop spans that begin before an earlier one ends; the earlier one then reaches as far.
    merged = F.aggregate(
        "spans",
        F.array().cast(by_text.schema["spans"].dataType),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["begin"]),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(F.element_at(a, -1).withField("end", F.greatest(F.element_at(a, -1)["end"], s["end"]))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    said = lambda s: (
        F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["strength"] >= REMOVE, "").otherwise("[WORD]")
    )
    text = F.col("__text")
    pieces = F.transform(
        "__spans",
        lambda s, i: F.concat(
            text.substr(F.when(i == 0, 1).otherwise(F.get("__spans", i - 1)["end"] + 1).cast("int"),
                        (s["begin"] - F.when(i == 0, 0).otherwise(F.get("__spans", i - 1)["end"])).cast("int")),
            said(s),
        ),
    )
    rest = text.substr((F.element_at("__spans", -1)["end"] + 1).cast("int"), F.length(text))
    cleaned = F.concat(F.array_join(pieces, ""), rest)
    side = by_text.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), merged.alias("__spans"))
    # Texts without spans, most of them, are not shuffled.
    some, rest = KeyMap(by_text.withColumnRenamed("k1", "__k1"), "__k1").parted(keyed.drop("__text"))
    out = some.join(side, ["__k1", "__k2"], "left").withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cleaned))
    return out.select(docs.columns).union(rest.select(docs.columns))
