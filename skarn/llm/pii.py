"""Information-theoretic sanitisation, in DataFrame and SQL functions alone.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers
that patterns find.  A term (a word of letters outside the entities) in a text
with an entity may reveal it as well.  Over the whole corpus, with N texts, n(e)
texts with the entity, n(t) with the term and n(e,t) with both, wherever they
stand in the text, the term discloses

    PMI(e; t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e))

of the entity's information: 1 if it never occurs elsewhere, 0 if it is
independent.  Terms from ``GENERALISE`` on are generalised to a class, from
``REMOVE`` on removed, given at least ``SUPPORT`` different texts with both.

They are in every text that has them, with or without the entity.

Plan: one pass finds the entities of every row; a narrow table keeps them.  Only
an entity of ``SUPPORT`` different texts can have a term with as many, so only
its texts, each once, give (entity, term) pairs.  Entities of the very same texts
have the same counts with every term, so one of them stands for all: a page of
two thousand addresses gives a pair for each of its terms, not two thousand.  A
second pass counts terms, aggregated before the shuffle.  Pairs meet term counts
in a join on the term.  A third pass finds the texts of the terms that disclose.
A text is known by its SHA-256.  A pass that wants few texts or words sifts the
others out where they lie, by bits that the wanted ones set, before the exact join
shuffles the rest.  Joins of rows with their text's terms are salted by the rows'
partition where a text has many copies, so these don't meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import stash

GENERALISE, REMOVE, SUPPORT = 0.9, 0.98, 3
#: Parts that the copies of a text are dealt into, and matches whose places are found in one go.
SALTS, FEW = 32, 32
#: Rows of one text from which on it is dealt, and most bits of a sieve (two megabytes).
MANY, MOST_BITS = 256, 1 << 24
KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that the method adds, by what is done to them.
TERM_KINDS = ("generalised", "removed")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each finds what the plain pattern finds leftmost and without overlap; look-behinds and possessive loops keep the time
#: linear in the text and the stack flat, whatever the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running.
_GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What may be a term: a word of three letters, of two with a capital first, or of one or two without case.
TERM = r"(?<!\p{L})(?:\p{L}{3,}+|\p{Lu}\p{L}|\p{Lo}{1,2})(?!\p{L})"
WORD = r"\p{L}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _valid_of(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def find_spans(text: Column, pattern: Column, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches (those whose value ``keep`` wants), in code points, end exclusive.

    Splitting at the matches gives the stretches between them, whose lengths
    give the places.
    """
    values, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    spans = "array<struct<kind: string, start: int, end: int, value: string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, v: Column) -> Column:
        first = acc["at"] + F.char_length(v["gap"])
        end = first + F.char_length(v["value"])
        more = F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"), v["value"].alias("value"))))
        return F.struct(end.alias("at"), (more if keep is None else F.when(keep(v["value"]), more).otherwise(acc["out"])).alias("out"))

    def blocks(acc: Column, block: Column) -> Column:
        begun = F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("out"))
        return _let(F.aggregate(block, begun, step), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def places(pairs: Column) -> Column:
        # a step copies what there is so far: n matches in blocks of their root cost n steps of that root, not of n
        n = F.size(pairs)
        size = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(pairs, i * size + 1, size))
        many = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")), blocks, lambda acc: F.flatten(acc["out"]))
        return F.when(n > FEW, many).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))

    return _let(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), places)


def base_spans(text: Column) -> Column:
    """Valid spans of all kinds, by kind as listed, then start."""
    none = F.array().cast("array<struct<kind: string, start: int, end: int, value: string>>")
    parts = []
    for kind in KINDS:
        gate = text.rlike(PATTERNS[kind]) if _GATES[kind] is None else F.contains(text, F.lit(_GATES[kind])) & text.rlike(PATTERNS[kind])
        found = F.filter(find_spans(text, F.lit(PATTERNS[kind]), kind), _valid_of(kind))
        parts.append(F.when(gate, found).otherwise(none))
    return F.concat(*parts)


def _entity(span: Column) -> Column:
    """One id for an entity however it is written: its kind, and its letters or digits."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], value)


def _words(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _bare_terms(text: Column, spans: Column) -> Column:
    """Different terms of the text that stand outside its entities."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    bare = F.aggregate(order, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.char_length(text)))), " "))
    return _words(bare, TERM)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key(text: Column) -> Column:
    """What stands for a text in joins."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _sieve(wanted: DataFrame, name: str) -> Callable[[Column], Column]:
    """Whether a value may be one of column ``name`` of ``wanted``: each that is passes, and few others.

    Sixteen bits for each wanted value, up to ``MOST_BITS``; beyond that more others
    pass, so an exact join has to follow.  ``wanted`` is a written table.
    """
    size = min(MOST_BITS, max(64, 1 << (16 * wanted.count()).bit_length()))
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(size).cast("long"))
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(v), F.lit(64)).cast("int"))
    slot = lambda v: F.shiftright(place(v), 6)
    own = wanted.groupBy(slot(F.col(name)).alias("id")).agg(F.bit_or(bit(F.col(name))).alias("bits"))
    every = wanted.sparkSession.range(size // 64).join(own, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("b"))
    bits = stash(every.agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["bits"]).alias("bits"))).scalar()
    return lambda v: F.get(bits, slot(v).cast("int")).bitwiseAND(bit(v)) != 0


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """__key, text and number of __copies of each different text whose key is in ``keys`` (a written table).

    Other texts don't leave their partition, and of one text a row for each partition does.
    """
    keyed = docs.select(_key(_text()).alias("__key"), "text").filter(_sieve(keys, "__key")(F.col("__key")))
    once = keyed.groupBy("__key").agg(F.first("text").alias("text"), F.count("*").alias("__copies"))
    return once.join(keys.select("__key").distinct(), "__key", "left_semi")


def _salted_left_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` left join ``found`` (written, one row a text, with __copies) on __key; many copies are dealt round by their partition."""
    many = _sieve(found.filter(F.col("__copies") >= MANY), "__key")(F.col("__key"))
    salt = F.when(many, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    wide = found.drop("__copies").withColumn("__salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumn("__salt", salt).join(wide, ["__key", "__salt"], "left").drop("__salt")


def _with_spans(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__text": _text(), "__spans": base_spans(_text())})


def evidence(docs: DataFrame, *keep: str) -> DataFrame:
    """A written narrow table: columns ``keep``, __key (of the text), __places and the row's __entities."""
    found = _with_spans(docs.select("text", *keep))
    return stash(found.select(*keep, _key(F.col("__text")).alias("__key"), _places(F.col("__spans")).alias("__places"), F.array_distinct(F.transform("__spans", _entity)).alias("__entities")))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """__key, term, share: the terms of each text, with or without the entity, that disclose one.  ``found``: the evidence of ``docs``."""
    own = found.select("__key", F.explode("__entities").alias("entity")).groupBy("__key", "entity").agg(F.count("*").alias("n"))
    # copies of one text are one piece of evidence; entities of the same texts, told by two sums over their keys, are one class
    marks = [F.bit_xor(F.xxhash64("__key", "n")).alias("x"), F.sum(F.xxhash64(F.lit("s"), "__key").cast("decimal(38,0)")).alias("y")]
    each = own.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"), *marks).filter(F.col("texts") >= support)
    n_entity = stash(each.groupBy("x", "y", "n_entity", "texts").agg(F.min("entity").alias("entity")).select("entity", "n_entity"))
    held = stash(own.join(n_entity.select("entity"), "entity", "left_semi"))
    terms = stash(_with_spans(_texts_of(docs, held)).select("__key", F.explode(_bare_terms(F.col("__text"), F.col("__spans"))).alias("term")))
    both = held.join(terms, "__key").groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    # the key is a column before the words are rows: beside ``explode`` it would be hashed again for each word
    keyed = docs.select(_key(_text()).alias("__key"), _text().alias("__text"))
    words = keyed.select("__key", F.explode(_words(F.col("__text"), WORD)).alias("term"))
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = F.lit(float(max(1, docs.count())))
    share = F.log(total * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both"))) / F.log(total / F.col("n_entity"))
    strong = both.join(n_entity, "entity").join(n_term, "term").withColumn("share", share).filter(F.col("share") >= generalise)
    worst = stash(strong.groupBy("term").agg(F.max("share").alias("share")))
    return words.filter(_sieve(worst, "term")(F.col("term"))).join(worst, "term").select("__key", "term", "share").distinct()


def term_spans(docs: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """__key, __copies and __more of ``docs`` (different texts with spans): the places of their disclosing terms, by kind then start.

    A text's words are walked once for each kind and looked up in its own terms;
    only those that are terms get a place, and no word becomes a row.
    """
    of = lambda cond: F.collect_list(F.when(cond, F.col("term")))
    by_key = terms.groupBy("__key").agg(of(F.col("share") < remove).alias("__low"), of(F.col("share") >= remove).alias("__high"))
    parts = []
    for kind, name in zip(TERM_KINDS, ("__low", "__high"), strict=True):
        found = find_spans(F.col("__text"), F.lit(WORD), kind, _in(name))
        outside = F.filter(found, lambda s: ~F.exists("__spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        parts.append(F.when(F.size(name) > 0, _places(outside)).otherwise(F.array().cast("array<struct<kind: string, start: int, end: int>>")))
    return docs.join(by_key, "__key").select("__key", "__copies", F.concat(*parts).alias("__more"))


def _in(terms: str) -> Callable[[Column], Column]:
    return lambda value: F.array_contains(F.col(terms), F.lower(value))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _more(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """__key, __copies and __more for every different text that has disclosing terms.  ``terms`` is a written table."""
    return term_spans(_with_spans(_texts_of(docs, terms)), terms)


def privacy_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every row of ``docs`` (doc_id, text).

    A null text is empty and has no spans; a null doc_id stays null.  Repeated
    rows are reported each for itself, and copies of a text count once as
    evidence.  An empty table gives no rows; other columns are ignored.
    """
    own = docs.select("doc_id", "text")
    found = evidence(own, "doc_id")
    more = stash(_more(own, stash(disclosing_terms(own, found))))
    full = _salted_left_join(found.select("doc_id", "__key", F.col("__places").alias("spans")), more.withColumnRenamed("__more", "more"))
    base = F.col("spans")
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return full.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.when(F.col("more").isNotNull(), F.concat(base, "more")).otherwise(base)).alias("spans"))


def _mask(text: Column, spans: Column) -> Column:
    """The text with each span's label in its place; of spans that overlap the first stands for all."""
    label = F.create_map(*[x for k in (*KINDS, *TERM_KINDS) for x in (F.lit(k), F.lit("" if k == "removed" else "[WORD]" if k == "generalised" else f"[{k.upper()}]"))])
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label[s["kind"]]).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with protected entities replaced by their kind and disclosing terms generalised or removed.

    Every row stays; texts without either, and nulls, come back as they were.
    n_chars, where there is such a column, follows the text.
    """
    more = stash(_more(docs, stash(disclosing_terms(docs, evidence(docs)))))
    full = _salted_left_join(_with_spans(docs.withColumn("__key", _key(_text()))), more)
    spans = F.when(F.col("__more").isNotNull(), F.concat(_places(F.col("__spans")), "__more")).otherwise(_places(F.col("__spans")))
    out = full.withColumn("__all", spans)
    masked = F.when(F.size("__all") > 0, _mask(F.col("__text"), F.col("__all"))).otherwise(F.col("text"))
    out = out.withColumn("__new", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__all") > 0, F.char_length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__new")).select(docs.columns)
