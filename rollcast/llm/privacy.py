"""Information-theoretic sanitisation of personal data. DataFrame operations only.

Emails, IP addresses, card and phone numbers are found by pattern and checked (parts,
check digits, number of digits).  They are the protected entities.  Terms beside a mention
can still give an entity away, so the corpus is asked how strongly: over all documents,

    disclosure(e, t) = PMI(e; t) / IC(e) = ln(N n(e,t) / (n(e) n(t))) / ln(N / n(e)),

with the number of documents that hold the entity, the term, or both.  It is 1 if the term occurs with the entity alone.  Terms with a disclosure of
``remove`` or more are removed, with ``generalise`` or more replaced by their class, both
wherever they occur in documents that hold that entity; a pair needs ``support`` documents
to count as evidence (in one document alone, every word of its own would disclose).
A term has three letters or digits or more, or is two letters of a script without spaces.

Spans are code points, end exclusive.  Patterns are the equivalent forms without
backtracking, so long runs of digits or letters stay linear.

Defined results: a null text is empty and has no spans; spans of different kinds may
overlap, and all of them are kept, while terms that overlap one are not reported;
repeated rows get the same result and count as documents of their own; documents with one
id are told apart by their text; an empty table gives an empty result; other columns
pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcast.llm.common import ROW, column, let, row_key
from rollcast.sources.scratch import store

KINDS = ("email", "ip", "card", "phone")

# A match may start inside a run of its characters only where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2}"

SUPPORT = 3
GENERALISE, REMOVE = 0.75, 0.9

CHUNK = 256


def _running(steps: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sum or maximum of an array column of longs, in chunks: long arrays stay cheap."""
    return let(steps, lambda bound: _running_of(bound, merge))


def _running_of(steps: Column, merge: Callable[[Column, Column], Column]) -> Column:
    zero = F.lit(0).cast("long")
    fold = lambda part: F.aggregate(part, zero, merge)
    n = F.size(steps)
    firsts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(firsts, lambda c: fold(F.slice(steps, c * CHUNK + 1, CHUNK)))
    heads = lambda sums: F.transform(sums, lambda _, i: fold(F.slice(sums, 1, i)))

    def total(head: Column) -> Column:
        return F.transform(steps, lambda _, i: merge(
            F.get(head, F.floor(i / CHUNK).cast("int")), fold(F.slice(steps, i - i % CHUNK + 1, i % CHUNK + 1))
        ))

    return let(chunks, lambda sums: let(heads(sums), total))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        small = lambda p: (F.length(number(p)) <= 3) & (number(p).try_cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _entity(kind: str, value: Column) -> Column:
    """What makes two mentions the same entity."""
    same = F.regexp_replace(value, "[^0-9]", "") if kind in ("card", "phone") else F.lower(value)
    return F.concat(F.lit(f"{kind}:"), same)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def find_mentions(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base`` (spans by kind, then start) and ``mentions`` (their entities).

    Steps are separate projections, and arrays used inside lambdas are bound first, so
    that the optimizer does not run a pattern again for every match.
    """
    body = column(text)
    hint = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    none = F.array().cast("array<string>")
    found = docs.withColumns({
        f"__{part}_{kind}": F.when(hint.get(kind, F.lit(True)), value).otherwise(none)
        for kind in KINDS
        for part, value in (
            ("found", F.regexp_extract_all(body, F.lit(PATTERNS[kind]), 0)), ("gaps", F.split(body, PATTERNS[kind], -1))
        )
    })
    col = lambda part, kind: F.col(f"__{part}_{kind}")

    def steps(kind: str) -> Column:
        return let(col("gaps", kind), lambda gaps: F.transform(
            col("found", kind), lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long")
        ))

    stepped = found.withColumns({f"__steps_{k}": steps(k) for k in KINDS})
    ended = stepped.withColumns({f"__ends_{k}": _running(col("steps", k), lambda a, b: a + b) for k in KINDS})

    def placed(kind: str) -> Column:
        def one(value: Column, i: Column, end: Column) -> Column:
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"),
                value.alias("value"), i.alias("nth"),
            )

        every = let(col("ends", kind), lambda ends: F.transform(
            col("found", kind), lambda value, i: one(value, i, F.get(ends, i))
        ))
        return F.filter(every, lambda m: _valid(kind, m["value"]))

    spanned = ended.withColumns({f"__spans_{k}": placed(k) for k in KINDS})

    def mentions(kind: str) -> Column:
        return F.transform(col("spans", kind), lambda m: F.struct(_entity(kind, m["value"]).alias("entity")))

    slim = lambda spans: F.transform(spans, lambda m: F.struct(m["kind"], m["start"], m["end"]))
    return spanned.select(
        *[column(c) for c in docs.columns],
        F.concat(*[slim(col("spans", k)) for k in KINDS]).alias("base"),
        F.concat(*[mentions(k) for k in KINDS]).alias("mentions"),
    )


def _entities() -> Column:
    return F.array_distinct(F.transform("mentions", lambda m: m["entity"]))


class Evidence(NamedTuple):
    """What the corpus says about entities and terms, by classes with the same documents."""

    held: DataFrame  # row, id, h: the documents with mentions
    entities: DataFrame  # entity, e
    terms: DataFrame  # term, t
    pairs: DataFrame  # e, t, disclosure
    together: DataFrame  # row, e, t: the pairs of each document that can reach the threshold


def _members(frame: DataFrame, name: str) -> DataFrame:
    """Number of rows of every value, and two 64-bit hashes of the set of these rows."""
    return frame.groupBy(name).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")
    )


def _evidence(mentions: DataFrame, docs: DataFrame, text: str, support: int, at_least: float | None) -> Evidence:
    """A disclosure depends on sets of documents only, so entities (or terms) with the same set are one class.

    A list of addresses that occurs as a whole in some documents is one class, whatever its
    length.  A pair has no more documents than its entity, so ``disclosure >= d`` needs
    ``n(t) <= N^(1-d) n(e)^d``; other pairs are left out before they are counted.
    """
    held = store(mentions.select(
        F.monotonically_increasing_id().alias("row"), *[c for c in ("id", "h") if c in mentions.columns],
        _entities().alias("entities"), _terms(column(text)).alias("terms"),
    ))
    n_docs = docs.count()
    entities = held.select("row", F.explode("entities").alias("entity"))
    # A pair cannot have more documents than its entity or its term.
    of_entity = store(_members(entities, "entity").where(F.col("n") >= support).select("entity", F.struct("n", "a", "b").alias("e")))
    terms = held.select("row", F.explode("terms").alias("term"))
    everywhere = (
        docs.select(F.explode(_terms(F.coalesce(column(text), F.lit("")))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= support)
    )

    def possible(n_entity: Column) -> Column:
        if at_least is None:
            return F.lit(True)
        most = F.pow(F.lit(float(n_docs)), F.lit(1 - at_least)) * F.pow(n_entity.cast("double"), F.lit(at_least))
        return F.col("t.n_term") <= most * (1 + 1e-9)

    of_term = store(
        _members(terms, "term").where(F.col("n") >= support).join(everywhere, "term")
        .select("term", F.struct("n_term", "n", "a", "b").alias("t"))
    )
    row_entities = store(entities.join(of_entity, "entity").select("row", "e").distinct())
    largest = row_entities.groupBy("row").agg(F.max("e.n").alias("largest"))
    row_terms = store(
        terms.join(of_term, "term").join(largest, "row").where(possible(F.col("largest"))).select("row", "t").distinct()
    )
    together = row_entities.join(row_terms, "row").where(possible(F.col("e.n")))
    rate = F.log(F.lit(n_docs) * F.col("n_pair") / F.col("e.n") / F.col("t.n_term"))
    information = F.log(F.lit(n_docs) / F.col("e.n"))
    pairs = (
        together.groupBy("e", "t").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= support)
        .select("e", "t", F.when(information > 0, rate / information).otherwise(0.0).alias("disclosure"))
    )
    if at_least is not None:
        pairs = pairs.where(F.col("disclosure") >= at_least)
    return Evidence(held, of_entity, of_term, store(pairs), together)


def disclosures(
    mentions: DataFrame, docs: DataFrame, text: str, *, support: int = SUPPORT, at_least: float | None = None
) -> DataFrame:
    """``entity, term, disclosure`` of all pairs with enough documents, or of those that reach ``at_least``.

    ``mentions`` has a row per document with any; ``docs`` has all documents.
    """
    found = _evidence(mentions, docs, text, support, at_least)
    return found.pairs.join(found.entities, "e").join(found.terms, "t").select("entity", "term", "disclosure")


def _strong_terms(found: Evidence) -> DataFrame:
    """``id, h, strong``: the terms to treat in every document, with their highest disclosure."""
    return (
        found.together.join(found.pairs, ["e", "t"]).groupBy("row", "t").agg(F.max("disclosure").alias("d"))
        # Every term of a class is in every document of the class.
        .join(found.terms, "t").join(found.held.select("row", "id", "h"), "row")
        .groupBy("id", "h", "term").agg(F.max("d").alias("d"))
        .groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("strong"))
    )


def sanitise(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``spans`` (base spans, then terms) and ``clean_text``.

    A span is ``kind, start, end, action``; ``kind`` counts through KINDS, and 4 is a term.
    Base spans become their kind in brackets.  Generalised terms become a class: years their
    decade (``[1980s]``), other numbers the range with their first digit (``[40000-49999]``),
    words ``[NAME]``, ``[ACRONYM]``, ``[CODE]`` (with digits) or ``[WORD]``.  Removed terms go.
    """
    names = ("spans", "clean_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    key = row_key(id_column, text_column)
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW), key["id"].cast("string").alias("id"), key["h"].alias("h"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"),
    )
    found = find_mentions(rows, "text")
    mentions = store(found.where(F.size("mentions") > 0).select("id", "h", "text", "mentions"))
    listed = _strong_terms(_evidence(mentions, rows, "text", support, generalise))
    # Only documents with terms to treat are joined; finding the patterns again spares a shuffle of all texts.
    named = store(listed.select(F.col("id").alias("__i"), F.col("h").alias("__h"), F.col("strong").alias("__strong")))
    same = F.col("id").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h"))
    met = found.drop("mentions").join(named, same, "left")
    met = _placed_terms(met, remove)
    base = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"], F.lit("mask").alias("action")))
    apart = lambda t, spans: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    own = let(F.col("base"), lambda spans: F.filter("terms", lambda t: apart(t, spans)))
    spanned = met.withColumn("spans", F.concat(base, own))
    return _masked(spanned).select(*[F.col(ROW).getField(c).alias(c) for c in kept], "spans", "clean_text")


def _placed_terms(met: DataFrame, remove: float) -> DataFrame:
    """Add ``terms``: spans of all occurrences of the terms that ``__strong`` has for the row."""
    none = F.array().cast("array<string>")
    some = F.isnotnull("__strong")
    split = met.withColumns({
        "__words": F.when(some, F.regexp_extract_all("text", F.lit(TERM), 0)).otherwise(none),
        "__between": F.when(some, F.split("text", TERM, -1)).otherwise(none),
    })
    steps = let(F.col("__between"), lambda gaps: F.transform(
        "__words", lambda w, i: (F.length(w) + F.length(F.get(gaps, i))).cast("long")
    ))
    ended = split.withColumn("__steps", steps).withColumn("__word_ends", _running(F.col("__steps"), lambda a, b: a + b))

    def one(word: Column, end: Column, strong: Column) -> Column:
        d = F.element_at(strong, F.lower(word))
        return F.when(F.isnotnull(d), F.struct(
            F.lit(len(KINDS)).alias("kind"), (end - F.length(word)).alias("start"), end.alias("end"),
            F.when(d >= remove, "remove").otherwise("generalise").alias("action"),
        ))

    terms = let(F.col("__word_ends"), lambda ends: let(F.col("__strong"), lambda strong: F.transform(
        "__words", lambda word, i: one(word, F.get(ends, i), strong)
    )))
    return ended.withColumn("__all", terms).withColumn("terms", F.filter("__all", F.isnotnull))


def _general(word: Column) -> Column:
    """The class of a term: the decade of a year, the range of a number, or what kind of word it is."""
    like = lambda pattern: F.regexp_like(word, F.lit(pattern))
    first, rest = F.substring(word, 1, 1), F.length(word) - 1
    span = F.concat(F.lit("["), first, F.repeat(F.lit("0"), rest), F.lit("-"), first, F.repeat(F.lit("9"), rest), F.lit("]"))
    return (
        F.when(like("^(1[0-9]|20)[0-9][0-9]$"), F.concat(F.lit("["), F.substring(word, 1, 3), F.lit("0s]")))
        .when(like("^[0-9]+$"), span)
        .when(like(r"\p{N}"), "[CODE]").when(like(r"^\p{Lu}+$"), "[ACRONYM]").when(like(r"^\p{Lu}"), "[NAME]")
        .otherwise("[WORD]")
    )


def _masked(spanned: DataFrame) -> DataFrame:
    """Add ``clean_text``: what lies outside the spans, with a mask at the start of each."""
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"], s["action"])))
    frame = spanned.withColumn("__order", ordered)
    frame = frame.withColumn("__reach", _running(F.transform("__order", lambda s: s["end"].cast("long")), lambda a, b: F.greatest(a, b)))
    text, last = F.col("text"), F.array_max("__reach")

    def mask(s: Column) -> Column:
        word = text.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        general = _general(word)
        kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        return F.when(s["action"] == "mask", F.get(kinds, s["kind"])).when(s["action"] == "generalise", general).otherwise("")

    def piece(s: Column, i: Column, reach: Column) -> Column:
        begin = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
        outside = text.substr((begin + 1).cast("int"), F.greatest(s["start"] - begin, F.lit(0)).cast("int"))
        # A span inside an earlier one needs no mask of its own.
        return F.concat(outside, F.when(s["end"] > begin, mask(s)).otherwise(""))

    pieces = let(F.col("__reach"), lambda reach: F.transform("__order", lambda s, i: piece(s, i, reach)))
    masked = F.concat(F.array_join(pieces, ""), text.substr((last + 1).cast("int"), F.length(text)))
    return frame.withColumn("clean_text", F.when(F.size("spans") > 0, masked).otherwise(text))
