"""Personal data: base patterns, and information-theoretic sanitisation of the words that give them away.

Emails, IP addresses, card and phone numbers are found by patterns. The values found are the protected entities. From
how documents pair words with entities, a word's disclosure is the share of the entity's information that it gives:
pointwise mutual information over the entity's own information. Words of the documents that hold an entity which exceed
a threshold are generalised, and those beyond a higher one removed, wherever any document has them. DataFrame operations
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The patterns match what the plain forms match, leftmost and without overlap, but in linear time: a match begins at the
# beginning of a run or where the last match ended, and what cannot be given back is taken for good.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Distinct texts that a word must share with an entity; shares of the entity's information above which the word is
#: generalised, and removed; letters and digits of the shortest word.
SUPPORT, GENERALISE, REMOVE, SHORTEST = 3, 0.9, 0.999, 3
#: Bytes of telling words, and of what texts have of them, up to which they are broadcast; more are shuffled.
BROADCAST_BYTES = 48 << 20
#: Telling words of a text up to which they are looked up in a list.
FEW = 1024
#: Matches that are put in order at a time. Lists that grow by one copy themselves, so long ones are built in parts.
CHUNK = 256


def _chunks(n: Column) -> Column:
    """The numbers of the runs of CHUNK that n things make."""
    return F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))


def _run(chunk: Column, n: Column) -> Column:
    """The things of a run, by number."""
    return F.sequence(chunk * CHUNK, F.least(n, (chunk + 1) * CHUNK) - 1)


def _running(values: Column, plus) -> Column:
    """For each value of a short list what ``plus`` makes of all before it, from 0; and of all at the end."""
    step = lambda acc, v: F.concat(acc, F.array(plus(F.element_at(acc, -1), v)))
    return F.aggregate(values, F.array(F.lit(0)), step)


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,value>> of a pattern's matches, in code points: from the lengths of what lies between.

    A text's time grows with its length, and with its matches times CHUNK.
    """
    empty = F.array().cast("array<struct<start:int,value:string>>")
    def laid(parts: Column) -> Column:
        n = F.size(parts["found"])
        ends = F.transform(_chunks(n), lambda c: F.aggregate(_run(c, n), F.lit(0), lambda t, i: t + F.length(F.get(parts["between"], i)) + F.length(F.get(parts["found"], i))))

        def step(acc, i):
            start = acc["at"] + F.length(F.get(parts["between"], i))
            value = F.get(parts["found"], i)
            return F.struct(
                (start + F.length(value)).alias("at"),
                F.concat(acc["out"], F.array(F.struct(start.alias("start"), value.alias("value")))).alias("out"),
            )

        begin = lambda at: F.struct(at.alias("at"), empty.alias("out"))
        one = F.aggregate(F.sequence(F.lit(0), n - 1), begin(F.lit(0)), step, lambda acc: acc["out"])
        part = lambda c, bases: F.aggregate(_run(c, n), begin(F.get(bases, c)), step, lambda acc: acc["out"])
        many = _given(_running(ends, lambda a, b: a + b), lambda bases: F.flatten(F.transform(_chunks(n), lambda c: part(c, bases))))
        return F.when(n <= CHUNK, one).otherwise(many)

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("found"))
    return _given(parts, lambda p: F.when(F.size(p["found"]) > 0, laid(p)).otherwise(empty))


def _given(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: inside a lambda, an expression is computed for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,kind:int,end:int,value:string>"


def base_spans(text: Column) -> Column:
    """All base matches of a text, by start and kind: array<struct<start,kind,end,value>>; kinds count from 0."""
    return F.array_sort(F.concat(*(_of_kind(text, number, kind) for number, kind in enumerate(KINDS))))


def _of_kind(text: Column, number: int, kind: str) -> Column:
    may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    kept = F.filter(located(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    made = F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")
        ),
    )
    return F.when(may & text.rlike(PATTERNS[kind]), made).otherwise(F.array().cast(f"array<{SPAN}>"))


def _replaced(text: Column, spans: Column, label) -> Column:
    """The text with ``label(span)`` in the place of each span, spans in order of their starts.

    Of spans that overlap the first is replaced, and what others have beyond it goes with it. Long lists go in runs, each
    over its own part of the text, which begins where the run before ended.
    """

    def over(part: Column, first: Column, run: Column) -> Column:
        def step(acc, s):
            fresh = s["start"] >= acc["at"]
            gap = F.when(fresh, F.substr(part, acc["at"] - first + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, label(s)).otherwise(F.lit(""))).alias("out"))

        return F.aggregate(run, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    n = F.size(spans)
    of = lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))
    ends = F.transform(_chunks(n), lambda c: F.aggregate(of(c), F.lit(0), lambda m, s: F.greatest(m, s["end"])))

    def all_(at: Column) -> Column:
        piece = lambda c: F.substr(text, F.get(at, c) + 1, F.get(at, c + 1) - F.get(at, c))
        runs = F.transform(_chunks(n), lambda c: _given(piece(c), lambda part: over(part, F.get(at, c), of(c))))
        return F.concat(F.array_join(runs, ""), F.substr(text, F.element_at(at, -1) + 1, F.length(text)))

    return F.when(n > 0, _given(_running(ends, F.greatest), all_)).otherwise(text)


def _split(text: Column) -> Column:
    """The distinct words of a text, in lower case, short ones too."""
    return F.array_distinct(F.split(_lowered(text), r"[^\p{L}\p{N}]+"))


def _words(text: Column) -> Column:
    """Those of SHORTEST letters and digits or more."""
    return F.filter(_split(text), lambda w: F.length(w) >= SHORTEST)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of every row: base spans, and spans of kind 4 with ``remove`` for words that disclose.

    ``key`` is the text's md5. Every document counts; a word must be in SUPPORT different texts with an entity. A null
    text is empty; null and repeated ids keep their rows; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    found = rows.withColumn("spans", base_spans(F.col("text")))
    # matches are found once; what follows reads spans and, of texts that have any, the words outside them
    outside = _words(_replaced(F.col("text"), F.col("spans"), lambda s: F.lit(" ")))
    base = materialise(found.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, outside).alias("words")), "spans")
    telling = _disclosing(rows, base)
    columns = ["doc_id", "key", F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(False).alias("remove"))).alias("spans")]
    if telling is None:
        return base.select(*columns)
    more = (
        _free(_occurrences(rows, telling), base)
        .groupBy("key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "remove")).alias("more"))
    )
    joined = base.select(*columns).join(more, "key", "left")
    return joined.select("doc_id", "key", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more"))).alias("spans"))


def _free(places: DataFrame, base: DataFrame) -> DataFrame:
    """Those of the places (key, start, end, remove) that no base span of their text overlaps."""
    texts = base.join(places.select("key").distinct(), "key", "left_semi").where(F.size("spans") > 0).dropDuplicates(["key"])
    held = texts.select("key", F.inline("spans")).select("key", "start", "end", F.lit(None).cast("boolean").alias("remove"), F.lit(0).alias("term"))
    both = places.withColumn("term", F.lit(1)).unionByName(held)
    upto = lambda *order: W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(F.when(F.col("term") == 0, F.col("end"))).over(upto("start", "term"))
    # a frame that runs to the end would be summed anew for each row; the same from the other side is not
    after = F.min(F.when(F.col("term") == 0, F.col("start"))).over(upto(F.desc("start"), F.desc("term")))
    placed = both.withColumns({"before": before, "after": after}).where("term = 1")
    return placed.where("coalesce(before <= start, true) and coalesce(after >= end, true)").select("key", "start", "end", "remove")


def _lowered(text: Column) -> Column:
    """In lower case, with as many code points: the one letter that would become two is made an I before."""
    return F.lower(F.translate(text, "\u0130", "I"))


def _occurrences(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """(key, start, end, remove) of every place in any text where a word of ``telling`` (term, remove) stands.

    Texts' distinct words are joined with the telling ones, and only in texts that have some, and only of those words, are
    places looked for. (Of a text with more than FEW of them all words are placed, and then joined.) Either side is
    broadcast up to BROADCAST_BYTES, and joined by shuffle beyond.
    """

    def sent(d: DataFrame, bytes_: Column) -> DataFrame:
        size = d.agg(F.coalesce(F.sum(bytes_ + 64), F.lit(0))).first()[0]
        return F.broadcast(d) if size <= BROADCAST_BYTES else d

    telling = sent(telling, F.octet_length("term"))
    words = rows.select("key", F.explode(_split(F.col("text"))).alias("term"))
    having = materialise(words.join(telling.select("term"), "term").groupBy("key").agg(F.collect_set("term").alias("terms")), "having")
    texts = rows.join(sent(having, F.octet_length(F.array_join("terms", "")) + 32 * F.size("terms")), "key")
    at = located(_lowered(F.col("text")), r"[\p{L}\p{N}]+")
    few = F.filter(at, lambda m: (F.size("terms") > FEW) | F.array_contains("terms", m["value"]))
    places = texts.select("key", F.inline(few)).distinct().join(telling, F.col("value") == F.col("term"))
    return places.select("key", "start", (F.col("start") + F.length("term")).alias("end"), "remove")


def _disclosing(rows: DataFrame, base: DataFrame) -> DataFrame | None:
    """(term, remove) of words whose disclosure of some entity exceeds GENERALISE, from counts of documents; or None.

    A word t with disclosure d of an entity e is in at most |e| * (all / |e|) ** (1 - d) documents, which leaves out most
    words before any pair is made. Entities that the same texts hold are one, and so are words that the same texts hold,
    so a group of long altered copies pairs its sets of texts, not all its entities with all its words.
    """
    total = base.count()
    texts = base.where(F.size("spans") > 0).groupBy("key").agg(F.count("*").alias("m"), F.first("words").alias("words"), F.first("spans").alias("spans"))
    texts = materialise(texts, "texts")
    marks = (F.count("*").alias("texts"), F.sum("m").alias("rows"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    set_ = F.xxhash64("texts", "rows", "x", "y").alias("set")
    entity = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    held = texts.select("key", "m", F.explode(entity).alias("entity"))
    most = F.col("rows") * F.pow(F.lit(float(total)) / F.col("rows"), F.lit(1 - GENERALISE))
    entities = held.groupBy("entity").agg(*marks).where((F.col("texts") >= SUPPORT) & (F.col("rows") < total)).select("entity", F.col("rows").alias("with_entity"), most.alias("most"), set_)
    entities = materialise(entities, "entities")
    limit = entities.agg(F.max("most")).first()[0]
    if limit is None:
        return None
    of_entity = held.join(entities, "entity").select("set", "key", "m", "with_entity", "most").distinct()
    words = rows.select(F.explode(_split(F.col("text"))).alias("term"))
    having = words.groupBy("term").agg(F.count("*").alias("with_term")).where(F.col("with_term").between(SUPPORT, F.lit(limit + 1e-6)))
    near = texts.join(of_entity.select("key").distinct(), "key", "left_semi").select("key", "m", F.explode("words").alias("term"))
    named = materialise(near.join(having, "term"), "words")
    sets = materialise(named.groupBy("term", "with_term").agg(*marks).where(F.col("texts") >= SUPPORT).select("term", "with_term", F.xxhash64("with_term", set_).alias("words")), "sets")
    of_words = named.join(sets.select("term", "words"), "term").select("words", "key", "m", "with_term").distinct()
    pairs = of_entity.join(of_words.drop("m"), "key").where(F.col("with_term") <= F.col("most") + 1e-6)
    both = pairs.groupBy("set", "words", "with_entity", "with_term").agg(F.sum("m").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    own = -F.log2(F.col("with_entity") / total)
    gives = F.log2(F.col("both") / F.col("with_term")) + own
    told = both.select("words", (gives / own).alias("disclosure")).where(F.col("disclosure") >= GENERALISE).groupBy("words").agg(F.max("disclosure").alias("disclosure"))
    return materialise(told.join(sets, "words").select("term", (F.col("disclosure") >= REMOVE).alias("remove")), "telling")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of the base spans, and all spans as text."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    said = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(n(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)),
        F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced: base kinds and generalised words by a name, removed words by nothing.

    Where spans overlap, the first is replaced and what others have beyond it goes with it. n_chars, where there is
    one, becomes the new length; a text without spans, and a null one, stays as it is. Null and repeated ids and rows
    are kept; columns may have any name; an empty table stays empty.
    """
    found = find(docs).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(found, "key", "left")
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)))
    clean = _replaced(F.col("row.text"), F.col("spans"), lambda s: F.when(s["remove"], F.lit("")).otherwise(F.get(labels, s["kind"])))
    text = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("row.text"))
    out = rows.withColumn("text", text)
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(fields[c].alias(c) for c in docs.columns))
