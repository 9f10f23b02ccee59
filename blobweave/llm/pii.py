"""Personal data: base patterns, and contexts learned from them that lead to further identifiers.

Everything is DataFrame functions. Base spans are the leftmost non-overlapping matches of each
kind; matches that fail a kind's test are dropped. Start positions are running sums of the gaps and
matches before.

Method: bootstrapped contextual extraction. The base spans are seed entities. The words with letters
around them, whatever identifiers stand between, are lexical patterns: the two before, and the one on either side.
Patterns and instances form a bipartite graph, kind by kind. A pattern's score is the mean confidence of
its instances, damped by ``DAMPING`` unknown ones; patterns of at least ``STRONG`` with ``SUPPORT`` different known
instances propose others, whose confidence is the noisy-or of their patterns' scores. Instances of at least
``ACCEPT`` become known and induce patterns in the next round, until a round finds none. A known instance is a span wherever
it stands. Only words shaped like the kind can be instances: see ``_shaped``; they may have any length.

Defined cases: a null text counts as empty; repeated rows get repeated results; rows that share
doc_id and text share spans; found spans never overlap base spans; a null doc_id is a value like
others; ``digest`` leaves other columns out, ``masked`` gives them back, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_split

KINDS = ("email", "ip", "card", "phone")
DAMPING, STRONG, ACCEPT, SUPPORT = 2.0, 0.6, 0.75, 3
WORD = r"[^\x20\x09-\x0D]"
#: The contract's patterns with equal matches: starts are bound to where a run begins (or the match before
#: ended) and quantifiers don't give back, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # words that hold a digit or an at sign
    "word": rf"(?<!{WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": "."}


def _lettered(text: Column) -> Column:
    """The words of a text by their letters, those that have any."""
    return F.filter(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", "")), lambda w: w != "")


def _edges(gap: Column) -> tuple[Column, Column, Column]:
    """The last two words with letters of the text before a match, and the first one. Mostly a short end tells; else all is read."""
    n = F.length(gap)
    end, begin = F.right(gap, F.lit(60)), F.substring(gap, 1, 40)
    whole = r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]"  # what may be a part of a word goes
    last = F.when(n <= 60, _lettered(gap)).otherwise(_lettered(F.regexp_replace(end, whole, "")))
    last = F.when((n > 60) & (F.size(last) < 2), _lettered(gap)).otherwise(last)
    first = F.when(n <= 40, _lettered(gap)).otherwise(_lettered(F.regexp_replace(begin, r"[^\x20\x09-\x0D]*$", "")))
    first = F.when((n > 40) & (F.size(first) < 1), _lettered(gap)).otherwise(first)
    return F.try_element_at(last, F.lit(-1)).alias("b1"), F.try_element_at(last, F.lit(-2)).alias("b2"), F.try_element_at(first, F.lit(1)).alias("a1")


def _items(text: Column) -> list[tuple[str, Column, Column]]:
    """For each pattern its name, all matches, and of the gaps around them the length, the end and the start."""
    parts = []
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        gaps = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), *(_edges(g) if kind == "word" else ())))
        try_it = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]") if kind == "card" else text.rlike("[0-9@]")
        parts.append((kind, F.when(try_it, found), F.when(try_it, gaps)))
    return parts


def items(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, kind, i, match, start, end, b1, b2, a1); h names the text. For the kind word b1 and b2 are the last words with
    letters before it in its text, and a1 the first after it."""
    parts = _items(F.col("text"))
    base = docs.where("text rlike '[0-9@]'").select("doc_id", "text", F.xxhash64("text").alias("h"))
    base = base.select("doc_id", "h", *[f.alias(f"m_{k}") for k, f, _ in parts], *[g.alias(f"g_{k}") for k, _, g in parts])
    none = F.lit(None).cast("string")

    def numbered(kind: str) -> Column:
        found, gaps = F.col(f"m_{kind}"), f"g_{kind}"
        zipped = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"))
        word = kind == "word"
        each = F.transform(
            zipped,
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), z["m"].alias("match"), z["g"]["n"].alias("gap"),
                (z["g"]["b1"] if word else none).alias("b1"), (z["g"]["b2"] if word else none).alias("b2"), (z["next"]["a1"] if word else none).alias("a1"),
            ),
        )
        return F.coalesce(each, F.array().cast("array<struct<kind:string,i:int,match:string,gap:int,b1:string,b2:string,a1:string>>"))

    rows = [numbered(k) for k, _, _ in parts]
    flat = base.select("doc_id", "h", F.explode(F.flatten(F.array(*rows))).alias("x")).select("doc_id", "h", "x.*").dropDuplicates(["doc_id", "h", "kind", "i"])
    by = Window.partitionBy("doc_id", "h", "kind")
    along = by.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    back = by.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.length("match")).over(along)
    flat = flat.withColumn("end", end).withColumn("before", F.last("b1", True).over(earlier))
    two = F.when(F.col("b1").isNotNull(), F.struct("b1", F.coalesce("b2", "before").alias("b2")))
    flat = flat.withColumn("two", F.last(two, True).over(along)).withColumn("a1", F.last("a1", True).over(back))
    return flat.select("doc_id", "h", "kind", "i", "match", (F.col("end") - F.length("match")).alias("start"), "end", F.col("two.b1").alias("b1"), F.col("two.b2").alias("b2"), "a1")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _sound(kind: Column, match: Column) -> Column:
    """Whether a base match passes its kind's test."""
    part = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = _digits(match)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def _shaped(word: Column) -> Column:
    """The kind that a word could be though no base pattern took it."""
    digits = F.length(_digits(word))
    return (
        F.when(word.rlike("^[^@]+@[^@]+$"), "email")
        .when(word.rlike(r"^[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}$"), "ip")
        .when(word.rlike(r"^[0-9]+(?:-[0-9]+)*$") & digits.between(12, 19), "card")
        .when(word.rlike(r"^[+(]?[0-9][0-9().-]*[0-9]$") & digits.between(7, 15), "phone")
    )


def _contexts(df: DataFrame) -> DataFrame:
    """Two rows for each occurrence, less where words are missing: its contexts as text."""
    two = F.concat(F.lit("b "), F.coalesce("b2", F.lit("")), F.lit(" "), F.col("b1"))
    around = F.concat(F.lit("a "), F.col("b1"), F.lit(" _ "), F.col("a1"))
    return df.withColumn("context", F.explode(F.array(two, around))).where("context is not null")


def learn(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Known instances (kind, instance, confidence): the seeds (kind, instance), and what patterns lead to from them on.

    edges: kind, context, instance, distinct.
    """
    by_context = scratch.save(edges.groupBy("kind", "context").agg(F.count("*").alias("n")))
    by_instance = scratch.save(edges.groupBy("kind", "instance").agg(F.count("*").alias("n")))
    known = seeds.withColumn("confidence", F.lit(1.0))
    while True:
        sure = join_split(edges, known, ["kind", "instance"], by_instance).groupBy("kind", "context").agg(F.sum("confidence").alias("sum"), F.count("*").alias("support"))
        scored = sure.where(F.col("support") >= SUPPORT).join(by_context, ["kind", "context"]).withColumn("score", F.col("sum") / (F.col("n") + DAMPING))
        patterns = scratch.save(scored.where(F.col("score") >= STRONG).select("kind", "context", "score"))
        fresh = join_split(edges, patterns, ["kind", "context"], by_context).join(known, ["kind", "instance"], "left_anti")
        confidence = 1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))
        more = scratch.save(fresh.groupBy("kind", "instance").agg(confidence.alias("confidence")).where(F.col("confidence") >= ACCEPT))
        if not more.limit(1).count():
            return known
        known = scratch.save(known.union(more))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, kind, start, end, seed) of docs (doc_id, text): base spans and those that contexts led to."""
    scratch = Scratch(docs.sparkSession, "pii")
    got = scratch.save(items(docs.select("doc_id", "text")))
    base = got.where("kind <> 'word'").where(_sound(F.col("kind"), F.col("match")))
    spans = base.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("seed"))
    # in order of their starts each base span meets the word that it begins in, and each word the furthest end of a base span before
    words = got.where("kind = 'word'").withColumn("no", F.col("i"))
    both = words.withColumn("order", F.lit(0)).unionByName(base.withColumn("no", F.lit(None).cast("int")).withColumn("order", F.lit(1)))
    along = Window.partitionBy("doc_id", "h").orderBy("start", "order", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = F.when(F.col("order") == 0, F.struct("no", "b1", "b2", "a1"))
    met = scratch.save(both.withColumn("word", F.last(word, True).over(along)).withColumn("covered", F.max(F.when(F.col("order") == 1, F.col("end"))).over(along)))
    seeds = met.where("order = 1").select("doc_id", "h", "kind", F.col("match").alias("instance"), "word.*")
    lead = F.length(F.regexp_extract("match", r"^[^0-9A-Za-z+(@]*", 0))
    stripped = F.regexp_extract("match", r"^[^0-9A-Za-z+(@]*+(.*?)[^0-9A-Za-z]*$", 1)
    free = met.where("order = 0 and (covered is null or covered <= start)").withColumn("instance", stripped).withColumn("start", F.col("start") + lead).withColumn("kind", _shaped(F.col("instance"))).where("kind is not null")
    held = seeds.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.col("no").alias("_no")).distinct()
    fresh = scratch.save(free.join(held, free.doc_id.eqNullSafe(held["_doc"]) & (free.h == held["_h"]) & (free.no == held["_no"]), "left_anti").select("doc_id", "h", "kind", "instance", "start", "b1", "b2", "a1"))
    if not fresh.limit(1).count():
        return spans
    edges = scratch.save(_contexts(seeds).select("kind", "context", "instance").union(_contexts(fresh).select("kind", "context", "instance")).distinct())
    known = learn(edges, scratch.save(seeds.select("kind", "instance").distinct()), scratch)
    found = join_split(fresh, known.select("kind", "instance"), ["kind", "instance"])
    return spans.union(found.select("doc_id", "h", "kind", "start", (F.col("start") + F.length("instance")).alias("end"), F.lit(False)).distinct())


def _ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["no"]), s["start"], s["end"])), ",")


def by_document(docs: DataFrame) -> DataFrame:
    """Each row of docs (_doc, _text and others) with _base and _all: ordered arrays of (start, no, end); no is the kind's number."""
    spans = find(docs.select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"))).withColumn("no", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    one = F.struct("start", "no", "end")
    grouped = spans.groupBy(F.col("doc_id").alias("_of"), F.col("h").alias("_h")).agg(_ordered(F.collect_list(F.when(F.col("seed"), one))).alias("_base"), _ordered(F.collect_list(one)).alias("_all"))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    out = docs.join(grouped, docs["_doc"].eqNullSafe(grouped["_of"]) & (F.xxhash64(docs["_text"]) == grouped["_h"]), "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("_base", "_all")}).drop("_of", "_h")


def digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = by_document(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")))
    count = lambda k: F.size(F.filter("_base", lambda s: s["no"] == k)).cast("long")
    return found.select(F.col("_doc").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)], F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(F.col("_all")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span, overlapping ones together, replaced by its kind in angle brackets."""
    names = [{"doc_id": "_doc", "text": "_text"}.get(c, f"_c{i}") for i, c in enumerate(docs.columns)]
    found = by_document(docs.toDF(*names))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,no:int,end:bigint,before:bigint>>").alias("kept"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["kept"]).otherwise(F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), a["at"].alias("before"))))).alias("kept"))
    folded = F.aggregate("_all", start, step)
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    pieces = F.transform(F.col("_folded.kept"), lambda s: F.concat(F.substr(F.col("_text"), (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.element_at(kinds, s["no"])))
    text = F.when(F.size("_all") > 0, F.concat(F.array_join(pieces, ""), F.substr(F.col("_text"), (F.col("_folded.at") + 1).cast("int"))))
    return found.withColumn("_folded", folded).withColumn("_text", F.coalesce(text, F.col("_text"))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
