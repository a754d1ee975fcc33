"""Personal data by patterns, and information-theoretic sanitisation of the terms that go with it.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. A protected entity is the value of a base span.
Terms are all words outside the base spans, wherever they are in a document. Over the corpus, a term t discloses an entity e as
far as the pointwise mutual information of being in one document, log(P(e | t) / P(e)), comes near all there is to know,
-log(P(e)), where P(e) = c(e) / N, c counts whole documents and N is their number. P(e | t) is smoothed towards P(e) by PRIOR
documents, (c(e, t) + PRIOR P(e)) / (c(t) + PRIOR), so that an entity in a single document is scored too, and a term met once
weighs less than one that is always met. From GENERALISE of it on a term is generalised, from REMOVE on it is removed, both
only in the documents of that entity. Documents without a base span are left as they are.

Entities in the same documents have equal scores with every term, as have terms that are in equally many documents and in the
same ones with base spans; pairs are counted for such classes, so a list of names and addresses is one pair, not their product.

All of it is SQL expressions. Starts are counted in code points: a text is split by the same pattern that gives the matches,
and the lengths of gaps and matches are summed up in blocks of about the square root of their number.

A null text counts as empty. Null doc_ids and repeated rows are kept as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The contract's patterns, in its order. Possessive forms and the look-behind for a run's first character (or the end of the
#: last match) give the same matches without trying every start within a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be sought.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'_-]*+"
#: Code points of the parts that a text's spans are worked into, and how many parts first share a choice of spans.
PART, PARTS = 1000, 32
#: Pieces of a text that end where no term goes on.
PIECE = r"(?s).{1,1000}(?![\p{L}\p{N}'_-])|.[\p{L}\p{N}'_-]*+"
PRIOR, GENERALISE, REMOVE = 0.5, 0.9, 0.98
TERM_KINDS = ("generalised", "removed")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def running_sums(values: Column) -> Column:
    """For each value the sum of those before it."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def summed(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: F.slice(xs, b * size + 1, size))
        bound = F.transform(F.array(blocks), lambda bs: F.struct(bs.alias("blocks"), F.transform(bs, add).alias("sums")))
        whole = F.transform(bound, lambda s: F.flatten(F.transform(s["blocks"], lambda block, j: F.transform(F.array(add(F.slice(s["sums"], F.lit(1), j))), lambda base: F.transform(block, lambda _, i: base + add(F.slice(block, F.lit(1), i))))[0])))
        return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(F.get(whole, F.lit(0)))

    # one-element arrays bind what an inner function would otherwise compute for each element again
    return F.get(F.transform(F.array(values), summed), F.lit(0))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")

    def byte(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(match, r"\."), byte),
        "card": lambda: F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "phone": lambda: F.length(digits).between(9, 15),
    }[kind]()


def with_matches(df: DataFrame, text: str, out: str, pattern: str, wanted: Column) -> DataFrame:
    """df with out array<struct<start, end, value>>: the pattern's matches in text, where wanted."""
    p = F.lit(pattern)
    df = df.withColumn("_found", F.when(wanted, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_found")), lambda g: F.length(g))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, gaps).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_sums", running_sums(F.zip_with("_gaps", "_found", lambda g, m: g + F.length(m))))
    spans = F.zip_with(F.zip_with("_sums", "_gaps", lambda s, g: s + g), "_found", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
    return df.withColumn(out, spans).drop("_found", "_gaps", "_sums")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base array<struct<kind, start, end, value>> of the non-null column text, by kind and start."""
    def checked(kind: str) -> Column:
        good = F.filter(F.col(f"_{kind}"), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    for kind, pattern in PATTERNS.items():
        hint = F.lit(True) if not HINTS[kind] else F.contains(F.col(text), F.lit(HINTS[kind]))
        if kind != "email":
            hint = hint & F.col(text).rlike("[0-9]")
        df = with_matches(df, text, f"_{kind}", pattern, hint)
    return df.withColumn("base", F.concat(*map(checked, PATTERNS)).cast(f"array<{SPAN}>")).drop(*[f"_{k}" for k in PATTERNS])


def by_part(text: Column, spans: Column, work) -> Column:
    """work(part, lo, near) for each part of a text, put together: lo is where the part begins, near the spans that reach into it.

    Spans are first chosen for PARTS parts together, so what is done for each span does not grow with the text.
    """
    within = lambda lo, size: lambda s: (s["start"] < lo + size) & (s["end"] > lo)

    def joined(parts: Column) -> Column:
        def some(k: Column) -> Column:
            lo = k * (PART * PARTS)
            near = F.array(F.filter(spans, within(lo, PART * PARTS)))
            each = lambda close: F.transform(F.slice(parts, k * PARTS + 1, PARTS), lambda part, i: work(part, lo + i * PART, F.filter(close, within(lo + i * PART, PART))))
            return F.array_join(F.get(F.transform(near, each), F.lit(0)), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / PARTS).cast("int")), some), "")

    # one-element arrays bind what an inner function would otherwise compute for each element again
    parts = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))
    return F.when(F.size(spans) == 0, text).otherwise(F.get(F.transform(parts, joined), F.lit(0)))


def outside(text: Column, base: Column) -> Column:
    """text with blanks for its base spans, so that all else keeps its place."""

    def blanked(part: Column, lo: Column, near: Column) -> Column:
        def one(t: Column, s: Column) -> Column:
            first = F.greatest(s["start"] - lo, F.lit(0))
            n = F.least(s["end"] - lo, F.lit(PART)) - first
            return F.overlay(t, F.repeat(F.lit(" "), n), first + 1, n)

        return F.aggregate(near, part, one)

    return by_part(text, base, blanked)


def _words(kept: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns and term for each different word outside the base spans of rows(text, base)."""
    found = F.regexp_extract_all(outside(F.col("text"), F.col("base")), F.lit(TERM), F.lit(0))
    return kept.select(*columns, F.explode(F.array_distinct(F.transform(found, lambda w: F.lower(w)))).alias("term"))


def disclosing(kept: DataFrame) -> DataFrame:
    """row, term, kind: terms that tell so much about an entity of the row that they are generalised or removed; kept(row, text, base) is settled."""
    n = float(kept.count())
    base, slack = kept.where(F.size("base") > 0), 1 - GENERALISE
    entities = base.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    classes = entities.groupBy("entity").agg(F.count("*").alias("with_entity"), F.bit_xor(F.xxhash64("row")).alias("mark")).where(F.col("with_entity") < n)
    classes = common.settle(classes.select("entity", "with_entity", F.xxhash64("with_entity", "mark").alias("e_class")), "entities")
    held = common.settle(common.join_small(entities, classes, ["entity"]).select("row", "e_class", "with_entity").distinct(), "held")
    p = F.col("with_entity") / F.lit(n)
    # a term in more documents cannot reach GENERALISE with the entity; the bound grows with the entity's documents
    bound = (F.col("with_entity") + PRIOR * p) / F.pow(p, F.lit(slack)) - PRIOR + 1e-6
    most = held.agg(F.max(bound)).first()[0] or 0.0
    # every word of every document is counted: map-side sums leave a row per word and task to shuffle
    counts = _words(kept, F.when(F.size("base") > 0, F.xxhash64("row")).alias("mark")).groupBy("term").agg(F.count("*").alias("with_term"), F.count("mark").alias("with_base"), F.bit_xor("mark").alias("mark"))
    able = (F.col("with_base") > 0) & (F.col("with_term") <= most) & ((F.col("with_base") + PRIOR) / (F.col("with_term") + PRIOR) >= (n or 1) ** -slack - 1e-9)
    terms = common.settle(counts.where(able).select("term", "with_term", F.xxhash64("with_term", "with_base", "mark").alias("t_class")), "terms")
    limits = held.groupBy("row").agg(F.max(bound).alias("limit"))
    near = common.join_small(_words(base, "row"), terms, ["term"]).join(limits, "row").where("with_term <= limit").drop("limit")
    near = common.settle(near.select("row", "term", "t_class", "with_term"), "near-terms")
    pairs = near.select("row", "t_class", "with_term").distinct().join(held, "row").where(F.col("with_term") <= bound)
    pairs = common.settle(pairs, "pairs")
    met = pairs.groupBy("t_class", "e_class", "with_term", "with_entity").agg(F.count("*").alias("both"))
    told = 1 + F.log((F.col("both") + PRIOR * p) / (F.col("with_term") + PRIOR)) / -F.log(p)
    scored = met.withColumn("told", told).where(F.col("told") >= GENERALISE).select("t_class", "e_class", F.when(F.col("told") >= REMOVE, TERM_KINDS[1]).otherwise(TERM_KINDS[0]).alias("kind"))
    scored = common.settle(scored, "disclosing")
    # removal outweighs
    best = common.join_small(pairs.select("row", "t_class", "e_class"), scored, ["t_class", "e_class"]).groupBy("row", "t_class").agg(F.max("kind").alias("kind"))
    return near.select("row", "term", "t_class").join(best, ["row", "t_class"]).select("row", "term", "kind")


def find(docs: DataFrame, carried: tuple = ()) -> DataFrame:
    """doc_id, text (empty if null), base and extra spans of each row of docs(doc_id, text), with the carried columns."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    kept = common.settle(base_spans(texts).select("row", "doc_id", "base", "text", *carried), "base-spans")
    told = common.settle(disclosing(kept.select("row", "text", "base")), "told")
    # only texts with base spans are moved
    marked = kept.where(F.size("base") > 0)
    rows = marked.select("row", "text", "base").join(told.select("row").distinct(), "row").select("row", outside(F.col("text"), F.col("base")).alias("rest"))
    # sums over short pieces, which no term crosses, keep the work in proportion to the text
    pieces = rows.select("row", F.regexp_extract_all("rest", F.lit(PIECE), F.lit(0)).alias("pieces"))
    pieces = pieces.select("row", F.explode(F.zip_with(running_sums(F.transform("pieces", lambda x: F.length(x))), "pieces", lambda at, x: F.struct(at.alias("at"), x.alias("piece")))).alias("p"))
    found = with_matches(pieces.select("row", "p.at", "p.piece"), "piece", "found", TERM, F.lit(True)).select("row", "at", F.explode("found").alias("f"))
    words = found.select("row", F.lower("f.value").alias("term"), (F.col("at") + F.col("f.start")).alias("start"), (F.col("at") + F.col("f.end")).alias("end"))
    extra = words.join(told, ["row", "term"]).select("row", F.struct("kind", "start", "end", F.col("term").alias("value")).alias("s"))
    extra = extra.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("extra"))
    none = F.array().cast(f"array<{SPAN}>")
    return marked.join(extra, "row", "left").withColumn("extra", F.coalesce(F.col("extra"), none)).unionByName(kept.where(F.size("base") == 0).withColumn("extra", none))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs(doc_id, text)."""
    found = find(docs)
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the base spans of text replaced by labels and disclosing terms generalised or removed.

    Overlapping spans are replaced together. Columns and order of columns stay; a text without spans stays as it is, null too.
    """
    # other columns are carried under names of their own
    others = [c for c in docs.columns if c not in {"doc_id", "text"}]
    renamed = docs.select("doc_id", "text", *[common.quoted(c).alias(f"_c{k}") for k, c in enumerate(others)], F.isnull("text").alias("_null"))
    found = find(renamed, (*[f"_c{k}" for k in range(len(others))], "_null"))
    sorted_ = F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("sorted", F.transform(sorted_, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])

    def labelled(part: Column, lo: Column, near: Column) -> Column:
        # a span that begins in a part before this one has its label there
        begun = F.array_max(F.transform(F.filter(near, lambda s: s["start"] < lo), lambda s: s["end"] - lo))
        start = F.struct(F.lit("").alias("out"), F.coalesce(begun, F.lit(0)).alias("upto"))

        def one(done: Column, s: Column) -> Column:
            at, end = s["start"] - lo, s["end"] - lo
            apart = F.struct(F.concat(done["out"], F.substring(part, done["upto"] + 1, at - done["upto"]), F.element_at(label, s["kind"])).alias("out"), end.alias("upto"))
            return F.when(at < 0, done).when(at >= done["upto"], apart).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["upto"], end).alias("upto")))

        return F.aggregate(near, start, one, lambda done: F.concat(done["out"], F.substring(part, done["upto"] + 1, F.lit(PART))))

    text = F.when(~F.col("_null"), by_part(F.col("text"), F.col("sorted"), labelled))
    names = {c: F.col(f"_c{k}") for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": text}
    return found.select(*[names[c].alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; see digest."""
    return digest(common.documents(spark, sf_dir, "doc_id", "text"))
