"""Investigation requests: reading them from tagged text, checking and completing them, and which tools they activate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may anchor a request, confidences, modes and model tiers (the first is the default), and bounds of numbers.
ANCHOR_TYPES = ["symbol", "namespace", "concept", "file"]
CONFIDENCES = ["high", "medium", "low"]
MODES = ["thinking", "direct", "audit"]
TIERS = ["fast", "standard", "thinking"]
BOUNDS = {"max_loops": (1, 20), "k_limit": (10, 100)}
#: Default and greatest number of rows of each kind of request.
CLAMPS = {"search": (10, 50), "source_ranges": (3, 12), "investigate": (5, 12), "related": (10, 30), "nodes": (50, 200)}
#: Rows and bytes shown by tools and packets.
SHOWN = {"callers": 25, "callees": 25, "references": 10, "implementors": 15, "org": 20, "internals": 20}
BYTES = {"content": 2000, "short": 1500, "packet": 2200, "long_packet": 3000, "middle_packet": 1800}
#: The controlled vocabulary of semantic tags.
TAGS = """operation.mutate operation.cart.modify operation.checkout.validate operation.block.register
surface.wordpress.admin surface.wordpress.request surface.wordpress.rest surface.woocommerce.checkout surface.woocommerce.store_api
surface.gutenberg.editor input.user_controlled output.html output.user_facing_text effect.database.query effect.cart.mutation
effect.persisted_content context.wordpress.plugin context.woocommerce context.woocommerce.cart context.woocommerce.checkout
context.gutenberg context.gutenberg.block context.gutenberg.package""".split()

ANCHORS = "array<struct<type:string,id:string,confidence:string>>"


def clamp(kind: str, limit: int | None) -> int:
    """The rows that a request of a kind may have: its default for none, never more than its most."""
    default, most = CLAMPS[kind]
    return default if not limit or limit <= 0 else min(limit, most)


def shown(values: Column, kind: str) -> Column:
    """The first values that a tool shows."""
    return F.slice(values, 1, SHOWN[kind])


def truncated(text: Column, kind: str = "content") -> Column:
    """Text of at most so many bytes of UTF-8, cut before a character that doesn't fit, with a note where it was cut."""
    most = BYTES[kind]
    # a cut inside a character leaves U+FFFD, which is taken off again
    cut = F.rtrim(F.call_function("make_valid_utf8", F.substring(text.cast("binary"), 1, most).cast("string")), F.lit("�"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(f"\n_(content truncated at {most} chars)_")))


def _tag(text: Column, name: str) -> Column:
    """What stands in the first tag of that name; null without one."""
    return F.when(text.rlike(rf"(?s)<{name}>.*?</{name}>"), F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1))


def _attribute(text: Column, name: str) -> Column:
    """The last value of an attribute; null without one."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r'(\w[\w-]*)="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(r'(\w[\w-]*)="([^"]*)"'), F.lit(2)).alias("v"))
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def _whole(text: Column, name: str) -> Column:
    low, high = BOUNDS[name]
    n = F.trim(_tag(text, name)).try_cast("int")
    return F.when(n.isNull(), 0).when(n < low, low).when(n > high, high).otherwise(n)


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """df with mode, anchors, predicates, open_queries, max_loops, k_limit (0: the project's), role_hint and model_tier from tags."""
    t = F.col(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(r"<anchor\s+([^>]*?)(?:/>|>)"), F.lit(1)), lambda a: F.struct(_attribute(a, "type").alias("type"), _attribute(a, "id").alias("id"), F.coalesce(F.nullif(_attribute(a, "confidence"), F.lit("")), F.lit("medium")).alias("confidence")))
    anchors = F.filter(found, lambda a: a["type"].isin(ANCHOR_TYPES) & (a["id"] != ""))
    named = F.transform(F.regexp_extract_all(t, F.lit(r"<predicate\s+([^>]*?)(?:/>|>)"), F.lit(1)), lambda a: F.struct(_attribute(a, "name").alias("name"), _attribute(a, "value").alias("value")))
    named = F.filter(named, lambda p: (p["name"] != "") & p["value"].isNotNull())
    # of a name given twice the last value counts
    last = F.filter(named, lambda p, k: ~F.exists(F.slice(named, k + 2, F.size(named)), lambda q: q["name"] == p["name"]))
    asked = F.transform(F.regexp_extract_all(F.coalesce(_tag(t, "open_queries"), F.lit("")), F.lit("<open_query>(.*?)</open_query>"), F.lit(1)), lambda q: F.trim(q))
    mode, tier = F.trim(_tag(t, "mode")), F.trim(_tag(t, "model_tier"))
    return df.withColumns({
        "mode": F.when(mode.isin(MODES), mode).otherwise(MODES[0]), "anchors": anchors.cast(ANCHORS), "predicates": F.map_from_entries(last),
        "open_queries": F.filter(asked, lambda q: q != ""), "max_loops": _whole(t, "max_loops"), "k_limit": _whole(t, "k_limit"),
        "role_hint": F.coalesce(F.trim(_tag(t, "role_hint")), F.lit("")), "model_tier": F.when(tier.isin(TIERS), tier).otherwise(""),
    })


def validate(requests: DataFrame) -> DataFrame:
    """requests with error (null if sound) and with confidences, predicates and numbers out of range set right."""
    bad = F.try_element_at(F.filter("anchors", lambda a: (a["id"] == "") | a["id"].isNull() | ~F.coalesce(a["type"].isin(ANCHOR_TYPES), F.lit(False))), F.lit(1))
    error = F.when(F.size("anchors") <= 0, "no anchors").when(F.size("open_queries") <= 0, "no open queries").when(bad.isNotNull() & (F.coalesce(bad["id"], F.lit("")) == ""), "empty id").when(bad.isNotNull(), "unknown type")
    sure = F.transform("anchors", lambda a: F.struct(a["type"].alias("type"), a["id"].alias("id"), F.when(a["confidence"].isin(CONFIDENCES), a["confidence"]).otherwise("medium").alias("confidence")))
    within = lambda c, most: F.when(F.col(c).between(0, most), F.col(c)).otherwise(0)
    return requests.withColumns({"error": error, "anchors": sure, "predicates": F.map_filter("predicates", lambda _, v: v == "true"), "max_loops": within("max_loops", BOUNDS["max_loops"][1]), "k_limit": within("k_limit", BOUNDS["k_limit"][1])})


def tools(requests: DataFrame) -> DataFrame:
    """requests with tools: which of the six are activated by mode, anchors and predicates."""

    def asked(name: str) -> Column:
        return F.coalesce(F.try_element_at("predicates", F.lit(name)) == "true", F.lit(False))

    def has(*types: str) -> Column:
        return F.exists("anchors", lambda a: a["type"].isin(*types))

    active = {
        "callgraph": asked("callgraph") | F.exists("anchors", lambda a: (a["type"] == "symbol") & (a["confidence"] != "low")),
        "references": asked("references") | ((F.col("mode") == "thinking") & has("symbol", "namespace")),
        "concepts": asked("concepts") | has("concept"),
        "crossproject": asked("crossproject") | (F.size(F.filter("anchors", lambda a: a["type"] == "concept")) >= 2),
        "filecontext": asked("filecontext") | has("file"),
        "summary": asked("summary") | has("namespace"),
    }
    return requests.withColumn("tools", F.array_compact(F.array(*[F.when(c, n) for n, c in active.items()])))


def normal_tags(values: Column) -> Column:
    """tags (trimmed, each once, in order) and unknown: those outside the vocabulary, with which no tag is accepted."""
    given = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    unknown = F.array_sort(F.array_except(given, F.lit(TAGS)))
    return F.struct(F.when(F.size(unknown) == 0, F.array_sort(given)).alias("tags"), unknown.alias("unknown"))
