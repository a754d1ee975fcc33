"""Content-derived identities and scalar expressions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    """The first 16 bytes, in hex, of SHA-256 over the parts joined by colons; a null part counts as empty."""
    joined = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    flat = [x for p in joined for x in (F.lit(":"), p)][1:]
    return F.substring(F.sha2(F.concat(*flat), 256), 1, 32)


def packed(text: Column) -> Column:
    """The 16 bytes of an id in hex; any other text as 17 zero bytes and its UTF-8. What is shuffled in this form takes half the room; see unpacked."""
    return F.when(text.rlike("^[0-9a-f]{32}$"), F.unhex(text)).otherwise(F.concat(F.lit(bytearray(17)), F.encode(text, "UTF-8")))


def unpacked(made: Column) -> Column:
    """The text that packed() was made of."""
    return F.when(F.octet_length(made) == 16, F.lower(F.hex(made))).otherwise(F.decode(F.substring(made, 18, 2**31 - 1), "UTF-8"))


def node_id(project: Column, kind: Column, canonical: Column) -> Column:
    return _digest(project, kind, canonical)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return _digest(source, kind, target)


def intent_id(project: Column, node: Column, kind: Column) -> Column:
    return _digest(project, node, kind)


def record_id(prefix: str, *parts: Column) -> Column:
    """A stable id of a semantic record."""
    return F.concat(F.lit(f"{prefix}-"), _digest(*parts))


def document_id(prefix: str, document: Column) -> Column:
    """The id of a plan or another record by all that is in it: its canonical JSON, fields in the order of the struct."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(document), 256), 1, 32))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Confidences and the activations they stand for.
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}


def confidence_activation(confidence: Column) -> Column:
    e = F.lit(CONFIDENCE["medium"])
    for name, value in CONFIDENCE.items():
        e = F.when(confidence == name, value).otherwise(e)
    return e


def activation_confidence(activation: Column) -> Column:
    return F.when(activation >= 0.8, "high").when(activation >= 0.56, "medium").otherwise("low")


def spaces(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def term(text: Column) -> Column:
    return F.lower(spaces(text))


#: Capitalised generics that mean their lower-case builtins.
GENERICS = ["List", "Dict", "Set", "Tuple", "FrozenSet", "Type"]


def canonical_type(language: Column, name: Column) -> Column:
    """Type names that mean the same in one language, made equal; arguments that are themselves nested are left as they are."""
    plain = F.regexp_replace(name, r"[ \t\r\n]", "")
    go = F.replace(plain, F.lit("interface{}"), F.lit("any"))
    ts = F.regexp_replace(plain, r"Array<([^<>]+)>", "$1[]")
    py = plain
    for t in GENERICS:
        py = F.regexp_replace(py, rf"\b{t}\[", f"{t.lower()}[")
    py = F.regexp_replace(py, r"Optional\[([^\[\]]+)\]", "$1|None")
    return F.when(language == "go", go).when(language.isin("typescript", "tsx", "javascript"), ts).when(language == "python", py).otherwise(plain)


#: Substrings of a call's name that tell its effect, in order of precedence, and verbs of mutations.
EFFECTS = {
    "network": ["http", "fetch", "axios", "request", "grpc", "socket", "net.", "url."],
    "db": ["sql", "db.", ".db", "query", "redis", "mongo", "gorm", "database", "repository", "datastore"],
    "io": ["os.", "io.", "ioutil", "fs.", "file", "open(", "readfile", "writefile", "readall"],
    "log": ["log", "console", "print", "fmt.print", "slog"],
}
VERBS = ["track", "send", "emit", "publish", "save", "create", "update", "delete", "write"]
#: Import paths (or what lies below them) and receivers that tell an effect.
EFFECT_PATHS = {
    "network": ["net/http", "net/url", "net", "google.golang.org/grpc", "github.com/gorilla/websocket"],
    "db": ["database/sql", "gorm.io", "go.mongodb.org", "github.com/redis", "github.com/jmoiron/sqlx"],
    "io": ["os", "io", "io/ioutil", "bufio", "path/filepath"],
    "log": ["log", "log/slog", "fmt"],
}
EFFECT_ROOTS = {
    "network": ["http", "https", "fetch", "axios", "request", "requests", "grpc", "ws", "socket", "urllib"],
    "db": ["db", "sql", "database", "redis", "mongo", "session", "repository", "datastore"],
    "io": ["os", "io", "fs", "ioutil", "file", "pathlib"],
    "log": ["log", "logger", "logging", "console", "slog", "fmt"],
}


def _first_kind(tests: dict[str, Column], otherwise: Column) -> Column:
    e = otherwise
    for kind in reversed(tests):
        e = F.when(tests[kind], kind).otherwise(e)
    return e


def _recognised(name: Column) -> Column:
    low = F.lower(name)
    return _first_kind({k: F.exists(F.lit(words), lambda s: low.contains(s)) for k, words in EFFECTS.items()}, F.lit(None).cast("string"))


def _verb(name: Column) -> Column:
    low = F.lower(name)
    return F.exists(F.lit(VERBS), lambda s: low.contains(s))


def effect_kind(name: Column) -> Column:
    """The kind of effect that a call's name alone tells."""
    return F.coalesce(_recognised(name), F.when(_verb(name), "mutation").otherwise("unclassified"))


def effect_basis(name: Column, declared: Column | None = None, confidence: Column | None = None) -> Column:
    """resolved for a recognised name, else heuristic; what was declared, or a confidence of old, goes before."""
    by_name = F.when(_recognised(name).isNotNull(), "resolved").otherwise("heuristic")
    if confidence is not None:
        by_name = F.when(confidence == "high", "resolved").when(confidence == "low", "heuristic").otherwise(by_name)
    return by_name if declared is None else F.when(F.coalesce(declared, F.lit("")) != "", declared).otherwise(by_name)


def call_effect(method: Column, root: Column, path: Column) -> Column:
    """kind and basis of a call: its import path goes before its receiver, and that before its verb."""
    m, r, p = (F.lower(F.coalesce(c, F.lit(""))) for c in (method, root, path))
    by_path = _first_kind({k: F.exists(F.lit(v), lambda x: (p == x) | F.startswith(p, F.concat(x, F.lit("/")))) for k, v in EFFECT_PATHS.items()}, F.lit(None).cast("string"))
    by_root = _first_kind({k: r.isin(v) for k, v in EFFECT_ROOTS.items()}, F.lit(None).cast("string"))
    known = F.coalesce(by_path, by_root)
    kind = F.coalesce(known, F.when(_verb(m), "mutation").otherwise("unclassified"))
    return F.struct(kind.alias("kind"), F.when(known.isNotNull(), "resolved").otherwise("heuristic").alias("basis"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4) + 1


def search_tokens(query: Column) -> Column:
    """Lower-case tokens of two bytes and more, each once, in order."""
    parts = F.transform(F.split(query, r"[^\p{L}\p{N}_\\.$:/-]+"), lambda t: F.btrim(F.lower(t), F.lit(" .:/-")))
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= 2))
