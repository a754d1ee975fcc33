"""Concepts that each language brings with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Term, definition, synonyms and related terms by language.
SEEDS = {
    "go": [
        ("error-handling", "Go's explicit error return pattern", ["error", "err", "errors"], ["error-wrapping", "sentinel-error"]),
        ("interface", "Go implicit interface satisfaction — any type with the right method set satisfies it", ["contract", "protocol"], ["implementation", "duck-typing", "method-set"]),
        ("goroutine", "Lightweight concurrent execution unit managed by the Go runtime", ["go-routine", "concurrent"], ["channel", "sync", "waitgroup"]),
        ("channel", "Go typed message-passing primitive for goroutine communication", ["chan"], ["goroutine", "select", "concurrency"]),
        ("context", "Go context.Context for cancellation and deadline propagation", ["ctx"], ["cancellation", "deadline", "timeout"]),
        ("middleware", "HTTP handler wrapping pattern for cross-cutting concerns", ["handler-chain", "interceptor"], ["http-handler", "router"]),
        ("struct", "Composite data type with named fields", ["record", "data-type"], ["method", "embedding", "interface"]),
        ("receiver", "The type a method is attached to in Go", ["method-receiver"], ["method", "struct", "pointer-receiver"]),
        ("embedding", "Composition via anonymous fields — Go's alternative to inheritance", ["anonymous-field", "promotion"], ["struct", "interface", "composition"]),
        ("defer", "Deferred function call executed when surrounding function returns", ["cleanup"], ["panic", "recover", "resource-management"]),
    ],
    "python": [
        ("class", "Python class definition — blueprint for creating objects", ["class", "object", "oop"], []),
        ("dataclass", "Python @dataclass — auto-generated __init__, __repr__, etc.", ["dataclass", "data class"], ["class"]),
        ("decorator", "Python decorator — higher-order function wrapping another function or class", ["decorator", "wrapper", "@"], []),
        ("generator", "Python generator — function using yield to lazily produce values", ["generator", "yield", "iterator"], ["async"]),
        ("async", "Python async/await — coroutines using asyncio event loop", ["async", "await", "asyncio", "coroutine"], []),
        ("context-manager", "Python context manager — __enter__/__exit__ protocol for resource management", ["context manager", "with statement", "contextmanager"], ["class"]),
        ("property", "Python @property — computed attribute descriptor", ["property", "getter", "setter"], ["decorator"]),
        ("abstract", "Abstract base class — ABC or ABCMeta defining required interface", ["abstract", "ABC", "interface", "protocol"], ["class"]),
        ("exception", "Custom exception class — subclass of Exception or BaseException", ["exception", "error", "raise", "try"], ["class"]),
        ("type-hint", "Python type annotation — PEP 484/526 static type hints", ["type hint", "annotation", "typing"], []),
    ],
    "typescript": [
        ("component", "React function or class component that returns JSX", ["react-component", "ui-component"], ["props", "hooks", "jsx"]),
        ("hook", "React hook — function starting with 'use' that manages state or side effects", ["react-hook", "custom-hook"], ["useState", "useEffect", "useCallback"]),
        ("interface", "TypeScript interface — structural contract for object shapes", ["type-contract", "shape"], ["type-alias", "generics", "duck-typing"]),
        ("module", "ES module — a file with its own scope exporting and importing symbols", ["es-module", "esm"], ["import", "export", "bundler"]),
        ("async-await", "Asynchronous programming pattern using async functions and await expressions", ["async", "await", "promise-chain"], ["promise", "fetch", "error-handling"]),
        ("generics", "TypeScript generic types for reusable, type-safe abstractions", ["type-parameter", "parameterized-type"], ["interface", "type-alias", "constraint"]),
        ("server-component", "Next.js React Server Component — renders on the server, no client JS", ["rsc", "server-side"], ["client-component", "data-fetching", "streaming"]),
        ("middleware", "Function that intercepts and transforms requests in a pipeline", ["interceptor", "handler-chain"], ["next-middleware", "express-middleware", "decorator"]),
    ],
}


def concept_seeds(spark: SparkSession, languages: list[str] | None = None) -> DataFrame:
    """language, term, definition, synonyms, related."""
    rows = [(lang, *row) for lang in languages or SEEDS for row in SEEDS[lang]]
    return spark.createDataFrame(rows, "language string, term string, definition string, synonyms array<string>, related array<string>")
