"""Phrases and synonyms that queries are matched with. Both lists can be given by the user instead."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from quern.functions.stem import stem_word
from quern.functions.text import JOINER

#: Known phrases.
PHRASES = [
    "machine learning", "Steve Jobs", "deep learning", "artificial intelligence", "neural network", "neural networks", "natural language processing",
    "natural language", "large language model", "large language models", "language model", "search engine", "search engines", "full text search",
    "full text", "inverted index", "data structure", "data structures", "binary tree", "linked list", "hash map", "hash table", "source code",
    "open source", "version control", "software engineering", "computer science", "operating system", "operating systems", "web server", "web framework",
    "rest api", "api endpoint", "load balancer", "load balancing", "message queue", "event loop", "async await", "garbage collection", "memory management",
    "memory safety", "type system", "type inference", "compile time", "run time", "runtime error", "stack overflow", "null pointer", "race condition",
    "dead lock", "deadlock", "context switch", "system call", "bit map", "data base", "data bases", "key value", "time series", "time complexity",
    "space complexity", "big o", "object oriented", "functional programming", "concurrency control", "parallel computing", "distributed system",
    "distributed systems", "cloud computing", "edge computing", "micro services", "microservice", "design pattern", "design patterns",
    "dependency injection", "unit test", "unit tests", "integration test", "continuous integration", "continuous deployment", "command line",
    "command line interface", "user interface", "user experience", "application programming interface", "ownership model", "borrow checker",
    "lifetime annotation", "trait object", "async runtime", "error handling", "term frequency", "inverse document frequency", "document frequency",
    "relevance feedback", "query expansion", "rank fusion", "reciprocal rank", "cosine similarity", "edit distance", "levenshtein distance", "prefix tree",
    "porter stemmer", "information retrieval",
]

#: Head word and its synonyms.
SYNONYMS = {
    "fast": ["quick", "rapid", "swift", "speedy", "performant", "efficient"],
    "quick": ["fast", "rapid", "swift", "speedy"],
    "slow": ["sluggish", "leisurely", "inefficient"],
    "speed": ["performance", "throughput", "velocity", "latency", "rate"],
    "performance": ["speed", "efficiency", "throughput", "benchmark"],
    "efficient": ["fast", "optimal", "lean", "lightweight"],
    "optimize": ["improve", "tune", "enhance", "accelerate", "speed"],
    "search": ["find", "query", "lookup", "retrieve", "locate", "discover"],
    "find": ["search", "locate", "discover", "retrieve", "lookup"],
    "query": ["search", "request", "lookup", "find"],
    "retrieve": ["fetch", "get", "obtain", "find", "search"],
    "index": ["catalogue", "catalog", "store", "record", "register"],
    "rank": ["score", "order", "sort", "prioritize", "weight"],
    "score": ["rank", "weight", "rate", "evaluate", "measure"],
    "relevance": ["accuracy", "pertinence", "significance", "importance"],
    "match": ["find", "locate", "result", "hit", "correspond"],
    "store": ["save", "persist", "write", "record", "keep"],
    "data": ["information", "content", "record", "entry"],
    "database": ["storage", "repository", "datastore", "db"],
    "file": ["document", "record", "resource", "entry"],
    "document": ["file", "record", "text", "content", "entry"],
    "memory": ["ram", "heap", "storage", "space", "allocation"],
    "cache": ["buffer", "store", "memory", "temp"],
    "build": ["compile", "construct", "create", "make", "generate"],
    "compile": ["build", "transpile", "assemble", "process"],
    "run": ["execute", "start", "launch", "invoke"],
    "execute": ["run", "perform", "invoke", "call"],
    "create": ["make", "build", "generate", "new", "construct", "produce"],
    "delete": ["remove", "erase", "drop", "clear", "destroy"],
    "update": ["edit", "modify", "change", "patch", "alter", "revise"],
    "error": ["bug", "fault", "issue", "problem", "exception", "failure"],
    "fix": ["repair", "resolve", "patch", "correct", "debug", "solve"],
    "test": ["check", "verify", "validate", "assert", "confirm"],
    "deploy": ["release", "publish", "ship", "launch", "push"],
    "implement": ["build", "create", "develop", "code", "write", "make"],
    "library": ["package", "module", "crate", "dependency", "framework"],
    "framework": ["library", "toolkit", "platform", "engine", "system"],
    "algorithm": ["method", "procedure", "routine", "approach", "technique"],
    "sort": ["order", "arrange", "rank", "organize", "sequence"],
    "parse": ["analyze", "process", "read", "interpret", "decode"],
    "tokenize": ["split", "segment", "parse", "break", "divide"],
    "stem": ["normalize", "reduce", "truncate", "root"],
    "server": ["host", "service", "backend", "node", "instance"],
    "client": ["user", "consumer", "caller", "requester"],
    "network": ["internet", "web", "connection", "communication"],
    "async": ["asynchronous", "concurrent", "nonblocking", "parallel"],
    "concurrent": ["parallel", "async", "simultaneous", "multi"],
    "safe": ["secure", "sound", "reliable", "robust", "stable"],
    "type": ["kind", "category", "class", "sort", "form"],
    "large": ["big", "huge", "massive", "giant", "enormous", "colossal", "titanic"],
    "small": ["tiny", "compact", "lightweight", "minimal", "little"],
    "simple": ["easy", "basic", "straightforward", "plain"],
    "complex": ["advanced", "sophisticated", "difficult", "intricate"],
    "use": ["apply", "employ", "utilize", "leverage", "adopt"],
    "support": ["help", "assist", "enable", "allow", "facilitate"],
    "provide": ["give", "offer", "supply", "deliver", "produce"],
    "require": ["need", "depend", "demand", "expect"],
    "include": ["contain", "add", "incorporate", "embed"],
    "handle": ["manage", "process", "deal", "control", "treat"],
    "generate": ["create", "produce", "make", "output", "emit"],
    "extract": ["parse", "get", "pull", "obtain", "derive"],
    "compute": ["calculate", "process", "evaluate", "determine"],
    "measure": ["evaluate", "assess", "benchmark", "track", "monitor"],
}


def default_phrases() -> list[str]:
    return list(PHRASES)


def default_synonyms() -> dict[str, list[str]]:
    return {head: list(synonyms) for head, synonyms in SYNONYMS.items()}


def phrase_terms(phrases: Iterable[str]) -> list[str]:
    """Phrase terms (stems, joined) of phrases of two or three words; no window has the length of any other."""
    stems = ([stem_word(w) for w in p.split()] for p in phrases)
    return sorted({JOINER.join(s) for s in stems if len(s) in (2, 3)})


def synonym_pairs(synonyms: Mapping[str, Iterable[str]]) -> list[tuple[str, str]]:
    """(stem, synonym's stem), in both directions, each pair once; synonyms of synonyms are not followed."""
    one_way = {(stem_word(head), stem_word(s)) for head, rest in synonyms.items() for s in rest}
    return sorted(one_way | {(b, a) for a, b in one_way})
