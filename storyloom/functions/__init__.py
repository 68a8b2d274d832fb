from storyloom.functions.dates import effective_time, hours_before, parse_date
from storyloom.functions.hashing import content_hash, fnv1a64, hamming, simhash, simhash_tokens
from storyloom.functions.text import (
    content_tokens,
    decode_entities,
    excerpt,
    normalize_query,
    normalize_whitespace,
    strip_html,
    tokenize,
)
from storyloom.functions.urls import canonical_url

__all__ = [
    "canonical_url",
    "content_hash",
    "content_tokens",
    "decode_entities",
    "effective_time",
    "excerpt",
    "fnv1a64",
    "hamming",
    "hours_before",
    "normalize_query",
    "normalize_whitespace",
    "parse_date",
    "simhash",
    "simhash_tokens",
    "strip_html",
    "tokenize",
]
