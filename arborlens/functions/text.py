"""Text functions as column expressions: tokens, similarities, normal forms, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of token sets; words left out of questions.
STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"]
ASKING = ["what", "where", "when", "why", "how", "who", "which", "can", "could", "would", "should", "do", "does", "did", "is", "are", "was", "were"]
#: Not next to an ASCII letter, digit or underscore. Java's own \b also looks at letters beyond ASCII.
BEGIN, END = "(?<![a-zA-Z0-9_])", "(?![a-zA-Z0-9_])"


def tokens(x: Column) -> Column:
    """Lower-case words of letters, digits and underscores, over two long, that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def words(x: Column) -> Column:
    """Lower-case pieces between white space, empty ones too."""
    return F.split(F.lower(x), r"\s+")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def _count(all_: Column, token: Column) -> Column:
    return F.size(F.filter(all_, lambda y: y == token)).cast("double")


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of token counts; 0 where either has no tokens."""
    x, y = tokens(a), tokens(b)
    total = lambda arr, f: F.aggregate(F.transform(F.array_distinct(arr), f), F.lit(0.0), lambda s, v: s + v)
    dot = total(x, lambda t: _count(x, t) * _count(y, t))
    norm = lambda arr: F.sqrt(total(arr, lambda t: _count(arr, t) * _count(arr, t)))
    return F.coalesce(F.try_divide(dot, norm(x) * norm(y)), F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; both empty: 1, one empty: 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b), longest))


def blend(a: Column, b: Column) -> Column:
    """0.3 Jaccard, 0.4 cosine, 0.3 Levenshtein."""
    return F.coalesce(token_jaccard(a, b), F.lit(0.0)) * 0.3 + tf_cosine(a, b) * 0.4 + levenshtein_similarity(a, b) * 0.3


def question(x: Column) -> Column:
    """A question without marks, question words and spare spaces."""
    x = F.regexp_replace(F.lower(x), "[?!.]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, rf"{BEGIN}({'|'.join(ASKING)}){END}", ""), r"\s+", " "))


def query_pattern(x: Column) -> Column:
    """A query with its properties, strings and whole numbers replaced."""
    x = F.regexp_replace(F.regexp_replace(x, r"\{[^}]*\}", "{...}"), "'[^']*'", "'...'")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b\d+\b", "N"), r"\s+", " "))


def query_shape(x: Column) -> Column:
    """A query with strings and digits as question marks."""
    x = F.regexp_replace(F.regexp_replace(x, "['\"][^'\"]*['\"]", "?"), r"\d+", "?")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: The descriptions of query patterns are those that a caller compares with.
def pattern_description(x: Column) -> Column:
    asks = x.contains("MATCH") & x.contains("RETURN")
    return (
        F.when(asks & x.contains("*"), "Variable-length path traversal query")
        .when(asks & x.contains("COUNT"), "Aggregation counting query")
        .when(asks & x.contains("COLLECT"), "Collection aggregation query")
        .when(asks, "Basic node/relationship matching query")
        .otherwise("Custom query pattern")
    )


def query_hash(x: Column, legacy: bool = False) -> Column:
    """A key of a query's normal form; ``legacy`` keys on the first characters alone."""
    normal = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    if not legacy:
        return F.hex(F.xxhash64(normal))
    return F.substring(F.regexp_replace(F.base64(F.encode(normal, "UTF-8")), "[^a-zA-Z0-9]", ""), 1, 16)


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def is_identifier(x: Column) -> Column:
    return x.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")


def identifiers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"{BEGIN}[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def line_count(x: Column) -> Column:
    return F.size(F.split(x, "\n"))


def imported_modules(x: Column) -> Column:
    """Modules of ES imports, each once."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"import\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]"), F.lit(1)))


def csv_quote(x: Column) -> Column:
    """A CSV field: quoted where it has a comma, a quote or a line end, quotes doubled."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def human_size(n: Column) -> Column:
    """Bytes as text, in units of 1024, two decimals at most."""
    units = ["Bytes", "KB", "MB", "GB"]
    out = F.when(n == 0, "0 Bytes")
    for k in (3, 2, 1, 0):
        value = F.regexp_replace(F.format_string("%.2f", F.round(n / 1024.0**k, 2)), r"\.?0+$", "")
        out = out.when(n >= 1024**k, F.concat(value, F.lit(f" {units[k]}")))
    return out


def language_of_content(x: Column) -> Column:
    """A guess from what stands in a text."""
    return (
        F.when(x.contains("def ") & x.contains(":") | x.contains("import ") & ~x.contains(";") & x.contains("self"), "python")
        .when(x.contains("interface ") | x.rlike(r":\s*(string|number|boolean)\b"), "typescript")
        .when(x.contains("public class ") | x.contains("System.out"), "java")
        .when(x.contains("function ") | x.contains("const ") | x.contains("=>"), "javascript")
        .otherwise("unknown")
    )


def changed(items: Column, how: str) -> Column:
    """Each string of an array in upper or lower case, or trimmed."""
    f = {"upper": F.upper, "lower": F.lower, "trim": F.trim}[how]
    return F.transform(items, lambda x: f(x))


def of_length(items: Column, low: int, high: int | None = None) -> Column:
    return F.filter(items, lambda x: (F.length(x) >= low) & (F.lit(True) if high is None else F.length(x) <= high))


#: Tasks by name: what a worker was asked to do, as a column function.
TASKS = {
    "word_count": word_count, "char_count": F.length, "line_count": line_count, "identifiers": identifiers, "imports": imported_modules,
    "tokens": tokens, "question": question, "pattern": query_pattern, "shape": query_shape, "hash": content_hash,
}
