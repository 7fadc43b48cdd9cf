"""Column functions over texts, paths and identifiers."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LANGUAGES, SECURITY, SYNONYMS, TEST_PATTERNS


def _accents() -> tuple[str, str]:
    """Letters with marks of all scripts, then the marks themselves; and the bare letters."""
    chars = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M") for c in chars}
    pairs = [(c, b) for c, b in bare.items() if b != c and len(b) == 1]
    marks = [c for c, b in bare.items() if not b]
    return "".join([a for a, _ in pairs] + marks), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
FOLDED = {ord(a): PLAIN[i] if i < len(PLAIN) else None for i, a in enumerate(ACCENTED)}


def fold(text: Column) -> Column:
    """Lower case without accents, composed or not."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def fold_str(text: str) -> str:
    """As ``fold``, of a string."""
    return text.lower().translate(FOLDED)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    """The number of ``tokens`` of a text that is folded already."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of an array of ints up to each element: within blocks first, then over blocks."""
    empty = F.expr("cast(array() AS array<int>)")
    inside = lambda x: F.aggregate(x, empty, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + v)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    upto = F.slice(F.concat(F.array(F.lit(0)), inside(totals)), F.lit(1), F.size(totals))
    return F.flatten(F.zip_with(blocks, upto, lambda x, o: F.transform(inside(x), lambda v: v + o)))


def like_any_case(text: Column, part: str) -> Column:
    """Substring in any letter case; ``_`` and ``%`` of ``part`` are wildcards, as in LIKE."""
    return F.ilike(text, F.lit(f"%{part}%"), F.lit("\x01"))


def holds(text: Column, part: str) -> Column:
    """Substring in any letter case, taken literally."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def trimmed(text: Column) -> Column:
    """Without space characters of any script at both ends."""
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    """Last suffix of the file name in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def any_holds(text: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def is_test_file(path: Column, lang: Column) -> Column:
    """Whether a pattern of the language is in the file name, or in the lower-cased path."""
    out = F.lit(False)
    for name, patterns in TEST_PATTERNS.items():
        out = F.when(lang == name, any_holds(basename(path), patterns) | any_holds(F.lower(path), patterns)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_sensitive(path: Column) -> Column:
    return any_holds(F.lower(path), SECURITY)


def split_identifier(name: Column) -> Column:
    """Parts of an identifier in lower case: at underscores, else at changes of case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([^A-Z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    parts = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.split(spaced, " "))
    return F.filter(F.transform(parts, F.lower), lambda p: p != "")


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 16)


def expand_query(query: str) -> str:
    """A short query with the first three synonyms of its words, or the key a word belongs to."""
    words = query.lower().split()
    if len(words) > 5:
        return query
    out = []
    for w in words:
        out.append(w)
        if w in SYNONYMS:
            out += SYNONYMS[w][:3]
        else:
            out += [key for key, alike in SYNONYMS.items() if w in alike][:1]
    return " ".join(dict.fromkeys(out))


def module_of(path: Column) -> Column:
    """Module of a path: what lies between app, src, lib or packages and the file name; else the folder."""
    parts = F.split(path, "/")
    out = F.coalesce(F.when(F.size(parts) > 1, F.element_at(parts, -2)), F.lit("_root"))
    for root in ("packages", "lib", "src", "app"):
        at = F.array_position(parts, root)
        rest = F.size(parts) - at
        out = F.when(at > 0, F.when(rest <= 1, F.lit(root)).otherwise(F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest((rest - 1).cast("int"), F.lit(0))), "/"))).otherwise(out)
    return F.when(out == "", F.lit("_root")).otherwise(out)
