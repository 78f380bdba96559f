"""Byte-exact text functions: hashes, slices, lines and columns, edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """``sha256:`` and 64 lower-case hex digits; null stays null."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def parsed_hash(value: Column) -> Column:
    """The hash if it is 64 lower-case hex digits with its prefix, else null."""
    return F.when(value.rlike("^sha256:[0-9a-f]{64}$"), value)


def span_contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Inclusive on both ends; empty spans are allowed."""
    return (outer_start <= start) & (outer_end >= end)


def span_valid(start: Column, end: Column, text: Column) -> Column:
    """Within the text's bytes and not reversed."""
    return (start >= 0) & (start <= end) & (end <= F.octet_length(text))


def _continues(byte: Column) -> Column:
    """Whether a one-byte binary is a UTF-8 continuation byte."""
    return F.hex(byte).between("80", "BF")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets; null where they lie outside or split a character."""
    raw = F.encode(text, "UTF-8")
    whole = ~_continues(F.substring(raw, start + 1, F.lit(1))) & ~_continues(F.substring(raw, end + 1, F.lit(1)))
    return F.when(span_valid(start, end, text) & whole, F.decode(F.substring(raw, start + 1, end - start), "UTF-8"))


def _before(text: Column, offset: Column) -> Column:
    """The text before a byte offset, clamped to the text and moved back to a character's first byte."""
    raw = F.encode(text, "UTF-8")
    at = F.greatest(F.lit(0), F.least(offset, F.octet_length(text)))
    back = F.lit(0)
    for k in (3, 2, 1):
        run = F.lit(True)
        for j in range(k):
            run = run & _continues(F.substring(raw, at - j + 1, F.lit(1)))
        back = F.when((at >= k) & run & (back == 0), F.lit(k)).otherwise(back)
    return F.decode(F.substring(raw, F.lit(1), at - back), "UTF-8")


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset."""
    before = _before(text, offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def utf16_column(text: Column, offset: Column) -> Column:
    """1-based column of a byte offset in UTF-16 units."""
    last = F.substring_index(_before(text, offset), "\n", -1)
    return (F.octet_length(F.encode(last, "UTF-16LE")) / 2 + 1).cast("bigint")


def last_segment(name: Column) -> Column:
    """The part after the last dot."""
    return F.substring_index(name, ".", -1)


def uri_path(uri: Column) -> Column:
    """The path of a file URI, decoded; other text stays."""
    return F.when(uri.startswith("file://"), F.url_decode(F.substr(uri, F.lit(8)))).otherwise(uri)


def docs_url(base: str, rule: Column) -> Column:
    """The page of a rule, by its name, under a base address."""
    return F.concat(F.lit(base.rstrip("/") + "/"), rule, F.lit(".md"))


def apply_edits(text: Column, edits: Column) -> Column:
    """Apply non-overlapping edits (start, end in bytes, new_text), from the right to the left."""
    ordered = F.array_sort(F.filter(edits, lambda e: e.isNotNull()), lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))

    def one(raw: Column, e: Column) -> Column:
        return F.concat(F.substring(raw, F.lit(1), e["start"]), F.encode(e["new_text"], "UTF-8"), F.substring(raw, e["end"] + 1, F.octet_length(raw)))

    return F.decode(F.aggregate(ordered, F.encode(text, "UTF-8"), one), "UTF-8")


def parentheses_around(text: Column, start: Column, end: Column) -> Column:
    """How many pairs of parentheses stand directly around a span, blanks aside."""
    after = F.decode(F.substring(F.encode(text, "UTF-8"), end + 1, F.octet_length(text)), "UTF-8")
    opened = F.regexp_count(F.regexp_extract(_before(text, start), r"([(\s]*)$", 1), F.lit(r"\("))
    closed = F.regexp_count(F.regexp_extract(after, r"^([)\s]*)", 1), F.lit(r"\)"))
    return F.least(opened, closed)


def component_name(name: Column) -> Column:
    """Whether a name begins with an upper-case letter."""
    return name.rlike(r"^\p{Lu}")


def async_type(type_text: Column) -> Column:
    """Whether a return type's text is a promise or an asynchronous iterable."""
    return type_text.rlike(r"\b(Promise|PromiseLike|AsyncIterable)\b")


#: Result types that are cleanups or nothing, and what a function type may not hold to be one.
NO_RESULT = ["void", "undefined", "never", "VoidFunction"]
NO_CLEANUP = ["Promise", "AsyncIterable", "number", "string", "boolean", "null", "{"]


def cleanup_type(type_text: Column) -> Column:
    """Whether the text of a result type says that it is a cleanup function or nothing; null where there is no text."""
    t = F.trim(type_text)
    denied = F.lit(False)
    for word in NO_CLEANUP:
        denied = denied | t.contains(word)
    return t.isin(*NO_RESULT) | (t.contains("=>") & ~denied)


def property_start(text: Column, start: Column, end: Column) -> Column:
    """Byte offset of the property in a callee's span: what follows its last dot; the start where there is none or the span lies outside."""
    own = byte_slice(text, start, end)
    return F.when(own.contains("."), end - F.octet_length(F.substring_index(own, ".", -1))).otherwise(start)


def path_uri(path: Column) -> Column:
    """The file URI of a path: everything but unreserved characters and slashes is percent-encoded."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def returned_arrow(value: Column) -> Column:
    """Whether a value's text begins an arrow function: parameters in parentheses up to the first closing one, or a name, and an arrow."""
    return value.rlike(r"^\s*(async\s*)?(\([^)]*\)|[A-Za-z0-9_$]+)\s*=>")


def constant_array_binding(before_name: Column, after_name: Column, after_callee: Column) -> Column:
    """Whether a call initialises ``const [name, …] =``: from the text before the first name, from the name to the callee, and after the callee.

    After the callee a type in angle brackets may stand before the arguments.
    """
    return before_name.rlike(r"const\s*\[\s*$") & after_name.rlike(r"\]\s*=\s*$") & after_callee.rlike(r"^\s*(<[^>]*>\s*)?\(")
