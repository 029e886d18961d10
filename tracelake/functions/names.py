"""Scalar functions on identifiers, paths, SQL text and offsets, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(name: Column) -> Column:
    """An SQL identifier: quotes are taken off and the case kept; without quotes it is upper case."""
    t = F.trim(name)
    return F.when(t.rlike('^(".*"|`.*`)$') & (F.length(t) > 1), t.substr(F.lit(2), F.length(t) - 2)).otherwise(F.upper(t))


def camel(name: Column) -> Column:
    """SNAKE_CASE to camelCase; names without an underscore become lower case."""
    whole = F.replace(F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(whole, 1, 1)), whole.substr(F.lit(2), F.length(whole)))


def concat_path(*parts: Column) -> Column:
    """Path parts joined by single slashes, with one in front and none behind; nothing at all is `/`."""
    joined = F.concat_ws("/", *parts)
    tidy = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), joined), "/+", "/"), "/$", "")
    return F.when(tidy == "", "/").otherwise(tidy)


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def line_of(text: Column, characters: Column) -> Column:
    """The line, from 1, of the place after so many characters."""
    before = F.substring(text, F.lit(1), characters)
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def bytes_before(text: Column, characters: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), characters))


def binds(sql: Column) -> Column:
    """Names in `#{...}` in order, without their type options."""
    return F.regexp_extract_all(sql, F.lit(r"#\{\s*([A-Za-z0-9_.]+)[^}]*\}"), F.lit(1))


def first_keyword(sql: Column) -> Column:
    return F.lower(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def pack_span(file_id: Column, offset: Column) -> Column:
    return F.shiftleft(file_id.cast("long"), 32).bitwiseOR(offset.cast("long"))


def span_file(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def span_offset(span: Column) -> Column:
    return span.bitwiseAND(F.lit(4294967295)).cast("int")
