"""Column functions of the conversion workflow; none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, and the four separators among the control characters, at both ends; plain trim takes ASCII spaces only.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# Fixed value: what an e-mail address looks like.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}\z"
_PLACEHOLDER = r"\{\{(.*?)\}\}"
RIGHT_TO_LEFT = ("ar",)


def full_strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def output_stem(filename: Column) -> Column:
    """The name before its last dot; all of it if there is none."""
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def size_label(size: Column) -> Column:
    return F.format_string("%.1f KB", size / 1024)


def elapsed_label(seconds: Column) -> Column:
    """m:ss; minutes may pass 60."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60)).cast("long"))


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def first_name(name: Column) -> Column:
    return F.element_at(F.split(name, " ", 2), 1)


def initial(name: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.substring(name, 1, 1)), F.lit("")), F.lit("U"))


def normal_email(email: Column) -> Column:
    return F.lower(full_strip(email))


def is_email(email: Column) -> Column:
    return email.rlike(EMAIL)


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), full_strip), lambda x: x != "")


def fill_placeholders(template: Column, values: Column) -> Column:
    """Replace {{name}} by the value of name, for a map of strings, in one pass: values are not filled again.

    Names without a value, or with a null one, stay as they are.
    """
    names = F.regexp_extract_all(template, F.lit(_PLACEHOLDER), 1)
    found = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, full_strip(n)), F.concat(F.lit("{{"), n, F.lit("}}"))))
    return F.array_join(F.zip_with(F.split(template, _PLACEHOLDER, -1), found, lambda text, value: F.concat(text, F.coalesce(value, F.lit("")))), "")


def plural_key(key: Column, count: Column) -> Column:
    return F.concat(key, F.when(count == 1, "_one").otherwise("_other"))


def text_direction(lang: Column) -> Column:
    return F.when(lang.isin(*RIGHT_TO_LEFT), "rtl").otherwise("ltr")


def join_key(user: Column, filename: Column) -> Column:
    return F.concat_ws("/", user, filename)


def key_filename(key: Column) -> Column:
    """What follows the first slash; a file name may hold more of them."""
    return F.regexp_replace(key, "^[^/]*/", "")


def round2(x: Column) -> Column:
    return F.round(x, 2)


def gigabytes(x: Column) -> Column:
    return round2(x / 1e9)
