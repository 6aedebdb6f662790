"""Label-map expressions: fingerprints, join keys, matchers, subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _joined(labels: ColumnOrName, fmt, sep: str) -> Column:
    entries = F.sort_array(F.map_entries(_col(labels)))
    return F.array_join(F.transform(entries, fmt), sep)


def labels_text(labels: ColumnOrName) -> Column:
    """Sorted `k=v,k=v`."""
    return F.coalesce(_joined(labels, lambda e: F.concat(e["key"], F.lit("="), e["value"]), ","), F.lit(""))


def labels_key(labels: ColumnOrName) -> Column:
    """Sorted `k=v` lines: the join key for a label set (a MAP cannot be joined on).

    Equal signs in names and values, line ends in names and the mark of the escape itself are escaped: so a line
    with an equal sign always starts a label, and different sets have different keys. Other values stay as they are.
    """
    def escaped(text, *more):
        for mark, code in (("\x01", "\x011"), ("=", "\x01e"), *more):
            text = F.replace(text, F.lit(mark), F.lit(code))
        return text

    return F.coalesce(
        _joined(labels, lambda e: F.concat(escaped(e["key"], ("\n", "\x01n")), F.lit("="), escaped(e["value"]), F.lit("\n")), ""), F.lit(""))


def series_id(name: ColumnOrName, labels: ColumnOrName) -> Column:
    return F.md5(F.concat(_col(name), F.lit("{"), labels_text(labels), F.lit("}")))


def log_group_id(source: ColumnOrName, level: ColumnOrName) -> Column:
    return F.md5(F.concat(_col(source), F.lit(":"), _col(level)))


def display_name(name: ColumnOrName, labels: ColumnOrName) -> Column:
    """`name{k=v,..}`, or the bare name for a series without labels."""
    text = labels_text(labels)
    return F.when(text == "", _col(name)).otherwise(F.concat(_col(name), F.lit("{"), text, F.lit("}")))


def label(labels: ColumnOrName, key: str) -> Column:
    """Value of one label; a missing label reads as the empty string."""
    return F.coalesce(F.try_element_at(_col(labels), F.lit(key)), F.lit(""))


def matches(labels: ColumnOrName, wanted: Mapping[str, str]) -> Column:
    cond = F.lit(True)
    for key, value in wanted.items():
        cond = cond & (label(labels, key) == value)
    return cond


def matches_map(labels: ColumnOrName, wanted: ColumnOrName) -> Column:
    """The same test with the wanted pairs in a MAP column (rules kept as rows)."""
    labels = _col(labels)
    return F.forall(
        F.map_entries(_col(wanted)),
        lambda e: F.coalesce(F.try_element_at(labels, e["key"]), F.lit("")) == e["value"])


def subset(labels: ColumnOrName, keys: Sequence[str]) -> Column:
    """Only the listed labels that are present."""
    if not keys:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(_col(labels), lambda k, v: k.isin(*keys))


def prometheus_labels(labels: ColumnOrName) -> Column:
    r"""`{k="v",..}` with backslash, quote and newline escaped; empty for no labels."""
    def escaped(v):
        v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
        v = F.replace(v, F.lit('"'), F.lit('\\"'))
        return F.replace(v, F.lit("\n"), F.lit("\\n"))

    body = _joined(labels, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')), ",")
    return F.when(F.coalesce(body, F.lit("")) == "", "").otherwise(F.concat(F.lit("{"), body, F.lit("}")))
