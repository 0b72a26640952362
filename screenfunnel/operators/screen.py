"""Alert screens: an ordered catalogue of patterns, the first match rejects the row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import holds, keep_existing, number, selectivity
from screenfunnel.operators.literals import candidates, required_literals
from screenfunnel.operators.rules import Limit, range_filter, tag_range


#: Catalogues of so many entries find the patterns worth trying in one pass over the text.
AUTOMATON_FROM = 32


@dataclass(frozen=True)
class Alert:
    """``tier`` orders the catalogue, ``family`` is the reported class, ``name`` the entry."""

    tier: int
    family: str
    name: str
    pattern: str


def regex_match(text: Column, alert: Alert) -> Column:
    return text.rlike(alert.pattern)


def read_catalogue(df: DataFrame) -> list[Alert]:
    """A catalogue table (tier, ord, family, name, pattern) as a list, in screening order.

    A catalogue is configuration that goes into the plan, some 5 MB for 100 000 entries.
    """
    return [Alert(r.tier, r.family, r.name, r.pattern) for r in df.orderBy("tier", "ord").collect()]


def first_alert(
    text: Column, catalogue: Sequence[Alert], match: Callable[[Column, Alert], Column] = regex_match
) -> Column:
    """(family, name) of the first matching entry, or null. No join, no shuffle, no row per pattern.

    A short catalogue, or one with a ``match`` of its own, is one ``coalesce``: entries are tried in order and the rest is not
    evaluated after a match, so tier 2 only sees rows that are clean in tier 1. From ``AUTOMATON_FROM`` entries on, one pass
    over the text finds the entries whose required literals it holds; only those patterns are tried, in order. Entries
    without such a literal are tried one by one as before.
    """
    ordered = sorted(catalogue, key=lambda a: a.tier)
    if match is not regex_match or len(ordered) < AUTOMATON_FROM:
        return F.coalesce(*[F.when(holds(match(text, a)), _reported(a)) for a in ordered])
    needs = [required_literals(a.pattern) for a in ordered]
    quick = [i for i, x in enumerate(needs) if x]
    slow = [i for i, x in enumerate(needs) if not x]
    found = F.lit(None).cast("int")
    if quick:
        patterns = F.array(*[F.lit(ordered[i].pattern) for i in quick])
        places = F.array(*[F.lit(i) for i in quick])
        near = candidates([needs[i] for i in quick])(text)
        hits = F.filter(near, lambda i: F.rlike(text, F.element_at(patterns, i)))
        found = F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, F.element_at(places, F.get(h, F.lit(0)))))[0]
    for i in reversed(slow):
        # the place of the first slow entry that matches, unless a quick one stands before it
        found = F.when(holds(match(text, ordered[i])) & F.coalesce(found > i, F.lit(True)), i).otherwise(found)
    families, names = (F.array(*[F.lit(getattr(a, field)) for a in ordered]) for field in ("family", "name"))
    reported = F.transform(F.array(found), lambda i: F.when(i.isNotNull(), F.struct(F.element_at(families, i + 1).alias("family"), F.element_at(names, i + 1).alias("name"))))
    return F.get(reported, F.lit(0))


def _reported(alert: Alert) -> Column:
    return F.struct(F.lit(alert.family).alias("family"), F.lit(alert.name).alias("name"))


def tag_alerts(
    df: DataFrame,
    text_col: str,
    catalogue: Sequence[Alert],
    match: Callable[[Column, Alert], Column] = regex_match,
    valid: Callable[[Column], Column] | None = None,
    skip: Column | None = None,
) -> DataFrame:
    """``df`` with MatchAlert and Substructure of the first match, null in clean rows; rows that ``skip`` holds for are not
    looked at. Rows that ``valid`` refuses, and null texts, are ``invalid_smiles``."""
    text = F.col(text_col)
    usable = holds(valid(text)) if valid else text.isNotNull()
    invalid = F.struct(F.lit("invalid_smiles").alias("family"), F.lit("").alias("name"))
    hit = F.when(~usable, invalid).otherwise(first_alert(text, catalogue, match))
    if skip is not None:
        hit = F.when(~skip, hit)
    # The generator keeps the optimiser from evaluating the patterns once per use of the result.
    tagged = df.select("*", F.explode(F.array(hit)).alias("_hit"))
    return tagged.withColumns({"MatchAlert": F.col("_hit.family"), "Substructure": F.col("_hit.name")}).drop("_hit")


def alert_screen(
    df: DataFrame,
    text_col: str,
    catalogue: Sequence[Alert],
    match: Callable[[Column, Alert], Column] = regex_match,
    valid: Callable[[Column], Column] | None = None,
    rejected_columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with MatchAlert and Substructure).

    ``match`` may use any column function or pandas UDF; rows that ``valid`` refuses, and null
    texts, are rejected as ``invalid_smiles``.
    """
    tagged = tag_alerts(df, text_col, catalogue, match, valid)
    accepted = tagged.filter(F.col("MatchAlert").isNull()).drop("MatchAlert", "Substructure")
    rejected = tagged.filter(F.col("MatchAlert").isNotNull())
    if rejected_columns is not None:
        rejected = keep_existing(rejected, [*rejected_columns, "MatchAlert", "Substructure"])
    return accepted, rejected


def decide(
    df: DataFrame,
    limits: Sequence[Limit],
    text_col: str | None = None,
    catalogue: Sequence[Alert] = (),
    match: Callable[[Column, Alert], Column] = regex_match,
    valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Range filter, then alert screen as one pass: ``df`` with Rejection, MatchAlert, Substructure and ``decision``
    (``accepted``, ``range`` or ``alert``). Without a text column nothing is screened.

    The result is meant to be stored once by :func:`~screenfunnel.sources.sinks.write_decided`, whose sides are then reads.
    """
    tagged = tag_range(df, limits)
    if text_col is None:
        none = F.lit(None).cast("string")
        tagged = tagged.withColumns({"MatchAlert": none, "Substructure": none})
    else:
        tagged = tag_alerts(tagged, text_col, catalogue, match, valid, F.col("Rejection").isNotNull())
    verdict = F.when(F.col("Rejection").isNotNull(), "range").when(F.col("MatchAlert").isNotNull(), "alert").otherwise("accepted")
    return tagged.withColumn("decision", verdict)


def sides(decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected by range, rejected by alert) of a decided table, each with its own columns."""
    side = lambda name, *drop: decided.filter(F.col("decision") == name).drop("decision", *drop)
    return side("accepted", "Rejection", "MatchAlert", "Substructure"), side("range", "MatchAlert", "Substructure"), side("alert", "Rejection")


def filter_and_screen(
    df: DataFrame,
    limits: Sequence[Limit],
    text_col: str,
    catalogue: Sequence[Alert],
    match: Callable[[Column, Alert], Column] = regex_match,
    valid: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Range filter, then alert screen: (accepted, rejected by range, rejected by alert)."""
    in_range, out_of_range = range_filter(df, limits)
    accepted, alerted = alert_screen(in_range, text_col, catalogue, match, valid)
    return accepted, out_of_range, alerted


def match_export(
    df: DataFrame,
    predicate: Callable[[Column], Column],
    id_col: str,
    key_col: str,
    target: str,
    off_target: str,
    valid: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows whose key matches, with trimmed id and key and the selectivity of the medians and
    means (``{target}_median`` …). Rows with a blank id or key are skipped."""
    key = F.trim(F.col(key_col))
    rows = df.withColumn(id_col, F.trim(F.col(id_col).cast("string"))).withColumn(key_col, key)
    rows = rows.filter((F.col(id_col) != "") & (F.col(key_col) != ""))
    if valid is not None:
        rows = rows.filter(holds(valid(F.col(key_col))))
    rows = rows.filter(holds(predicate(F.col(key_col))))
    out = [F.col(id_col), F.col(key_col)]
    for stat in ("median", "mean"):
        t, o = number(f"{target}_{stat}"), number(f"{off_target}_{stat}")
        out += [o.alias(f"{off_target}_{stat}"), t.alias(f"{target}_{stat}"), selectivity(o, t).alias(f"SI_{stat}")]
    return rows.select(*out)
