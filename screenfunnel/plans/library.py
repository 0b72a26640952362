"""Library generation: priced building blocks → pairs within a budget → filtered products.

Every stage is lazy; give ``store`` to keep stages as tables (and reuse them with the same
parameters), which also cuts the lineage between the big stages.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from screenfunnel.functions.scalars import keep_existing
from screenfunnel.operators.dedupe import cheapest_per_key
from screenfunnel.operators.offers import attach_price, best_offer
from screenfunnel.operators.pairing import condense_cheapest, map_with_reagent
from screenfunnel.operators.profile import fingerprint
from screenfunnel.operators.rules import Limit, derive_limits, range_filter
from screenfunnel.operators.screen import Alert, decide, regex_match, sides
from screenfunnel.plans import presets
from screenfunnel.sources.sinks import materialise, materialise_decided, stage_counts

Describe = Callable[[DataFrame], DataFrame]


@dataclass
class LibraryPlan:
    """The chemistry of the three steps as column builders, and the limits.

    ``condensation``/``aminolysis`` take the two structure columns, ``sulphur_exchange`` one; each
    gives an array of product texts. ``describe`` adds the descriptor columns to products.
    """

    condensation: Callable[[Column, Column], Column]
    aminolysis: Callable[[Column, Column], Column]
    sulphur_exchange: Callable[[Column], Column]
    describe: Describe
    cap: float | None = presets.MAX_PRICE_MOL
    sulphur_cost: float = presets.SULPHUR_COST
    oxazolone_limits: Sequence[Limit] = ()
    product_limits: Sequence[Limit] = ()
    catalogue: Sequence[Alert] = ()
    match: Callable[[Column, Alert], Column] = regex_match
    #: Change of a descriptor by the condensation, for descriptors that add up: parts that no allowed oxazolone can hold are
    #: dropped before pairing.
    condensation_deltas: dict[str, float] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)


def priced_blocks(
    blocks: DataFrame, offers: DataFrame, limits: Sequence[Limit], id_col: str = "Catalog_ID"
) -> tuple[DataFrame, DataFrame]:
    """Building blocks with their best price, within the limits: (accepted, rejected)."""
    priced = attach_price(blocks, best_offer(offers), id_col)
    return range_filter(priced, limits, rejected_columns=presets.REJECTED_COLUMNS)


def _spelled(value: Any) -> Any:
    """A plan's values as JSON: functions by their code and what they close over, others by fields."""
    if callable(value) and hasattr(value, "__code__"):
        closed = [_spelled(c.cell_contents) for c in value.__closure__ or ()]
        return [value.__qualname__, value.__code__.co_code.hex(), repr(value.__code__.co_consts), closed]
    if is_dataclass(value):
        return {f.name: _spelled(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, dict):
        return {str(k): _spelled(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_spelled(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def _content(df: DataFrame) -> list[str]:
    return [str(v) for v in fingerprint(df).first()]


#: Stages of a stored run that count their rows.
STAGES = ("oxazolones_raw", "oxazolones", "imidazolones_raw", "imidazolones", "thiazolones_raw", "thiazolones")


def _fitting(plan: LibraryPlan, part: DataFrame, partner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts that can give an oxazolone within the limits with some partner, and the others."""
    upper = {x.column: x.bound for x in plan.oxazolone_limits if x.op == ">" and x.column in plan.condensation_deltas}
    derived = derive_limits(upper, plan.condensation_deltas, partner) if upper else {}
    return range_filter(part, [Limit(c, ">", bound) for c, bound in derived.items()])


def run_library(
    plan: LibraryPlan, aldehydes: DataFrame, acids: DataFrame, amines: DataFrame, store: str | None = None, counted: bool = True
) -> dict[str, DataFrame]:
    """Both product families with all intermediate and rejected tables, by name.

    With ``store`` every stage is written once: filters and screens as one decided table each, whose accepted and rejected rows
    are reads of it, and with the counts of :func:`library_counts` taken while writing. Without ``counted`` the reactions count
    nothing, and only the cheapest partners of each text are paired.
    """
    spark = aldehydes.sparkSession
    # A stored stage is only used again if the whole plan and all inputs are the same.
    base = {} if store is None else {"plan": _spelled(plan), "counted": counted, "inputs": [_content(x) for x in (aldehydes, acids, amines)]}

    def keep(name: str, make: Callable[[Observation | None], DataFrame]) -> DataFrame:
        if store is None:
            return make(None)
        watch = Observation() if counted else None
        return materialise(spark, f"{store}/{name}", {**base, "stage": name}, lambda: make(watch), watch=watch)

    def cheapest(df: DataFrame) -> DataFrame:
        return cheapest_per_key(df, "SMILES", "PriceMol", "ID").select("ID", "SMILES", "PriceMol")

    def judged(name: str, raw: DataFrame, limits: Sequence[Limit], catalogue: Sequence[Alert]) -> tuple[DataFrame, DataFrame, DataFrame]:
        def make() -> DataFrame:
            return decide(plan.describe(raw), limits, "SMILES" if catalogue else None, catalogue, plan.match)

        if store is None:
            return sides(make())
        decided = materialise_decided(spark, f"{store}/{name}", {**base, "stage": name}, make, ("accepted", "range", "alert"))
        return sides(decided)

    def shown(rejected: DataFrame, *reasons: str) -> DataFrame:
        return keep_existing(rejected, [*presets.REJECTED_COLUMNS, *reasons])

    out: dict[str, DataFrame] = {}
    fitting_aldehydes, out["aldehydes_rejected"] = _fitting(plan, aldehydes, acids)
    fitting_acids, out["acids_rejected"] = _fitting(plan, acids, aldehydes)
    out["oxazolones_raw"] = keep(
        "oxazolones_raw", lambda watch: condense_cheapest(fitting_aldehydes, fitting_acids, plan.cap, plan.condensation, counts=watch)
    )
    out["oxazolones"], by_range, _ = judged("oxazolones", out["oxazolones_raw"], plan.oxazolone_limits, ())
    out["oxazolones_rejected"] = shown(by_range, "Rejection")
    reactants = out["oxazolones"].select("ID", "SMILES", "PriceMol")
    out["imidazolones_raw"] = keep(
        "imidazolones_raw",
        lambda watch: condense_cheapest(
            reactants, amines, plan.cap, plan.aminolysis, form="probe", letters=("A", "N"), counts=watch
        ),
    )
    out["thiazolones_raw"] = keep(
        "thiazolones_raw",
        lambda watch: cheapest(map_with_reagent(reactants, plan.sulphur_cost, plan.cap, plan.sulphur_exchange, counts=watch)),
    )
    for family in ("imidazolones", "thiazolones"):
        out[family], by_range, by_alert = judged(family, out[f"{family}_raw"], plan.product_limits, plan.catalogue)
        out[f"{family}_rejected_range"] = shown(by_range, "Rejection")
        if plan.catalogue:
            out[f"{family}_rejected_alert"] = shown(by_alert, "MatchAlert", "Substructure")
    return out


def library_counts(spark: SparkSession, store: str) -> DataFrame:
    """stage, counter, n of a stored run: pairs, problematic, no_product, failed_products and products of each reaction, rows
    kept after the cheapest of each product, and accepted, range and alert of each filter. Nothing is read but the manifests."""
    return stage_counts(spark, store, STAGES)
