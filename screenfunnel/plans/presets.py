"""Fixed values of the compound screens: limits, rule sets, catalogues, weights.

Everything here is a parameter of the operators; nothing in ``operators`` knows these numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenfunnel.functions.scalars import number
from screenfunnel.operators.ranking import Component
from screenfunnel.operators.rules import Limit

# Price cutoffs and the cost of the sulphur reagent.
MAX_PRICE_MOL = 200.0
SULPHUR_COST = 10.0

# Highest value of each descriptor per class of compound.
CLASS_HIGHS = {
    "aldehydes": {"tPSA": 118.41, "RotB": 10, "LogP": 4.4964, "MW": 405.883, "HBD": 5, "HBA": 9},
    "acids": {"tPSA": 138.64, "RotB": 10, "LogP": 4.3821, "MW": 421.882, "HBD": 6, "HBA": 9},
    "amines": {"tPSA": 133.35, "RotB": 9, "LogP": 3.7943, "MW": 377.873, "HBD": 6, "HBA": 9},
    "oxazolones": {"tPSA": 145.99, "RotB": 10, "LogP": 5.0848, "MW": 486.957, "HBD": 5, "HBA": 11},
    "products": {"tPSA": 140, "RotB": 10, "LogP": 5, "MW": 500, "HBD": 5, "HBA": 10},
}

# Change of each descriptor by each reaction.
REACTION_DELTAS = {
    "condensation": dict(tPSA=-15.71, RotB=0, LogP=0.4127, MW=21.022, HBD=-1, HBA=1),
    "aminolysis": dict(tPSA=-32.01, RotB=1, LogP=0.3403, MW=-18.015, HBD=-1, HBA=-2),
    "sulphur_exchange": dict(tPSA=16.07, RotB=0, LogP=0.7166, MW=16.068, HBD=-1, HBA=0),
}

# Columns of the rejection tables.
REJECTED_COLUMNS = ("ID", "SMILES", "PriceMol", "tPSA", "RotB", "LogP", "MW", "HBD", "HBA")

# Limits are reported column by column in this order, with so many digits, and a row
# fails by these comparisons. Carbon and heteroatom minima must be exceeded.
REPORTED = {
    "tPSA": (1, (">", "<")),
    "RotB": (None, (">", "<")),
    "LogP": (2, (">", "<")),
    "MW": (1, (">", "<")),
    "HBD": (None, (">", "<")),
    "HBA": (None, (">", "<")),
    "MR": (2, ("<", ">")),
    "HvyAtm": (None, ("<", ">")),
    "Rings": (None, (">", "<")),
    "PriceMol": (2, (">", "<")),
    "CAtm": (None, ("<=", ">")),
    "HetAtm": (None, ("<=", ">")),
}


def column_limits(ranges: Mapping[str, tuple[float | None, float | None]]) -> list[Limit]:
    """Limits of the columns in ``ranges``, each a lowest and a highest value or None."""
    if unknown := set(ranges) - set(REPORTED):
        raise ValueError(f"no limits are known for {sorted(unknown)}")
    out = []
    for column, (digits, ops) in REPORTED.items():
        low, high = ranges.get(column, (None, None))
        for op in ops:
            bound = high if op == ">" else low
            if bound is not None:
                out.append(Limit(column, op, bound, digits))
    return out


def class_limits(kind: str) -> list[Limit]:
    """Upper limits of a class of compounds."""
    return column_limits({column: (None, high) for column, high in CLASS_HIGHS[kind].items()})


def drug_likeness_rules() -> dict[str, Column]:
    """Five named rule sets on descriptor columns."""

    def at_most(**bounds: float) -> Column:
        out = F.lit(True)
        for c, b in bounds.items():
            out = out & (number(c) <= b)
        return out

    def at_least(**bounds: float) -> Column:
        out = F.lit(True)
        for c, b in bounds.items():
            out = out & (number(c) >= b)
        return out

    # The bounds of the published rule sets.
    return {
        "Lipinski": at_most(MW=500, LogP=4.15, HBD=5, HBA=10),
        "Ghose": at_least(MW=160, LogP=-0.4, MR=40, Atoms=20) & at_most(MW=480, LogP=5.6, MR=130, Atoms=70),
        "Egan": at_most(LogP=5.88, tPSA=131.6),
        "Muegge": at_least(MW=200, LogP=-2, CAtm=5, HetAtm=2)
        & at_most(MW=600, LogP=5, HBD=5, HBA=10, Rings=7, RotB=15, tPSA=150),
        "Veber": at_most(RotB=10, tPSA=140),
    }


# Weights of the final ranking; a low activity score and a low docking score rank high.
FINAL_RANKING = (
    Component("QSAR_score", "qsar_norm", 0.5, True),
    Component("geo_score", "geo_norm", 0.4, False),
    Component("score_cox2", "vina_norm", 0.1, True),
)
