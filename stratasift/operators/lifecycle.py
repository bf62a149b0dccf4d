"""State machines replayed over logs of actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ops import ordered_fold


@dataclass(frozen=True)
class Machine:
    """Where a thing begins, and what each action makes of a state; other actions are refused and change nothing."""

    start: str
    moves: dict[tuple[str, str], str]


#: An epoch: whatever is written into it has to be validated again, and what is sealed stays as it is.
EPOCH = Machine(
    "staging",
    {
        ("staging", "write"): "staging",
        ("staging", "fail"): "staging",
        ("staging", "validate"): "validated",
        ("validated", "write"): "staging",
        ("validated", "fail"): "staging",
        ("validated", "seal"): "sealed",
        ("sealed", "activate"): "active",
    },
)

#: A regression candidate under review.
REVIEW = Machine(
    "pending",
    {("pending", "propose"): "pending", ("pending", "accept"): "accepted", ("pending", "reject"): "rejected", ("rejected", "propose"): "pending"},
)


def replay(log: DataFrame, by: list[str], order: list[str], action: str, machine: Machine) -> DataFrame:
    """Adds ``state`` (after the action) and ``accepted`` to each row of a log, group by group in order."""

    def step(held: list, what):
        new = machine.moves.get((held[0], what))
        held[0] = new or held[0]
        return f"{held[0]}|{int(new is not None)}"

    folded = ordered_fold(log, by, order, lambda: [machine.start], step, T.StructField("outcome", T.StringType()), [action])
    parts = F.split("outcome", r"\|")
    return folded.select(*log.columns, parts[0].alias("state"), (parts[1] == "1").alias("accepted"))
