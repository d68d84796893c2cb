"""The seven input tables: file, missing-value tokens, types of known columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    """One delimited file. Columns not listed in ``types`` stay strings."""

    file: str
    missing: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)


# File names, missing-value tokens and column names of the input.
# An address may lie in the province with code NA, so there only the empty
# string is missing. Postcodes stay text to keep their leading zeros.
TABLES = {
    "fidelity": Table("raw_1_cli_fid.csv", ("NA", ""), {"ID_CLI": "bigint"}),
    "account": Table("raw_2_cli_account.csv", ("NA", ""), {"ID_ADDRESS": "bigint"}),
    "address": Table("raw_3_cli_address.csv", ("",), {"ID_ADDRESS": "bigint"}),
    "privacy": Table("raw_4_cli_privacy.csv", ("NA", "")),
    "campaign": Table("raw_5_camp_cat.csv", ("NA", ""), {"ID_CAMP": "bigint"}),
    "event": Table(
        "raw_6_camp_event.csv",
        ("NA", ""),
        {"ID_EVENT": "bigint", "ID_CLI": "bigint", "ID_CAMP": "bigint", "ID_DELIVERY": "bigint"},
    ),
    "ticket": Table(
        "raw_7_tic.csv",
        ("NA", ""),
        {"ID_TICKET": "bigint", "ID_CLI": "bigint", "TIC_DATE": "date", "AMOUNT": "double"},
    ),
}

# Items of tickets are no table of their own; a file of them has these rules.
LINES = Table("", ("NA", ""), {"ID_TICKET": "bigint"})
