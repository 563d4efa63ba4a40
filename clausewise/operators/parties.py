"""Party roles of a contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import UNI, lookup


def role(raw: Column, synonyms: dict[str, str] | None = None) -> Column:
    return lookup(raw, synonyms or fv.ROLE_SYNONYMS, raw)


def _one_party(text: Column, symbol: str, roles: list[str], synonyms: dict[str, str], default: Column) -> Column:
    names = "|".join(roles)
    before = F.regexp_extract(text, UNI + rf"({names})\s*\(\s*{symbol}\s*\)", 1)
    after = F.regexp_extract(text, UNI + rf"{symbol}\s*\(\s*({names})\s*\)", 1)
    return F.coalesce(
        role(F.nullif(before, F.lit("")), synonyms), role(F.nullif(after, F.lit("")), synonyms), default
    )


def parties(
    text: Column,
    contract_type: Column,
    candidates: dict[str, list[str]] | None = None,
    defaults: dict[str, tuple[str, str]] | None = None,
    synonyms: dict[str, str] | None = None,
    symbols: tuple[str, str] = fv.PARTY_SYMBOLS,
) -> Column:
    """``struct<party_a, party_b>``: role named next to the symbol, else the usual one."""
    candidates = candidates or fv.ROLE_CANDIDATES
    defaults = defaults or fv.DEFAULT_PARTIES
    synonyms = fv.ROLE_SYNONYMS if synonyms is None else synonyms
    columns = []
    for side, symbol in enumerate(symbols):
        out = F.lit(symbol)
        for ct, roles in candidates.items():
            usual = F.lit(defaults.get(ct, symbols)[side])
            out = F.when(contract_type == ct, _one_party(text, symbol, roles, synonyms, usual)).otherwise(out)
        columns.append(out)
    return F.struct(columns[0].alias("party_a"), columns[1].alias("party_b"))
