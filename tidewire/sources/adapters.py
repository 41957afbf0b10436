"""Sources of security events and of cash statements by the name of their adapter.

A security adapter takes a table of inputs and returns events, a cash adapter returns (statements, entries); all adapters of
a kind give the columns listed here, null where a source has no such fact, so that their outputs can be put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import cash, entities
from tidewire.sources import inbox

EVENT = "source string, message_id string, message_type string, isin string, instrument_desc string, quantity double, amount double, currency string, settlement_date string, safekeeping_account string, party_bic string, status string, transaction_ref string"
STATEMENT = "message_id string, message_type string, reference string, account string, currency string, opening double, closing double, available double"
ENTRY = "message_id string, row_seq long, account string, currency string, value_date string, entry_date string, direction string, amount double, signed_amount double, transaction_type string, customer_ref string, bank_ref string, info string"

_SECURITY: dict[str, Callable[[DataFrame], DataFrame]] = {}
_CASH: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {}


def register_security(name: str, read: Callable[[DataFrame], DataFrame]) -> None:
    _SECURITY[name] = read


def register_cash(name: str, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    _CASH[name] = read


def _known(adapters: dict, name: str) -> Callable:
    if name not in adapters:
        raise ValueError(f"no adapter {name}; there are {', '.join(sorted(adapters))}")
    return adapters[name]


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))


def security_events(name: str, inputs: DataFrame) -> DataFrame:
    """The events that an adapter reads from inputs; an unknown adapter is refused."""
    return _shaped(_known(_SECURITY, name)(inputs), EVENT)


def cash_statements(name: str, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, entries) that an adapter reads from inputs; an unknown adapter is refused."""
    heads, rows = _known(_CASH, name)(inputs)
    return _shaped(heads, STATEMENT), _shaped(rows, ENTRY)


def _custodian(files: DataFrame) -> DataFrame:
    return inbox.positions(files).withColumn("source", F.lit("csv")).withColumn("message_type", F.lit("CSV"))


register_security("swift", entities.events_of)
register_security("csv", _custodian)
register_cash("swift", cash.cash_star)
register_cash("camt.053", inbox.camt_statements)
