"""The canonical model: ten collections, each record with its lineage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values.
SCHEMA_VERSION = "aml-canonical-1.0"
LINEAGE = "struct<source_type:string,source_name:string,table:string,source_record_id:string,adapter:string,adapter_version:string>"
#: Collection: (record type, hash label, key, fields in the order of the canonical serialisation).
COLLECTIONS: dict[str, tuple[str, str, str, str]] = {
    "transactions": ("transaction", "txn", "transaction_id", "transaction_id string, source_account string, destination_account string, amount decimal(38,10), currency string, timestamp timestamp, channel string, jurisdiction string, sar_linked boolean"),
    "accounts": ("account", "acct", "account_id", "account_id string, owner string, institution string, currency string"),
    "customers": ("customer", "cust", "customer_id", "customer_id string, name string, risk_rating string, jurisdiction string"),
    "entities": ("entity", "ent", "entity_id", "entity_id string, entity_type string, display_name string"),
    "relationships": ("relationship", "rel", "relationship_id", "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, evidence_ids array<string>"),
    "cases": ("case", "case", "case_id", "case_id string, title string, status string"),
    "alerts": ("alert", "alert", "alert_id", "alert_id string, case_id string, typology string, severity string"),
    "evidence": ("evidence", "evid", "evidence_id", "evidence_id string, evidence_type string, description string, related_record_ids array<string>"),
    "jurisdictions": ("jurisdiction", "juris", "code", "code string, name string, high_risk boolean"),
    "sars": ("sar", "sar", "sar_id", "sar_id string, case_id string, transaction_ids array<string>, narrative string"),
}


def struct_of(collection: str) -> T.StructType:
    return T.StructType.fromDDL(f"{COLLECTIONS[collection][3]}, source_lineage {LINEAGE}")


@dataclass(frozen=True)
class Dataset:
    """One source's contribution."""

    collections: dict[str, DataFrame]
    name: str = "source"
    schema_version: str = SCHEMA_VERSION
    source_type: str = ""

    def get(self, spark: SparkSession, collection: str) -> DataFrame:
        df = self.collections.get(collection)
        return df if df is not None else spark.createDataFrame([], struct_of(collection))


@dataclass(frozen=True)
class Case:
    """The merged case."""

    collections: dict[str, DataFrame]
    conflicts: DataFrame
    source_manifest: DataFrame
    schema_version: str = SCHEMA_VERSION
    failures: list[tuple[str, str]] = field(default_factory=list)


class AdapterError(Exception):
    """A source cannot be used."""


class UnsupportedSource(AdapterError):
    """No adapter of that name."""


class InvalidConfiguration(AdapterError):
    """Options that no adapter can work with."""


class SourceError(AdapterError):
    """The source cannot be read."""


class NormalisationError(AdapterError):
    """Its rows cannot be made canonical."""
