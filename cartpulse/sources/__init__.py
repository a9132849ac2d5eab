"""Input tables: parquet readers, the test-data derivation, parameter tables."""

from cartpulse.sources.tables import TABLE_NAMES, DeliveryTables
from cartpulse.sources.tpch import campaign_members, derive_tables, reduced_vat_predicate

__all__ = ["TABLE_NAMES", "DeliveryTables", "campaign_members", "derive_tables", "reduced_vat_predicate"]
