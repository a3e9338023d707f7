from larder.sources.tables import load_table, TABLES
from larder.sources.views import RetailModel, VIEW_SQL, oracle_with_views

__all__ = ["load_table", "TABLES", "RetailModel", "VIEW_SQL", "oracle_with_views"]
