"""Named queries; importing this package registers all of them."""

from . import announcement_queries, calendar_queries, catalog_queries, delivery_queries, duplicate_queries, level_queries, output_queries, recurrence_queries, series_queries, snapshot_queries, source_queries, text_queries  # noqa: F401
