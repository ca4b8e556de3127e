"""Named queries; importing the package registers them all in `queries.QUERIES` and `queries.ORACLES`."""

from . import aggregates, forms, ledgers, lists, queries, rules, served, sources, texts  # noqa: F401
