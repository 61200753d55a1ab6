"""framewise — retail buying analytics as Spark DataFrame functions.

Every public operator is a function ``DataFrame... -> DataFrame``; Catalyst
plans the work.  Some run small jobs while they build their plan: a bound or a
last date that becomes a literal, cut points of a global order, staged tables
of iterative steps.  No rows are collected beyond such bounded values.

Sub-packages
------------
sources    schemas, table loading, adapter views over the driver tables, sinks,
           data-quality report
functions  shared column expressions (half-even rounding, bands, ranks, ...)
operators  the analytic operators (signals, supply, recommend, similarity,
           kpis, features, forecast, diagnostics, reports)
plans      the query registry used by ``__spark_entry__`` and the equivalent
           DuckDB SQL used as an oracle
llm        training-data operators over text, pages and vectors (optional:
           nothing else imports it)
"""

from framewise.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
