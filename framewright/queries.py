"""Named queries over the given tables, with the DuckDB SQL they are held against."""

from framewright.plans import assembly, basic, detection, hypotheses, search, studies, training

QUERIES = {**basic.QUERIES, **detection.QUERIES, **search.QUERIES, **studies.QUERIES, **training.QUERIES, **hypotheses.QUERIES, **assembly.QUERIES}
ORACLES = {**basic.ORACLES, **detection.ORACLES, **search.ORACLES, **studies.ORACLES, **training.ORACLES, **hypotheses.ORACLES, **assembly.ORACLES}
