"""Every query of the library, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from lexmill.plans import answers, contracts, corpora, learning, placing, practice, repairs, scoring, speech, streams

PARTS = (scoring.R, learning.R, corpora.R, answers.R, practice.R, speech.R, repairs.R, placing.R, contracts.R, streams.R)
QUERIES = {name: f for part in PARTS for name, f in part.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.oracles.items()}
FLAGSHIP = QUERIES["report_grouping_sets"]
