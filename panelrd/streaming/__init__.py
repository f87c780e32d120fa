"""Streaming: intentionally empty.

The analysis this library re-expresses is a batch study over finished cohorts;
it has no streams, watermarks, windows over event time or state.  Nothing here
is built on purpose (see README, "Not built").  Every operator in
`panelrd.operators` is a plain DataFrame transformation, so it can be applied
inside `foreachBatch` of a Structured Streaming query if a caller needs that.
"""
