"""Registered queries over the given tables, each with its SQL twin."""

from workload import assessments, detections, enrichment, expressions, hunts, maps, packets, protocols, streams

REGISTRIES = (
    detections.R, expressions.R, hunts.R, assessments.R, maps.R, enrichment.R, protocols.R, packets.R, streams.R,
)
