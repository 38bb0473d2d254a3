"""DataFrame operators: detections, map, profiles, correlation, cases."""
