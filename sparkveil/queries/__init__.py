"""All registered queries and their check SQL."""

from sparkveil.queries import detectors, reports

QUERIES = {**detectors.QUERIES, **reports.QUERIES}
ORACLES = {**detectors.ORACLES, **reports.ORACLES}
