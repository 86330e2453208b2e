"""All registered queries with the SQL that each is held against."""

from skein.plans import graphs, modelling, rating, reports

QUERIES = {**graphs.QUERIES, **rating.QUERIES, **modelling.QUERIES, **reports.QUERIES}
ORACLES = {**graphs.ORACLES, **rating.ORACLES, **modelling.ORACLES, **reports.ORACLES}
