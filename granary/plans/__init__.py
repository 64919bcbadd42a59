"""Named queries over the standard tables, each with the SQL that gives the same rows where there is one."""

from granary.plans import analysis, listing, reviews, streams

QUERIES = {**listing.Q, **analysis.Q, **reviews.Q, **streams.Q}
ORACLES = {**listing.SQL, **analysis.SQL, **reviews.SQL, **streams.SQL}
