"""Named queries: each is a function of a dialect that returns SQL, run by Spark and held against the other engine."""
