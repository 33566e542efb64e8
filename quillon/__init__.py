"""quillon: relational, statistical and series analytics as Spark plans."""
