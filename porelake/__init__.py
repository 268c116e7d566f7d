"""porelake: nanopore methylation analytics as Spark plans."""
