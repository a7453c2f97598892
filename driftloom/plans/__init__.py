"""Plans: the pass pipeline, and the queries over the test tables with SQL that says the same."""
