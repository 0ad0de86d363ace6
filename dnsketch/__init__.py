"""DNS lookup sketches, searches and roll-ups expressed as Spark DataFrames."""
