"""touchline: event analytics over timelines of many recordings, as Spark DataFrame operators."""
